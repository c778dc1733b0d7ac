"""Stores and exports: key-sorted Parquet, parts that a rerun skips, ECSV and CSV text."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_store(df: DataFrame, path: str, key: str, files: int | None = None) -> None:
    """df as zstd Parquet sorted by key in files of key ranges, so that a lookup by key reads few row groups."""
    ranged = df.repartitionByRange(key) if files is None else df.repartitionByRange(files, key)
    ranged.sortWithinPartitions(key).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_parts(df: DataFrame, path: str, part: str) -> None:
    """Add the rows of those parts that the store doesn't have yet, a folder for each part; null is a part like others.

    Rows are written to a hidden folder, and each part's folder is then renamed into its place, so a part is there whole
    or not at all. A rerun goes on with those that are missing and clears what a broken run has left.
    """
    spark, jvm = df.sparkSession, df.sparkSession._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(root)
    names = [x.getPath().getName() for x in files.listStatus(root)]
    for left in (x for x in names if x.startswith("_writing-")):
        files.delete(jvm.org.apache.hadoop.fs.Path(root, left), True)
    plain = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    held = [plain(x.removeprefix(f"{part}=")) for x in names if x.startswith(f"{part}=")]
    done = spark.createDataFrame([(None if x == "__HIVE_DEFAULT_PARTITION__" else x,) for x in held], "_done string")
    rest = df.join(done, F.col(part).cast("string").eqNullSafe(F.col("_done")), "left_anti")
    hidden = jvm.org.apache.hadoop.fs.Path(root, f"_writing-{uuid.uuid4().hex}")
    rest.repartition(part).write.partitionBy(part).option("compression", "zstd").parquet(hidden.toString())
    for x in files.listStatus(hidden):
        if x.getPath().getName().startswith(f"{part}="):
            files.rename(x.getPath(), jvm.org.apache.hadoop.fs.Path(root, x.getPath().getName()))
    files.delete(hidden, True)


def _cell(c: Column) -> Column:
    text = c.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[ "]') | (text == ""), quoted).otherwise(text), F.lit('""'))


def ecsv_header(df: DataFrame, meta: dict[str, str] | None = None) -> list[str]:
    """The comment lines of an ECSV file and its line of names."""
    kinds = {"bigint": "int64", "int": "int32", "double": "float64", "float": "float32", "boolean": "bool"}
    lines = ["%ECSV 1.0", "---", "datatype:", *[f"- {{name: {n}, datatype: {kinds.get(t, 'string')}}}" for n, t in df.dtypes]]
    lines += ["meta:", *[f"  {k}: {v}" for k, v in meta.items()]] if meta else []
    return [*[f"# {x}" for x in lines], " ".join(df.columns)]


def ecsv_rows(df: DataFrame) -> Column:
    """A row of df as a line of ECSV: values by spaces, quoted where they hold one, nulls as empty strings."""
    return F.concat_ws(" ", *[_cell(F.col(c)) for c in df.columns])


def write_ecsv(df: DataFrame, path: str, meta: dict[str, str] | None = None) -> None:
    """df as one ECSV file in a folder: an export of a selection that someone asked for."""
    lines = df.select(ecsv_rows(df).alias("value"))
    head = df.sparkSession.createDataFrame([(x,) for x in ecsv_header(df, meta)], "value string")
    head.coalesce(1).unionAll(lines).coalesce(1).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The columns of a selection as CSV with a line of names."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def suffixed(df: DataFrame, suffix: str, kinds: tuple[str, ...] = ("double", "float", "bigint", "int", "boolean")) -> list[str]:
    """The numeric and boolean columns whose names end in the suffix."""
    return [c for c, t in df.dtypes if c.endswith(suffix) and t in kinds]
