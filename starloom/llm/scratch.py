"""Written tables in the shared folder, fixed-size bitmaps, and removal of rows by key."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a bitmap: at least, and at most (16 MB), whatever the input.
MIN_BITS, MAX_BITS = 1 << 20, 1 << 27
#: Bits that `bitmap_construct_agg` puts into one of its rows.
BUCKET_BITS = 32768


def folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one only for a local master without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="starloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def written(df: DataFrame, batch: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage, survives lost executors, and gives the planner the true size of the table, so that it
    broadcasts the table only below its own threshold. `batch` is how many rows Arrow hands to Python at once, for
    rows of many kilobytes.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path, usual = f"{folder(spark)}/starloom/{uuid.uuid4().hex}", spark.conf.get(name)
    try:
        if batch is not None:
            spark.conf.set(name, batch)
        df.write.parquet(path)
    finally:
        spark.conf.set(name, usual)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove the files of a `written` table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bits_for(rows: int, each: int = 256) -> int:
    """A power of two, about `each` bits for a row, within the fixed bounds."""
    return int(min(MAX_BITS, max(MIN_BITS, 1 << max(0, rows * each - 1).bit_length())))


def bitmap(df: DataFrame, key: str, bits: int) -> np.ndarray:
    """A bit for each value of the long column `key`, modulo `bits`: a filter of `bits` / 8 bytes however long df is.

    Spark builds it: the driver gets one row of 4 KB for each 32,768 bits and no keys.
    """
    n = (F.pmod(F.col(key), F.lit(bits)) + 1).alias("n")
    rows = (
        df.select(n)
        .groupBy(F.bitmap_bucket_number("n").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))
        .collect()
    )
    out = np.zeros(max(bits, BUCKET_BITS) // 8, np.uint8)
    for bucket, held in rows:  # buckets count from 1
        part = np.frombuffer(bytes(held), np.uint8)
        out[(bucket - 1) * len(part) : bucket * len(part)] |= part
    return out


def in_bitmap(held: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Whether the bit of each uint64 or int64 key is set."""
    n = np.mod(keys.astype(np.int64), np.int64(bits))
    return ((held[n >> 3] >> (n & 7).astype(np.uint8)) & 1).astype(bool)


def row_key(id_col: str, text_col: str) -> Column:
    """Rows with one key have the same id and text."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def without(df: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df whose (id, text) is not in `removed`, which has the columns id and key (see `row_key`).

    Only rows that may be among the removed ones, by a bitmap of fixed size, are shuffled for the exact anti-join.
    """
    removed = written(removed.select(F.col("id").alias("_gone_id"), F.col("key").alias("_gone_key")).distinct())
    n = removed.count()
    if n == 0:
        return df
    bits = bits_for(n, 64)
    held = df.sparkSession.sparkContext.broadcast(bitmap(removed, "_gone_key", bits))

    @F.pandas_udf("boolean")
    def maybe(key: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(held.value, key.to_numpy(np.int64), bits))

    names = df.columns
    key = row_key(id_col, text_col)
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(id_col).alias("_id"), key.alias("_key"))
    tested = packed.withColumn("_maybe", maybe("_key"))
    kept = tested.where(~F.col("_maybe")).select("_row")
    exact = (
        tested.where("_maybe")
        .join(removed, F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_key") == F.col("_gone_key")), "left_anti")
        .select("_row")
    )
    return kept.unionAll(exact).select("_row.*")
