"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a temporary folder only for a local master without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="starloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def fresh(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has written to."""
    return f"{folder(spark)}/starloom/{uuid.uuid4().hex}"


#: Whether Spark removes a query's shuffle files once it has ended, and not when the driver happens to collect what refers to them.
RELEASED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder, read back: its lineage ends there and its size is known to the planner.

    The shuffle files behind it go once it is written, so that passes in a row hold those of one pass.
    """
    spark, path = df.sparkSession, fresh(df.sparkSession)
    before = spark.conf.get(RELEASED, None)
    spark.conf.set(RELEASED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(RELEASED) if before is None else spark.conf.set(RELEASED, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove the files of a `stored` table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
