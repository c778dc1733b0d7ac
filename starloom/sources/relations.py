"""The engine's relations, read from Parquet tables: vectors, slot distributions, points, positions, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Modes in their fixed order, with the slots that each has in a 64-number vector of 8 slots by 8 codes.
MODES = {"image": (0, 4), "spectrum": (4, 2), "table": (6, 2)}
CODES = 8
#: Sharpness of the distribution over codes.
SHARPNESS = 4.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, vec, label)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), "label")


def floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, vec): vectors() as the table's floats, half as wide when they are sent."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("item"), F.col("embedding").alias("vec"))


def mode_of(slot: F.Column) -> F.Column:
    out = F.lit(None).cast("string")
    for name, (first, width) in MODES.items():
        out = F.when((slot >= first) & (slot < first + width), F.lit(name)).otherwise(out)
    return out


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, mode, slot, code, p): a categorical distribution over codes for each slot."""
    long = vectors(spark, sf_dir).select("item", F.posexplode("vec").alias("i", "x"))
    long = long.select("item", F.floor(F.col("i") / CODES).cast("int").alias("slot"), (F.col("i") % CODES).alias("code"), F.exp(SHARPNESS * F.col("x")).alias("e"))
    total = F.sum("e").over(Window.partitionBy("item", "slot"))
    return long.select("item", mode_of(F.col("slot")).alias("mode"), "slot", "code", (F.col("e") / total).alias("p"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, dist): slots() with one row for each item, an array of codes for each slot; no shuffle."""
    v = vectors(spark, sf_dir).select("item", F.transform("vec", lambda x: F.exp(SHARPNESS * x)).alias("e"))
    count = sum(width for _, width in MODES.values())
    parts = v.select("item", F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda s: F.slice("e", s * CODES + 1, CODES)).alias("parts"))
    # each slot's sum is worked out once, not once for each of its codes
    summed = parts.withColumn("sums", F.transform("parts", lambda p: F.aggregate(p, F.lit(0.0), lambda a, y: a + y)))
    return summed.select("item", F.zip_with("parts", "sums", lambda p, t: F.transform(p, lambda x: x / t)).alias("dist"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, x, y, category): a two-dimensional map."""
    return vectors(spark, sf_dir).select("item", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"), F.col("label").alias("category"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, ra, dec) in degrees."""
    return vectors(spark, sf_dir).select("item", (F.col("vec")[0] + 150).alias("ra"), (F.col("vec")[1] + 2).alias("dec"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, at, value, weight, bad): samples of a spectrum-like sequence for each order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("series"), F.col("l_linenumber").alias("at"), (F.col("l_extendedprice") / 1000).alias("value"), (1 / F.col("l_quantity")).alias("weight"), (F.col("l_returnflag") == "R").alias("bad")
    )
