"""Queries that write stores and read them back: catalogues by sky cell, arrays, Arrow files and raw binary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators import maps
from starloom.queries import _V, _r, query
from starloom.sources import arrays, sky
from starloom.sources.relations import table, vectors
from starloom.sources.shared import fresh

#: Positions over the whole sky.
_SKY = f"{_V}, p AS (SELECT item, ((vec[1] * 1000) % 360 + 360) % 360 AS ra, greatest(-90, least(90, vec[2] * 400)) AS dec, label FROM v)"


def catalogue(spark: SparkSession, d: str) -> str:
    """Positions over the whole sky as a catalogue in the shared folder; its path."""
    rows = vectors(spark, d).select("item", F.pmod(F.col("vec")[0] * 1000, F.lit(360.0)).alias("ra"), F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.col("vec")[1] * 400)).alias("dec"), "label")
    path = fresh(spark)
    sky.write_catalogue(rows, path)
    return path


@query("s13_box", f"WITH {_SKY} SELECT item, round(ra, 6) AS ra, round(dec, 6) AS dec, label FROM p WHERE (ra >= 300 OR ra <= 60) AND dec BETWEEN -30 AND 45")
def s13_box(spark: SparkSession, d: str) -> DataFrame:
    """A box across right ascension 0 from a catalogue."""
    return sky.read_box(spark, catalogue(spark, d), (300.0, 420.0), (-30.0, 45.0), columns=["item", "ra", "dec", "label"]).select("item", _r("ra"), _r("dec"), "label")


@query(
    "s13_cone",
    f"WITH {_SKY} SELECT item, round(ra, 6) AS ra, round(dec, 6) AS dec FROM p WHERE degrees(2 * asin(sqrt(pow(sin(radians(dec - 70) / 2), 2) + cos(radians(70)) * cos(radians(dec)) * pow(sin(radians(ra - 10) / 2), 2)))) <= 35",
)
def s13_cone(spark: SparkSession, d: str) -> DataFrame:
    """A cone over the pole from a catalogue."""
    return sky.read_cone(spark, catalogue(spark, d), 10.0, 70.0, 35.0, columns=["item", "ra", "dec"]).select("item", _r("ra"), _r("dec"))


@query(
    "b20_box_crossmatch",
    f"""WITH {_SKY}, a AS (SELECT * FROM p WHERE item % 2 = 0 AND (ra >= 300 OR ra <= 60) AND dec BETWEEN -30 AND 45), m AS (SELECT a.item, b.item AS match, degrees(2 * asin(sqrt(pow(sin(radians(b.dec - a.dec) / 2), 2) + cos(radians(a.dec)) * cos(radians(b.dec)) * pow(sin(radians(b.ra - a.ra) / 2), 2)))) AS sep FROM a JOIN p b ON b.item % 2 = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY round(sep, 12), match) AS k FROM m WHERE sep <= 2)
SELECT a.item, coalesce(k.match, -1)::BIGINT AS match, round(k.sep, 6) AS separation FROM a LEFT JOIN k ON k.item = a.item AND k.k = 1""",
)
def b20_box_crossmatch(spark: SparkSession, d: str) -> DataFrame:
    """A box of one catalogue, each item with its nearest of another within two degrees; of the other a wider box is read."""
    path = catalogue(spark, d)
    left = sky.read_box(spark, path, (300.0, 420.0), (-30.0, 45.0), columns=["item", "ra", "dec"]).where("item % 2 = 0")
    right = sky.read_box(spark, path, (297.0, 423.0), (-32.1, 47.1), columns=["item", "ra", "dec"]).where("item % 2 = 1")
    return maps.crossmatch(left, right, 2.0).select("item", F.coalesce("match", F.lit(-1)).cast("long").alias("match"), _r("separation"))


def _ordered(df: DataFrame, key: str) -> DataFrame:
    """df in ranges of a key, sorted: parts written in this order have their rows in order of the key."""
    return df.repartitionByRange(key).sortWithinPartitions(key)


def _kept(df: DataFrame, kind: str, **options: str) -> str:
    arrays.register(df.sparkSession)
    path = fresh(df.sparkSession)
    df.write.format(f"arrays.{kind}").mode("append").options(**options).save(path)
    return path


def _again(spark: SparkSession, path: str, kind: str, **options: str) -> DataFrame:
    return spark.read.format(f"arrays.{kind}").options(**options).load(path)


_TOTAL = "round(list_sum(embedding::DOUBLE[]), 5)"


def _sum(vec: str) -> F.Column:
    return F.round(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double")), 5)


@query("k4_npy_store", f"SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, {_TOTAL} AS total, round(embedding[3]::DOUBLE, 6) AS third FROM embeddings")
def k4_npy_store(spark: SparkSession, d: str) -> DataFrame:
    """Vectors in order of their id as .npy parts, read back with each row's number (K4, S10)."""
    path = _kept(_ordered(table(spark, d, "embeddings"), "vec_id").select(F.col("embedding").alias("values")), "npy")
    return _again(spark, path, "npy").select("row", _sum("values").alias("total"), F.round(F.col("values")[2].cast("double"), 6).alias("third"))


@query("k5_npz_store", f"SELECT vec_id AS item, label, {_TOTAL} AS total FROM embeddings")
def k5_npz_store(spark: SparkSession, d: str) -> DataFrame:
    """Ids, vectors and labels as arrays of .npz parts, read back (K5, S10)."""
    path = _kept(table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("vec"), "label"), "npz")
    return _again(spark, path, "npz", columns="item,vec,label").select("item", "label", _sum("vec").alias("total"))


@query(
    "k8_raw_tokens",
    f"WITH {_V}, e AS (SELECT item, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS i FROM v), m AS (SELECT item, (i // 8)::INT AS slot, arg_max((i % 8)::BIGINT, round(x, 12) - i / 1e15) AS token FROM e GROUP BY item, i // 8) SELECT row_number() OVER (ORDER BY item, slot) - 1 AS row, token FROM m",
)
def k8_raw_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The likeliest code of each slot as little-endian 32-bit numbers, 8 for each item, read back one by one (K8)."""
    best = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda s: F.lit(7) - (F.array_max(F.transform(F.slice("vec", s * 8 + 1, 8), lambda x, i: F.struct(F.round(x, 12).alias("x"), (F.lit(7) - i).alias("i"))))["i"]))
    path = _kept(_ordered(vectors(spark, d).select("item", best.alias("tokens")), "item").select("tokens"), "raw", dtype="<u4")
    return _again(spark, path, "raw", dtype="<u4").select("row", F.col("values").alias("token"))


@query("k1_arrow_store", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN -1 ELSE n_chars END AS size, source FROM documents")
def k1_arrow_store(spark: SparkSession, d: str) -> DataFrame:
    """Documents as Arrow files in batches of 128 with null cells; three columns of four are read back (K1, S2)."""
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("n_chars")).alias("size"), "lang", "source")
    path = _kept(docs, "ipc")
    return _again(spark, path, "ipc", columns="doc_id,size,source").select("doc_id", F.coalesce("size", F.lit(-1)).alias("size"), "source")
