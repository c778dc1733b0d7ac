"""Evaluators by counting and from sums, and their SQL: own ranks, retrieval from partial data, bases of groups, stacked probes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.factored import _DATA, SCORE, data, flat
from starloom.operators import bases, ranks
from starloom.queries import _FLOOR, _S, _V, _r, query
from starloom.searches import SLOTS, STATED
from starloom.sources.relations import CODES, MODES, vectors

WIDTH = SLOTS * CODES


# ------------------------------------------------------------------ own ranks


def _three(models: np.ndarray, held: np.ndarray) -> list[np.ndarray]:
    """Score, its share of the saturation, and its distance to it."""
    linear, square = models @ held[:, :WIDTH].T, (models * models) @ held[:, WIDTH : 2 * WIDTH].T
    score = 0.5 * (np.where(square > 0, linear * linear / np.where(square > 0, square, 1.0), 0.0) - held[:, 2 * WIDTH])
    saturation = held[:, 2 * WIDTH + 1]
    return [score, score / saturation, score - saturation]


@query(
    "q14_own_ranks",
    f"""WITH {_DATA}, h AS (SELECT item, i, floor(x * 4) / 4 AS x FROM e WHERE item % 20 = 0), k AS (SELECT q.item AS q, g.item, 0.5 * (coalesce(pow(sum(q.x * g.x * (1 + abs(g.x))), 2) / nullif(sum(q.x * q.x * (1 + abs(g.x))), 0), 0) - max(base)) AS s, max(0.5 * (own - base)) AS t FROM h q JOIN e g ON g.i = q.i JOIN b ON b.item = g.item GROUP BY q.item, g.item),
o AS (SELECT q, s, t FROM k WHERE q = item)
SELECT k.q AS item, (1 + count(*) FILTER (k.item <> k.q AND round(k.s, 9) > round(o.s, 9)))::BIGINT AS score, (1 + count(*) FILTER (k.item <> k.q AND round(k.s / k.t, 9) > round(o.s / o.t, 9)))::BIGINT AS share, (1 + count(*) FILTER (k.item <> k.q AND round(k.s - k.t, 9) > round(o.s - o.t, 9)))::BIGINT AS fit FROM k JOIN o USING (q) GROUP BY k.q""",
)
def q14_own_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Where each stated query's coarse prediction ranks its own data, by score, share and fit."""
    held = data(spark, d).select("item", F.concat("wx", "w", F.array("base", "saturation")).alias("vec"))
    models = vectors(spark, d).where(STATED).select("item", F.transform("vec", lambda x: F.floor(x * 4) / 4.0).alias("vec"))
    own = ranks.pair_scores(models.select("item", F.col("vec").alias("a")).join(held.select("item", F.col("vec").alias("b")), "item"), _three)
    found = ranks.own_ranks(models.join(own, "item"), held, _three)
    return found.select("item", *[F.col("ranks")[i].alias(n) for i, n in enumerate(("score", "share", "fit"))])


# ------------------------------------------------------------------ retrieval from partial data


def _total(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    return [sum(SCORE(a.reshape(len(a), SLOTS, CODES), b.reshape(len(b), SLOTS, CODES)))]


def hidden(rows: DataFrame, mode: str) -> DataFrame:
    """rows (item, vec) with a mode's distributions as they would be guessed without its data: the means over all rows."""
    first, width = MODES[mode]
    low, high = first * CODES, (first + width) * CODES
    means = rows.agg(F.array(*[F.avg(F.col("vec")[j]) for j in range(low, high)]).alias("m")).first()["m"] or []
    return rows.select("item", F.concat(F.slice("vec", 1, low), F.array(*[F.lit(float(x)) for x in means]).cast("array<double>"), F.slice("vec", high + 1, WIDTH - high)).alias("vec"))


_PARTIAL = """SELECT item, slot, code, CASE WHEN mode = '{0}' THEN avg(p) OVER (PARTITION BY slot, code) ELSE p END AS p FROM s"""
_RANKED = f"""{{0}}f AS ({_PARTIAL}), {{0}}x AS (SELECT q, item, sum(lo) AS t FROM (SELECT q.item AS q, g.item, ln(greatest(sum(q.p * g.p), {_FLOOR})) AS lo FROM {{0}}f q JOIN s g USING (slot, code) WHERE q.item % 20 = 0 GROUP BY q.item, g.item, slot) GROUP BY q, item),
{{0}}o AS (SELECT q, t FROM {{0}}x WHERE q = item), {{0}}r AS (SELECT '{{0}}' AS hidden, x.q AS item, 1 + count(*) FILTER (x.item <> x.q AND round(x.t, 9) > round(o.t, 9)) AS exact FROM {{0}}x x JOIN {{0}}o o USING (q) GROUP BY x.q),
{{0}}b AS (SELECT x.q AS item, 1 + count(*) FILTER (x.item <> x.q AND round(x.t, 9) > round(o.t, 9)) AS reverse FROM w x JOIN {{0}}o o USING (q) GROUP BY x.q)"""


@query(
    "q25_partial_retrieval",
    f"""WITH {_S}, w AS (SELECT q, item, sum(lo) AS t FROM (SELECT q.item AS q, g.item, ln(greatest(sum(q.p * g.p), {_FLOOR})) AS lo FROM s q JOIN s g USING (slot, code) WHERE q.item % 20 = 0 GROUP BY q.item, g.item, slot) GROUP BY q, item),
{_RANKED.format("image")}, {_RANKED.format("spectrum")}
SELECT hidden, item, exact::BIGINT AS exact, reverse::BIGINT AS reverse FROM imager JOIN imageb USING (item) UNION ALL SELECT hidden, item, exact::BIGINT, reverse::BIGINT FROM spectrumr JOIN spectrumb USING (item)""",
)
def q25_partial_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Where each stated query without a mode's data finds its source, and the source it: exact and reverse ranks.

    The reverse row is the source's own row of scores, in which its partial form takes the source's place.
    """
    whole = flat(spark, d).select("item", F.col("dist").alias("vec"))
    asked = whole.where(STATED)
    out = None
    for mode in ("image", "spectrum"):
        partial = hidden(whole, mode).where(STATED)
        own = ranks.pair_scores(partial.select("item", F.col("vec").alias("a")).join(asked.select("item", F.col("vec").alias("b")), "item"), _total)
        exact = ranks.own_ranks(partial.join(own, "item"), whole, _total).select("item", F.col("ranks")[0].alias("exact"))
        reverse = ranks.own_ranks(asked.join(own, "item"), whole, _total).select("item", F.col("ranks")[0].alias("reverse"))
        one = exact.join(reverse, "item").select(F.lit(mode).alias("hidden"), "item", "exact", "reverse")
        out = one if out is None else out.unionAll(one)
    return out


# ------------------------------------------------------------------ bases and probes


def kinds(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, str]]:
    """Vectors by label as kinds, three families of them."""
    rows = vectors(spark, d).select("item", F.col("label").cast("string").alias("kind"), "vec")
    return rows, {r["kind"]: str(int(r["kind"]) % 3) for r in rows.select("kind").where("kind is not null").distinct().collect()}


@query("b18_bases")
def b18_bases(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's coefficients on its kind's basis, whether that is its family's, and its place in a whitened space."""
    rows, family = kinds(spark, d)
    found = bases.bases(rows, family, WIDTH, 8)
    offset, projection = bases.whitening(rows, "vec", WIDTH, 4)
    shared = F.lit(False)
    for kind, b in found.items():
        shared = F.when(F.col("kind") == kind, b.shared).otherwise(shared)
    less = F.zip_with("vec", F.array(*[F.lit(float(x)) for x in offset]), lambda a, b: a - b)
    placed = bases.on_bases(rows, found).withColumn("white", bases.times(less, projection.T))
    rounded = lambda c: F.array_join(F.transform(c, lambda x: F.round(x, 4)), ",").alias(c)
    return placed.select("item", "kind", shared.alias("shared"), rounded("coefficients"), rounded("white"))


def _fold(item: Column) -> Column:
    return (F.pmod(F.xxhash64(item), F.lit(5))).cast("int").alias("fold")


@query("q15_stacked_probes")
def q15_stacked_probes(spark: SparkSession, d: str) -> DataFrame:
    """How well each mode's part of a vector and their stack predict a mean of three numbers, one of which isn't among them: R squared and weight (of the stack: its bias)."""
    v = vectors(spark, d).select("item", F.slice("vec", 1, WIDTH - 1).alias("vec"), (F.col("vec")[0] - F.col("vec")[33] / 2 + F.col("vec")[WIDTH - 1]).alias("y"), _fold(F.col("item")))
    blocks = {m: (first * CODES, min(width * CODES, WIDTH - 1 - first * CODES)) for m, (first, width) in MODES.items()}
    predicted, weights, scores = bases.stacked(v, "vec", "y", blocks)
    stats = predicted.agg(F.count("*").alias("n"), F.avg(F.col("y") - F.col("predicted")).alias("bias"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("block"), F.lit(round(s, 6)).alias("r2"), F.lit(round(weights.get(n, weights["bias"]), 6)).alias("weight")) for n, s in scores.items()])).alias("x")
    return stats.select(each, "n", _r("bias")).select("x.block", "x.r2", "x.weight", "n", "bias")
