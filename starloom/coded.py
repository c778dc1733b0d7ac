"""Queries on coded distributions, saliency at any position and selection rules, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators import coefficients, linear, records, saliency, similarity
from starloom.queries import _FLOOR, _S, _r, query
from starloom.searches import SLOTS, STATED, overlaps, packed
from starloom.sources.relations import CODES, MODES, vectors
from starloom.sources.shared import stored

#: Directions of the basis, and the least overlap: a tenth of an even distribution's share.
BASIS_RANK, BASIS_FLOOR = 5, 0.1 / CODES
FIRST, WIDTH = MODES["spectrum"]
BASIS = coefficients.cosines(CODES, BASIS_RANK)
#: The mean that goes with the fixed basis: an even distribution.
EVEN = np.full(CODES, 1.0 / CODES)


def spectra(spark: SparkSession, d: str) -> DataFrame:
    """(item, slot, dist) of the spectrum's slots."""
    one = F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.col("dist")[s].alias("dist")) for s in range(FIRST, FIRST + WIDTH)])).alias("x")
    return packed(spark, d).select("item", one).select("item", "x.*")


def coded_spectra(spark: SparkSession, d: str) -> DataFrame:
    return coefficients.coded(spectra(spark, d), "dist", EVEN, BASIS)


_B = "b AS (SELECT k, j, v FROM (VALUES " + ", ".join(f"({k}, {j}, {float(BASIS[k, j])!r}::DOUBLE)" for k in range(BASIS_RANK) for j in range(CODES)) + ") AS t(k, j, v))"
_CODED = f"""{_S}, {_B}, c AS (SELECT item, slot, k, sum((p - 0.125) * v) AS c FROM s JOIN b ON j = code WHERE mode = 'spectrum' GROUP BY item, slot, k),
m AS (SELECT item, slot, min(c) AS lo, (max(c) - min(c)) / 255 AS step FROM c GROUP BY item, slot),
z AS (SELECT c.item, c.slot, k, lo, step, floor((c - lo) / step + 0.5)::INT AS code, lo + step * floor((c - lo) / step + 0.5) AS back FROM c JOIN m USING (item, slot))"""


@query("v4_coefficients", f"WITH {_CODED} SELECT item, slot::INT AS slot, k::INT AS k, code, round(back, 6) AS back FROM z")
def v4_coefficients(spark: SparkSession, d: str) -> DataFrame:
    """The codes of each spectrum slot and the coefficients that they stand for."""
    rows = coded_spectra(spark, d).withColumn("back", coefficients.coefficients())
    each = rows.select("item", "slot", F.posexplode(F.arrays_zip("codes", "back")).alias("k", "x"))
    return each.select("item", F.col("slot").cast("int").alias("slot"), "k", F.col("x.codes").alias("code"), F.round("x.back", 6).alias("back"))


def tile_forms(gallery: DataFrame, queries: DataFrame, mean: np.ndarray, directions: np.ndarray) -> tuple[DataFrame, DataFrame, Callable[[np.ndarray, np.ndarray], np.ndarray]]:
    """Queries and gallery, both (item, slot, codes, step, offset), as (item, vec), and the scorer of their tiles.

    A gallery row keeps its codes, step and offset; a query its weights, base and their total. A tile multiplies the
    codes as they are, slot by slot, and adds up the logs of the overlaps.
    """
    rank = len(directions)
    side = lambda rows, one: rows.groupBy("item").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("slot", one.alias("x")))), lambda r: r["x"])).alias("vec"))
    held = side(gallery, F.concat(F.transform("codes", lambda k: k.cast("double")), F.array("step", "offset")))
    form = coefficients.query_form(coefficients.coefficients(), mean, directions)
    asked = side(queries.withColumn("f", form), F.concat(F.col("f.weights"), F.array("f.base", "f.total")))

    def score(q: np.ndarray, g: np.ndarray) -> np.ndarray:
        q, g = q.reshape(len(q), -1, rank + 2), g.reshape(len(g), -1, rank + 2)
        total = np.zeros((len(q), len(g)))
        for s in range(q.shape[1]):
            codes, step, offset = g[:, s, :rank], g[:, s, rank], g[:, s, rank + 1]
            total += np.log(np.maximum(q[:, s, rank, None] + q[:, s, rank + 1, None] * offset + step * (q[:, s, :rank] @ codes.T), BASIS_FLOOR))
        return total

    return asked, held, score


@query(
    "v5_spectrum_overlap",
    f"""WITH {_CODED}, f AS (SELECT item, slot, j, 0.125 + sum(back * v) AS p FROM z JOIN b USING (k) GROUP BY item, slot, j),
o AS (SELECT a.item AS q, g.item, slot, ln(greatest(sum(a.p * g.p), {BASIS_FLOOR!r})) AS lo FROM f a JOIN f g USING (slot, j) WHERE a.item % 20 = 0 AND g.item <> a.item GROUP BY a.item, g.item, slot),
t AS (SELECT q, item, sum(lo) AS total FROM o GROUP BY q, item), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(total, 9) DESC, item) AS rank FROM t)
SELECT q, item, round(total, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 10""",
)
def v5_spectrum_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The ten best items of each stated query by its spectrum slots, from codes; the SQL decodes both and multiplies them."""
    rows = coded_spectra(spark, d)
    asked, held, score = tile_forms(rows, rows.where(STATED), EVEN, BASIS)
    return linear.gram_top(asked, held, 10, score=score).select("q", "item", _r("score"), "rank")


@query("v29_decoded", f"WITH {_CODED} SELECT item, slot::INT AS slot, j::INT AS code, round(0.125 + sum(back * v), 6) AS p FROM z JOIN b USING (k) GROUP BY item, slot, j")
def v29_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Coded spectrum slots as whole distributions."""
    rows = coded_spectra(spark, d).withColumn("p", coefficients.decoded(coefficients.coefficients(), EVEN, BASIS))
    return rows.select("item", F.col("slot").cast("int").alias("slot"), F.posexplode("p").alias("code", "p")).select("item", "slot", "code", F.round("p", 6).alias("p"))


#: Slots that the saliency queries choose, and the modes that match at any position.
CHOSEN, ANYWHERE = {"image": [0, 1], "spectrum": [1]}, {"image"}


def _mixed_sql(x: str) -> str:
    """saliency.mixed in SQL, for an expression of type UBIGINT below 2 ** 32."""
    one = f"(xor({x}, {x} >> 16) * 2246822507) % 4294967296"
    return f"(SELECT xor(b, b >> 16) FROM (SELECT (xor(a, a >> 13) * 3266489909) % 4294967296 AS b FROM (SELECT {one} AS a)))"


#: The draw of each pair of a query and another item.
_DRAWS = f"""w AS (SELECT vec_id::UBIGINT AS item, {_mixed_sql("(vec_id::UBIGINT % 4294967296)")} AS h FROM embeddings),
d AS (SELECT q, item, {_mixed_sql("x")} AS draw FROM (SELECT q.item AS q, g.item, (q.h + g.item % 4294967296 * 2654435761 % 4294967296) % 4294967296 AS x FROM w q JOIN w g ON q.item % 20 = 0 AND g.item <> q.item))"""


@query("v19_sample", f"WITH {_DRAWS} SELECT q::BIGINT AS q, item::BIGINT AS item FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY draw, item) AS k FROM d) WHERE k <= 64")
def v19_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sample of other items that each stated query's saliency would look at, at a size of 64."""
    items = vectors(spark, d).select("item")
    return saliency.sampled(items, items.where(STATED), 64)


def any_place(pairs: DataFrame, anywhere: set[str]) -> DataFrame:
    """(q, item, values) of rows (q, q_dist, item, dist): each query slot's log overlap, with the best slot of its mode where that may be any."""
    parts = []
    for mode, (first, width) in MODES.items():
        for s in range(first, first + width):
            dots = [similarity.dot(F.col("dist")[g], F.col("q_dist")[s]) for g in (range(first, first + width) if mode in anywhere else [s])]
            parts.append(F.log(F.greatest(F.lit(similarity.FLOOR), *dots)))
    return pairs.select("q", "item", F.array(*parts).alias("values"))


@query(
    "v19_anywhere_saliency",
    f"""WITH {_S}, {_DRAWS}, k AS (SELECT q, item FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY draw, item) AS k FROM d) WHERE k <= {saliency.SAMPLE}),
o AS (SELECT k.q, k.item, a.slot, b.slot AS at, a.mode, ln(greatest(sum(a.p * b.p), {_FLOOR})) AS lo FROM k JOIN s a ON a.item = k.q JOIN s b ON b.item = k.item AND b.mode = a.mode AND b.code = a.code WHERE a.mode = 'image' OR a.slot = b.slot GROUP BY ALL),
u AS (SELECT q, item, slot, max(lo) AS v FROM o GROUP BY q, item, slot), t AS (SELECT q, item, sum(CASE WHEN slot IN (0, 1, 5) THEN v ELSE 0 END) AS score, sum(CASE WHEN slot NOT IN (0, 1, 5) THEN v ELSE 0 END) / 5 AS control FROM u GROUP BY q, item),
c AS (SELECT q, slot, corr(v, score) AS a, corr(v, control) AS b, corr(score, control) AS c FROM u JOIN t USING (q, item) GROUP BY q, slot)
SELECT q::BIGINT AS q, slot, round(greatest(-1, least(1, coalesce(CASE WHEN (1 - b * b) * (1 - c * c) > 1e-24 THEN (a - b * c) / sqrt((1 - b * b) * (1 - c * c)) END, 0))), 5) AS rho FROM c""",
)
def v19_anywhere_saliency(spark: SparkSession, d: str) -> DataFrame:
    """Which slots drive each stated query's similarity when its image may match at any position."""
    chosen = [s for _, s in similarity.checked(CHOSEN, MODES, ANYWHERE)]
    gallery = packed(spark, d)
    sample = saliency.sampled(gallery.select("item"), gallery.where(STATED).select("item"))
    queries = gallery.select(F.col("item").alias("q"), F.col("dist").alias("q_dist"))
    values = any_place(sample.join(gallery, "item").join(queries, "q"), ANYWHERE)
    return saliency.slot_correlations(values, chosen, SLOTS).select("q", "slot", _r("rho", 5))


@query(
    "p15_selection_rules",
    """SELECT vec_id AS item, CASE WHEN vec_id % 5 = 0 AND vec_id % 7 = 0 THEN 'image,spectrum' WHEN vec_id % 5 = 0 THEN 'spectrum' WHEN vec_id % 7 = 0 THEN 'image' ELSE '' END AS missing FROM embeddings""",
)
def p15_selection_rules(spark: SparkSession, d: str) -> DataFrame:
    """What each item lacks of the modes that a query selects: those with something missing may not ask."""
    items = vectors(spark, d).select("item")
    seen = items.select("item", F.explode(F.array(F.when(F.col("item") % 7 != 0, "image"), F.when(F.col("item") % 5 != 0, "spectrum"))).alias("mode")).where("mode is not null")
    return similarity.missing(items, seen, CHOSEN).select("item", F.array_join("missing", ",").alias("missing"))


# ------------------------------------------------------------------ records

LAYOUT = records.Layout(MODES, CODES, 4, EVEN, BASIS, BASIS_FLOOR)
#: Image slots of records in SQL: four codes and an even rest; spectrum slots decoded; table slots as they are.
_FORMS = f"""{_CODED}, i AS (SELECT item, slot, code, p, row_number() OVER (PARTITION BY item, slot ORDER BY round(p, 12) DESC, code) AS k FROM s WHERE mode = 'image'),
f AS (SELECT item, slot, code, CASE WHEN k <= 4 THEN p ELSE (1 - sum(CASE WHEN k <= 4 THEN p END) OVER (PARTITION BY item, slot)) / 4 END AS p, {_FLOOR} AS least FROM i
UNION ALL SELECT item, slot, j, 0.125 + sum(back * v), {BASIS_FLOOR!r} FROM z JOIN b USING (k) GROUP BY item, slot, j UNION ALL SELECT item, slot, code, p, {_FLOOR} FROM s WHERE mode = 'table')"""


@query(
    "b6_records",
    f"""WITH {_S}, i AS (SELECT item, slot, code, p, row_number() OVER (PARTITION BY item, slot ORDER BY round(p, 12) DESC, code) AS k FROM s WHERE mode = 'image')
SELECT item, slot::INT AS slot, string_agg(code::VARCHAR, ',' ORDER BY k) FILTER (k <= 4) AS codes, round(1 - sum(p) FILTER (k <= 4), 6) AS rest FROM i GROUP BY item, slot""",
)
def b6_records(spark: SparkSession, d: str) -> DataFrame:
    """The image part of each item's record: the codes that it keeps and the share of the others."""
    rows = records.recorded(packed(spark, d), LAYOUT)
    each = rows.select("item", F.posexplode(F.arrays_zip("image_codes", "image_rest")).alias("slot", "x"))
    return each.select("item", "slot", F.array_join("x.image_codes", ",").alias("codes"), F.round("x.image_rest", 6).alias("rest"))


@query(
    "b22_record_scores",
    f"""WITH {_FORMS}, o AS (SELECT a.item AS q, g.item, slot, ln(greatest(sum(a.p * g.p), max(g.least))) AS lo FROM f a JOIN f g USING (slot, code) WHERE a.item % 20 = 0 AND g.item <> a.item GROUP BY a.item, g.item, slot),
t AS (SELECT q, item, sum(lo) AS total FROM o GROUP BY q, item), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(total, 9) DESC, item) AS rank FROM t)
SELECT q, item, round(total, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 10""",
)
def b22_record_scores(spark: SparkSession, d: str) -> DataFrame:
    """The ten best items of each stated query from records alone, through the forms that tiles multiply."""
    rows = stored(records.packed(records.recorded(packed(spark, d), LAYOUT)))
    return linear.gram_top(rows.where(STATED), rows, 10, score=records.record_scores(LAYOUT, list(MODES))).select("q", "item", _r("score"), "rank")


@query("b13_properties")
def b13_properties(spark: SparkSession, d: str) -> DataFrame:
    """Three properties of each item as measured, where they are, and as predicted, with a width."""
    v, x = vectors(spark, d), F.col("vec")
    rows = v.select("item", F.slice("vec", 1, 48).alias("vec"), F.pmod(F.xxhash64("item"), F.lit(5)).alias("fold"), *[F.when(F.col("item") % k != 0, y).alias(n) for n, k, y in (("mass", 3, x[0] + x[50]), ("rate", 4, x[20] - x[40] / 2), ("age", 1, x[3]))])
    found = records.properties(rows, "vec", 48, {n: F.col(n) for n in ("mass", "rate", "age")})
    return found.select("item", "property", _r("measured", 4), _r("predicted", 4), _r("width", 4))
