"""Registered queries of the observatory and their DuckDB SQL, by inventory name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.operators import linear, maps, precision, ranks, saliency, similarity, statistics
from starloom.sources.relations import CODES, MODES, mode_of, packed, points, positions, sequences, slots, table, vectors
from starloom.sources.shared import stored

SLOTS = sum(width for _, width in MODES.values())

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Common parts of the SQL: vectors, slot distributions, points.
_V = "v AS (SELECT vec_id AS item, embedding::DOUBLE[] AS vec, label FROM embeddings)"
_S = f"""{_V}, e AS (SELECT item, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS i FROM v),
s AS (SELECT item, (i // 8)::INT AS slot, (i % 8)::INT AS code, CASE WHEN i // 8 < 4 THEN 'image' WHEN i // 8 < 6 THEN 'spectrum' ELSE 'table' END AS mode,
  exp(4 * x) / sum(exp(4 * x)) OVER (PARTITION BY item, i // 8) AS p FROM e)"""
_P = f"{_V}, pt AS (SELECT item, vec[1] AS x, vec[2] AS y, label AS category FROM v)"
_FLOOR = "1.17549435e-38"
_LO = f"{_S}, lo AS (SELECT g.item, g.mode, g.slot, ln(greatest(sum(g.p * q.p), {_FLOOR})) AS lo FROM s g JOIN s q ON q.item = 7 AND q.slot = g.slot AND q.code = g.code GROUP BY g.item, g.mode, g.slot)"


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _one(spark: SparkSession, d: str, item: int = 7) -> DataFrame:
    return slots(spark, d).where(F.col("item") == item)


def _same(spark: SparkSession, d: str, item: int = 7) -> DataFrame:
    return similarity.same_place(slots(spark, d), _one(spark, d, item).select("slot", "code", F.col("p").alias("q")))


def _beside(spark: SparkSession, d: str, item: int = 7) -> DataFrame:
    """(item, dist, q_dist): every item beside the one that asks."""
    gallery = packed(spark, d)
    return gallery.crossJoin(F.broadcast(gallery.where(F.col("item") == item).select(F.col("dist").alias("q_dist"))))


def _r(c: str, n: int = 6) -> F.Column:
    return F.round(F.col(c), n).alias(c)


_CHOSEN = {"image": [0, 1, 1], "spectrum": [1]}


@query(
    "v16_slot_search",
    f"""WITH {_LO}, t AS (SELECT item, mode, sum(lo) AS total FROM lo WHERE slot IN (0, 1, 5) GROUP BY item, mode),
z AS (SELECT item, (total - avg(total) OVER (PARTITION BY mode)) / stddev_pop(total) OVER (PARTITION BY mode) / 2 AS z FROM t),
c AS (SELECT item, sum(z) AS score FROM z GROUP BY item),
r AS (SELECT item, score, row_number() OVER (ORDER BY round(score, 9) DESC, item) AS rank FROM c WHERE item <> 7)
SELECT item, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 10 UNION ALL SELECT item, round(score, 6), 0 FROM c WHERE item = 7""",
)
def v16_slot_search(spark: SparkSession, d: str) -> DataFrame:
    chosen: dict[str, list[int]] = {}
    for mode, slot in similarity.validated(_CHOSEN, MODES):
        chosen.setdefault(mode, []).append(slot)
    parts = similarity.contributions(similarity.mode_scores(_beside(spark, d), chosen).select("item", *chosen), list(chosen))
    scores = parts.select("item", sum((F.coalesce(F.col(m), F.lit(0.0)) for m in chosen), F.lit(0.0)).alias("score"))
    return similarity.ranked(scores, 7, 10).select("item", _r("score"), "rank")


@query("v8_mode_totals", f"WITH {_LO} SELECT item, mode, round(sum(lo), 6) AS total FROM lo GROUP BY item, mode")
def v8_mode_totals(spark: SparkSession, d: str) -> DataFrame:
    return similarity.totals(_same(spark, d)).select("item", "mode", _r("total"))


@query(
    "v10_one_mode_search",
    f"""WITH {_LO}, c AS (SELECT item, sum(lo) AS score FROM lo WHERE mode = 'image' GROUP BY item),
r AS (SELECT item, score, row_number() OVER (ORDER BY round(score, 9) DESC, item) AS rank FROM c WHERE item <> 7)
SELECT item, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 10 UNION ALL SELECT item, round(score, 6), 0 FROM c WHERE item = 7""",
)
def v10_one_mode_search(spark: SparkSession, d: str) -> DataFrame:
    rows = similarity.totals(_same(spark, d).where("mode = 'image'"))
    return similarity.ranked(similarity.combined(rows), 7, 10).select("item", _r("score"), "rank")


@query(
    "v9_any_position",
    f"""WITH {_S}, o AS (SELECT g.item, g.mode, q.slot AS q_slot, g.slot, sum(g.p * q.p) AS o FROM s g JOIN s q ON q.item = 7 AND q.mode = g.mode AND q.code = g.code GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY item, q_slot ORDER BY round(o, 12) DESC, slot) AS k FROM o)
SELECT item, mode, q_slot, round(ln(greatest(o, {_FLOOR})), 6) AS lo, slot AS at FROM b WHERE k = 1""",
)
def v9_any_position(spark: SparkSession, d: str) -> DataFrame:
    one = _one(spark, d).select("mode", F.col("slot").alias("q_slot"), "code", F.col("p").alias("q"))
    return similarity.any_place(slots(spark, d), one).select("item", "mode", "q_slot", _r("lo"), "at")


@query(
    "v13_similarity",
    f"""WITH {_LO}, pk AS (SELECT slot, ln(max(p)) AS peak FROM s WHERE item = 7 GROUP BY slot), t AS (SELECT item, mode, sum(lo) AS total, sum(lo - peak) / count(*) AS share FROM lo JOIN pk USING (slot) GROUP BY item, mode),
w AS (SELECT mode, 1 / stddev_pop(total) AS w FROM t GROUP BY mode)
SELECT item, round(exp(sum(share * w) / sum(w)), 6) AS similarity FROM t JOIN w USING (mode) GROUP BY item""",
)
def v13_similarity(spark: SparkSession, d: str) -> DataFrame:
    peaks = _one(spark, d).groupBy("slot").agg(F.log(F.max("p")).alias("peak"))
    rows = _same(spark, d).join(F.broadcast(peaks), "slot").groupBy("item", "mode").agg(F.sum("lo").alias("total"), F.avg(F.col("lo") - F.col("peak")).alias("share"))
    weights = rows.groupBy("mode").agg((1 / F.stddev_pop("total")).alias("w"))
    return rows.join(F.broadcast(weights), "mode").groupBy("item").agg(F.round(F.exp(F.sum(F.col("share") * F.col("w")) / F.sum("w")), 6).alias("similarity"))


@query(
    "v14_agreement_maps",
    f"""WITH {_LO}, pk AS (SELECT slot, ln(max(p)) AS peak FROM s WHERE item = 7 GROUP BY slot), t AS (SELECT item, sum(lo) AS score FROM lo GROUP BY item),
b AS (SELECT item FROM t WHERE item <> 7 ORDER BY round(score, 9) DESC, item LIMIT 8)
SELECT item, mode, slot, round(exp(lo - peak), 6) AS agreement FROM lo JOIN pk USING (slot) WHERE item IN (SELECT item FROM b) OR item = 7""",
)
def v14_agreement_maps(spark: SparkSession, d: str) -> DataFrame:
    scores = similarity.mode_scores(_beside(spark, d), {"score": list(range(SLOTS))})
    best = similarity.ranked(scores, 7, 8)
    each = [F.struct(mode_of(F.lit(s)).alias("mode"), F.lit(s).alias("slot"), F.round(F.exp(similarity.log_dot(F.col("dist")[s], F.col("q_dist")[s]) - F.log(F.array_max(F.col("q_dist")[s]))), 6).alias("agreement")) for s in range(SLOTS)]
    return best.select("item", F.explode(F.array(*each)).alias("x")).select("item", "x.*")


@query(
    "v18_self_cosines",
    f"""WITH {_S}, n AS (SELECT slot, sqrt(sum(p * p)) AS n FROM s WHERE item = 7 GROUP BY slot)
SELECT a.mode, a.slot, b.slot AS other, round(sum(a.p * b.p) / max(x.n) / max(y.n), 6) AS cosine FROM s a JOIN s b ON a.mode = b.mode AND a.code = b.code JOIN n x ON x.slot = a.slot JOIN n y ON y.slot = b.slot WHERE a.item = 7 AND b.item = 7 GROUP BY a.mode, a.slot, b.slot""",
)
def v18_self_cosines(spark: SparkSession, d: str) -> DataFrame:
    one = _one(spark, d)
    norm = F.sqrt(F.sum(F.col("p") * F.col("p")).over(Window.partitionBy("slot")))
    a = one.withColumn("u", F.col("p") / norm).select("mode", "code", "slot", "u")
    b = a.select("mode", "code", F.col("slot").alias("other"), F.col("u").alias("w"))
    return a.join(b, ["mode", "code"]).groupBy("mode", "slot", "other").agg(F.round(F.sum(F.col("u") * F.col("w")), 6).alias("cosine"))


@query(
    "v19_saliency",
    f"""WITH {_LO}, r AS (SELECT item, slot, lo, coalesce((lo - avg(lo) OVER w) / nullif(stddev_pop(lo) OVER w, 0), 0) AS z FROM lo WHERE item <> 7 WINDOW w AS (PARTITION BY slot)),
i AS (SELECT item, avg(z) AS score, avg(lo) AS control FROM r GROUP BY item), c AS (SELECT slot, corr(z, score) AS a, corr(z, control) AS b, corr(score, control) AS c FROM r JOIN i USING (item) GROUP BY slot)
SELECT slot, round(greatest(-1, least(1, coalesce(CASE WHEN (1 - b * b) * (1 - c * c) > 1e-24 THEN (a - b * c) / sqrt((1 - b * b) * (1 - c * c)) END, 0))), 5) AS rho FROM c""",
)
def v19_saliency(spark: SparkSession, d: str) -> DataFrame:
    return saliency.partial_correlations(_same(spark, d), 7).select("slot", _r("rho", 5))


@query(
    "v17_mode_search",
    f"""WITH {_LO}, t AS (SELECT item, mode, sum(lo) AS total FROM lo GROUP BY item, mode), z AS (SELECT item, mode, (total - avg(total) OVER w) / stddev_pop(total) OVER w / 3 AS c FROM t WINDOW w AS (PARTITION BY mode))
SELECT item, mode, round(c, 6) AS contribution, round(sum(c) OVER (PARTITION BY item), 6) AS score FROM z""",
)
def v17_mode_search(spark: SparkSession, d: str) -> DataFrame:
    every = {mode: list(range(first, first + width)) for mode, (first, width) in MODES.items()}
    parts = similarity.contributions(similarity.mode_scores(_beside(spark, d), every).select("item", *every), list(every))
    each = F.array(*[F.struct(F.lit(m).alias("mode"), F.round(m, 6).alias("contribution")) for m in every])
    total = F.round(sum((F.coalesce(F.col(m), F.lit(0.0)) for m in every), F.lit(0.0)), 6).alias("score")
    return parts.select("item", F.explode(each).alias("x"), total).select("item", "x.mode", "x.contribution", "score")


@query(
    "v22_cosine_rank",
    f"""WITH {_V}, c AS (SELECT g.item, list_inner_product(g.vec, q.vec) / sqrt(list_inner_product(g.vec, g.vec)) / sqrt(list_inner_product(q.vec, q.vec)) AS score FROM v g, v q WHERE q.item = 3 AND g.item <> 3)
SELECT item, round(score, 6) AS score FROM c ORDER BY round(score, 9) DESC, item LIMIT 20""",
)
def v22_cosine_rank(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    q = v.where("item = 3").select(F.col("vec").alias("q_vec"))
    score = similarity.dot(F.col("vec"), F.col("q_vec")) / F.sqrt(similarity.dot(F.col("vec"), F.col("vec"))) / F.sqrt(similarity.dot(F.col("q_vec"), F.col("q_vec")))
    return v.where("item <> 3").crossJoin(F.broadcast(q)).select("item", score.alias("score")).orderBy(F.desc(F.round("score", 9)), "item").limit(20).select("item", _r("score"))


@query(
    "v23_euclidean_knn",
    f"""WITH {_V}, e AS (SELECT item, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM v),
k AS (SELECT a.item AS q, b.item, -sqrt(sum((a.x - b.x) * (a.x - b.x))) AS score FROM e a JOIN e b ON a.i = b.i AND a.item <> b.item WHERE a.item % 20 = 0 GROUP BY a.item, b.item),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, item) AS rank FROM k) SELECT q, item, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 10""",
)
def v23_euclidean_knn(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).select("item", "vec")
    return linear.nearest(v.where("item % 20 = 0"), v, 10).select("q", "item", _r("score"), "rank")


@query(
    "q1_neighbour_preservation",
    f"""WITH {_V}, e AS (SELECT item, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM v), k AS (SELECT a.item AS q, b.item, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS f, sqrt(sum(CASE WHEN a.i <= 2 THEN (a.x - b.x) * (a.x - b.x) ELSE 0 END)) AS m FROM e a JOIN e b ON a.i = b.i AND a.item <> b.item WHERE a.item % 20 = 0 GROUP BY a.item, b.item),
r AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY round(f, 9), item) AS rf, row_number() OVER (PARTITION BY q ORDER BY round(m, 9), item) AS rm FROM k)
SELECT q, round(sum(CASE WHEN rf <= 15 AND rm <= 15 THEN 1 ELSE 0 END) / 15.0, 6)::DOUBLE AS kept, sum(CASE WHEN rm <= 15 AND rf > 15 THEN rf - 15 ELSE 0 END)::BIGINT AS penalty FROM r GROUP BY q""",
)
def q1_neighbour_preservation(spark: SparkSession, d: str) -> DataFrame:
    """Of the 15 nearest on the map, those among the 15 nearest of all; the others' ranks there, counted in tiles, beyond 15."""
    v = vectors(spark, d).select("item", "vec")
    q = v.where("item % 20 = 0")
    flat = v.select("item", F.slice("vec", 1, 2).alias("vec"))
    near = stored(linear.nearest(flat.where("item % 20 = 0"), flat, 15).select("q", "item"))
    ranked = near.join(ranks.distance_ranks(q, v, near), ["q", "item"])
    # a query with another item has a row, whose 15 nearest by either are as many
    both, far = F.col("place") <= 15, F.col("place") > 15
    return ranked.groupBy("q").agg(F.round(F.sum(F.when(both, 1).otherwise(0)) / 15.0, 6).alias("kept"), F.sum(F.when(far, F.col("place") - 15).otherwise(0)).alias("penalty"))


@query("a1_value_summary", "SELECT quantile_cont(p_retailprice, 0.01) AS low, quantile_cont(p_retailprice, 0.99) AS high, min(p_retailprice) AS least, max(p_retailprice) AS most FROM part")
def a1_value_summary(spark: SparkSession, d: str) -> DataFrame:
    v = "p_retailprice"
    part = table(spark, d, "part")
    low, high = statistics.quantiles(part, v, [0.01, 0.99])
    return part.agg(F.lit(low).alias("low"), F.lit(high).alias("high"), F.min(v).alias("least"), F.max(v).alias("most"))


@query(
    "f3_color_bins",
    """WITH r AS (SELECT p_partkey AS item, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN p_size * 40.0 ELSE p_retailprice END AS value, p_partkey % 7 = 0 AS predicted FROM part),
s AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM r)
SELECT item, CASE WHEN value IS NULL THEN 64 ELSE least(31, greatest(0, floor((value - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 32))) + CASE WHEN predicted THEN 32 ELSE 0 END END::INT AS color FROM r, s""",
)
def f3_color_bins(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    rows = table(spark, d, "part").select(key.alias("item"), F.when(key % 11 == 0, None).when(key % 7 == 0, F.col("p_size") * 40.0).otherwise(F.col("p_retailprice")).alias("value"), (key % 7 == 0).alias("predicted"))
    low, high = map(F.lit, statistics.quantiles(rows, "value", [0.01, 0.99]))
    return rows.select("item", maps.color(F.col("value"), low, high, F.col("predicted")).alias("color"))


@query("j2_points_left_join", f"WITH {_P} SELECT item, round(x, 6) AS x, round(y, 6) AS y, p_retailprice AS value FROM pt LEFT JOIN part ON p_partkey = item * 7")
def j2_points_left_join(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("value"))
    return points(spark, d).join(part, F.col("item") * 7 == F.col("p_partkey"), "left").select("item", _r("x"), _r("y"), "value")


_POLYGON = [(-0.12, -0.1), (0.15, -0.14), (0.1, 0.12), (0.0, 0.02), (-0.1, 0.13)]
_CROSS = " + ".join(f"CASE WHEN ({ay} > y) <> ({by} > y) AND x < (y - {ay}) * ({(bx - ax) / (by - ay)!r}) + {ax} THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in zip(_POLYGON, _POLYGON[1:] + _POLYGON[:1], strict=True)).replace("- -", "+ ")


@query("p4_lasso", f"WITH {_P} SELECT item, category FROM pt WHERE x BETWEEN -0.12 AND 0.15 AND y BETWEEN -0.14 AND 0.13 AND ({_CROSS}) % 2 = 1")
def p4_lasso(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).where(maps.lasso(F.col("x"), F.col("y"), _POLYGON)).select("item", "category")


@query("p3_box_and_range", f"WITH {_P} SELECT item FROM pt WHERE x BETWEEN -0.1 AND 0.1 AND y BETWEEN 0 AND 0.2 AND category BETWEEN 2 AND 6")
def p3_box_and_range(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).where(F.col("x").between(-0.1, 0.1) & F.col("y").between(0, 0.2) & F.col("category").between(2, 6)).select("item")


@query(
    "j4_crossmatch",
    f"""WITH {_V}, p AS (SELECT item, vec[1] + 150 AS ra, vec[2] + 2 AS dec FROM v), m AS (SELECT a.item, b.item AS match, degrees(2 * asin(sqrt(pow(sin(radians(b.dec - a.dec) / 2), 2) + cos(radians(a.dec)) * cos(radians(b.dec)) * pow(sin(radians(b.ra - a.ra) / 2), 2)))) AS sep FROM p a JOIN p b ON a.item % 2 = 0 AND b.item % 2 = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY round(sep, 12), match) AS k FROM m WHERE sep <= 0.02)
SELECT p.item, coalesce(k.match, -1)::BIGINT AS match, round(k.sep, 6) AS separation FROM p LEFT JOIN k ON k.item = p.item AND k.k = 1 WHERE p.item % 2 = 0""",
)
def j4_crossmatch(spark: SparkSession, d: str) -> DataFrame:
    p = positions(spark, d)
    return maps.crossmatch(p.where("item % 2 = 0"), p.where("item % 2 = 1"), 0.02).select("item", F.coalesce("match", F.lit(-1)).cast("long").alias("match"), _r("separation"))


@query(
    "w4_quantile_code",
    f"WITH {_S}, u AS (SELECT item, slot, sum(p) OVER (PARTITION BY item, slot ORDER BY code) AS upto FROM s) SELECT item, slot, sum(CASE WHEN round(upto, 9) < 0.5 THEN 1 ELSE 0 END)::INT AS code FROM u GROUP BY item, slot",
)
def w4_quantile_code(spark: SparkSession, d: str) -> DataFrame:
    return statistics.quantile_code(slots(spark, d), 0.5)


@query("w7_average_rank", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS place FROM part")
def w7_average_rank(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", statistics.average_rank("p_size", ["p_brand"]).alias("place"))


@query(
    "w8_spearman",
    "WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS a, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS b FROM part) SELECT p_brand, round(corr(a, b), 6) AS rho FROM r GROUP BY p_brand",
)
def w8_spearman(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "part").select("p_brand", statistics.average_rank("p_size", ["p_brand"]).alias("a"), statistics.average_rank("p_retailprice", ["p_brand"]).alias("b"))
    return r.groupBy("p_brand").agg(F.round(F.corr("a", "b"), 6).alias("rho"))


@query(
    "w9_islands",
    "WITH r AS (SELECT DISTINCT l_suppkey AS series, l_orderkey AS k FROM lineitem), g AS (SELECT series, k, k - row_number() OVER (PARTITION BY series ORDER BY k) AS run FROM r) SELECT series, min(k) AS first, max(k) AS last, count(*) AS n FROM g GROUP BY series, run",
)
def w9_islands(spark: SparkSession, d: str) -> DataFrame:
    return statistics.islands(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("series"), F.col("l_orderkey").alias("at")), ["series"], "at")


@query(
    "a12_nmad",
    "WITH m AS (SELECT p_brand, quantile_cont(p_retailprice, 0.5) AS m FROM part GROUP BY p_brand) SELECT p_brand, round(1.4826 * quantile_cont(abs(p_retailprice - m), 0.5), 6) AS nmad FROM part JOIN m USING (p_brand) GROUP BY p_brand",
)
def a12_nmad(spark: SparkSession, d: str) -> DataFrame:
    return statistics.nmad(table(spark, d, "part"), "p_retailprice", ["p_brand"]).select("p_brand", _r("nmad"))


@query(
    "a13_token_rank",
    "WITH c AS (SELECT p_brand, p_size AS token, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY ALL) SELECT p_brand, token, n, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, first)::INT AS place FROM c",
)
def a13_token_rank(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "part").groupBy("p_brand", F.col("p_size").alias("token")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    return c.select("p_brand", "token", "n", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("n"), "first")).alias("place"))


@query(
    "a18_weighted_profile",
    "SELECT l_suppkey % 4 AS part, floor(l_quantity / 5)::BIGINT AS bin, round(sum(l_extendedprice / l_quantity * (1 - l_discount)) / sum(1 - l_discount), 6) AS mean, count(*) AS n FROM lineitem GROUP BY ALL",
)
def a18_weighted_profile(spark: SparkSession, d: str) -> DataFrame:
    w = 1 - F.col("l_discount")
    value = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("part"), F.floor(F.col("l_quantity") / 5).alias("bin")).agg(F.round(F.sum(value * w) / F.sum(w), 6).alias("mean"), F.count("*").alias("n"))


@query(
    "a19_quartile_split",
    "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders) SELECT CASE WHEN o_totalprice <= a THEN 1 WHEN o_totalprice <= b THEN 2 WHEN o_totalprice <= c THEN 3 ELSE 4 END AS quartile, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders, q GROUP BY 1",
)
def a19_quartile_split(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("o_totalprice")
    orders = table(spark, d, "orders")
    a, b, c = map(F.lit, statistics.quantiles(orders, "o_totalprice", [0.25, 0.5, 0.75]))
    quartile = F.when(v <= a, 1).when(v <= b, 2).when(v <= c, 3).otherwise(4)
    return orders.groupBy(quartile.alias("quartile")).agg(F.count("*").alias("n"), F.round(F.avg(v), 4).alias("mean"))


@query("a11_lower_median", f"WITH {_V}, e AS (SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM v) SELECT label, i::INT AS i, round(quantile_disc(x, 0.5), 6) AS middle FROM e GROUP BY label, i")
def a11_lower_median(spark: SparkSession, d: str) -> DataFrame:
    e = vectors(spark, d).select("label", F.posexplode("vec").alias("i", "x"))
    return e.groupBy("label", (F.col("i") + 1).alias("i")).agg(F.round(F.expr("percentile_disc(0.5) within group (order by x)"), 6).alias("middle"))


@query(
    "a10_double_centred",
    f"WITH {_S}, g AS (SELECT item, slot, sum(p * p) AS x FROM s GROUP BY item, slot) SELECT item, slot, round(x - avg(x) OVER (PARTITION BY item) - avg(x) OVER (PARTITION BY slot) + avg(x) OVER (), 6) AS x FROM g",
)
def a10_double_centred(spark: SparkSession, d: str) -> DataFrame:
    g = slots(spark, d).groupBy("item", "slot").agg(F.sum(F.col("p") * F.col("p")).alias("x"))
    by = g.groupBy("slot").agg(F.avg("x").alias("m"))
    every = g.agg(F.avg("x").alias("all"))
    w = Window.partitionBy("item")
    return g.join(F.broadcast(by), "slot").crossJoin(F.broadcast(every)).select("item", "slot", F.round(F.col("x") - F.avg("x").over(w) - F.col("m") + F.col("all"), 6).alias("x"))


@query(
    "t3_top_codes",
    f"WITH {_S}, k AS (SELECT item, slot, code, p, row_number() OVER (PARTITION BY item, slot ORDER BY round(p, 12) DESC, code) AS k FROM s) SELECT item, slot, string_agg(code::VARCHAR, ',' ORDER BY k) FILTER (k <= 3) AS codes, round(sum(p) FILTER (k > 3), 6) AS rest FROM k GROUP BY item, slot",
)
def t3_top_codes(spark: SparkSession, d: str) -> DataFrame:
    s = slots(spark, d).groupBy("item", "slot").agg(F.array_sort(F.collect_list(F.struct((-F.round("p", 12)).alias("o"), "code", "p"))).alias("c"))
    top, rest = F.slice("c", 1, 3), F.slice("c", 4, 100)
    return s.select("item", "slot", F.array_join(F.transform(top, lambda x: x["code"].cast("string")), ",").alias("codes"), F.round(F.aggregate(rest, F.lit(0.0), lambda a, x: a + x["p"]), 6).alias("rest"))


@query(
    "t5_sample",
    "SELECT o_orderkey FROM orders ORDER BY ((o_orderkey + 42) * 2654435761) % 4294967296, o_orderkey LIMIT 500",
)
def t5_sample(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy(statistics.hashed(F.col("o_orderkey"), 42), "o_orderkey").limit(500).select("o_orderkey")


@query(
    "t7_split",
    "SELECT ((o_orderkey + 7) * 2654435761) % 4294967296 / 4294967296.0 < 0.3 AS test, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1",
)
def t7_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy((statistics.hashed(F.col("o_orderkey"), 7) < 0.3).alias("test")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query(
    "u4_set_operations",
    "WITH a AS (SELECT DISTINCT o_custkey k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey k FROM orders WHERE o_orderstatus = 'O') SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'a' WHEN a.k IS NULL THEN 'b' ELSE 'both' END AS side FROM a FULL JOIN b ON a.k = b.k",
)
def u4_set_operations(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    a, b = (o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in "FO")
    only = lambda x, y, n: x.subtract(y).withColumn("side", F.lit(n))
    return only(a, b, "a").unionByName(only(b, a, "b")).unionByName(a.intersect(b).withColumn("side", F.lit("both")))


@query("j6_semi_and_anti", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AS held FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def j6_semi_and_anti(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    rich = o.where("o_totalprice > 300000").select(F.col("o_custkey").alias("k")).distinct().withColumn("r", F.lit(True))
    rest = table(spark, d, "customer").select("c_custkey").join(o.where(F.col("o_orderpriority").startswith("1")), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return rest.join(rich, F.col("c_custkey") == F.col("k"), "left").select("c_custkey", F.coalesce("r", F.lit(False)).alias("held"))


@query(
    "p9_unpivot",
    "SELECT p_partkey AS item, 'p_size' AS name, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part",
)
def p9_unpivot(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return rows.unpivot("item", ["p_size", "p_retailprice"], "name", "value")


@query(
    "p12_first_usable",
    "SELECT p_partkey AS item, CASE WHEN p_size % 3 <> 0 AND p_size <= 40 THEN p_size::DOUBLE WHEN p_retailprice <= 1500 THEN p_retailprice END AS value, CASE WHEN p_size % 3 <> 0 AND p_size <= 40 THEN 'size' WHEN p_retailprice <= 1500 THEN 'price' END AS source FROM part",
)
def p12_first_usable(spark: SparkSession, d: str) -> DataFrame:
    pair = lambda v, n: F.struct(v.cast("double").alias("value"), F.lit(n).alias("source"))
    size, price = F.col("p_size"), F.col("p_retailprice")
    first = F.coalesce(F.when((size % 3 != 0) & (size <= 40), pair(size, "size")), F.when(price <= 1500, pair(price, "price")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("item"), first.alias("f")).select("item", "f.value", "f.source")


@query(
    "p7_missing_modes",
    "SELECT c_custkey AS item, concat_ws(',', CASE WHEN c_custkey % 2 <> 0 THEN 'image' END, CASE WHEN c_custkey % 3 <> 0 THEN 'spectrum' END, CASE WHEN c_acctbal < 0 THEN 'table' END) AS missing FROM customer",
)
def p7_missing_modes(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    names = F.array(F.when(key % 2 != 0, "image"), F.when(key % 3 != 0, "spectrum"), F.when(F.col("c_acctbal") < 0, "table"))
    return table(spark, d, "customer").select(key.alias("item"), F.array_join(F.filter(names, lambda x: x.isNotNull()), ",").alias("missing"))


@query("p17_threshold_mask", f"WITH {_LO}, r AS (SELECT slot, (min(lo) + max(lo)) / 2 AS t FROM lo GROUP BY slot) SELECT item, slot, (lo >= t) <> (slot = 3) AS shown FROM lo JOIN r USING (slot)")
def p17_threshold_mask(spark: SparkSession, d: str) -> DataFrame:
    lo = _same(spark, d)
    middle = lo.groupBy("slot").agg(((F.min("lo") + F.max("lo")) / 2).alias("t"))
    return lo.join(F.broadcast(middle), "slot").select("item", "slot", ((F.col("lo") >= F.col("t")) != (F.col("slot") == 3)).alias("shown"))


@query("f4_magnitude", "SELECT p_partkey AS item, CASE WHEN p_retailprice - 1200 > 0 THEN round(22.5 - 2.5 * log10(p_retailprice - 1200), 6) END AS magnitude FROM part")
def f4_magnitude(spark: SparkSession, d: str) -> DataFrame:
    flux = F.col("p_retailprice") - 1200
    return table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.when(flux > 0, F.round(22.5 - 2.5 * F.log10(flux), 6)).alias("magnitude"))


@query("f13_amplitude", "SELECT l_orderkey AS series, floor(sum(CASE WHEN l_returnflag <> 'R' THEN 1 / l_quantity * (l_extendedprice / 1000) * l_linenumber ELSE 0 END) / nullif(sum(CASE WHEN l_returnflag <> 'R' THEN 1 / l_quantity * l_linenumber * l_linenumber ELSE 0 END), 0) * 1000000 + 0.001) / 1000000 AS amplitude FROM lineitem GROUP BY l_orderkey")
def f13_amplitude(spark: SparkSession, d: str) -> DataFrame:
    return statistics.amplitude(sequences(spark, d), ["series"], F.col("at")).select("series", statistics.cut(F.col("amplitude")).alias("amplitude"))


@query(
    "f25_quantise",
    f"WITH {_V}, e AS (SELECT item, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM v), r AS (SELECT item, i, x, min(x) OVER w AS lo, (max(x) OVER w - min(x) OVER w) / 255 AS step FROM e WINDOW w AS (PARTITION BY item)) SELECT item, i::INT AS i, floor((x - lo) / step + 0.5)::INT AS code, round(lo + step * floor((x - lo) / step + 0.5), 6) AS back FROM r",
)
def f25_quantise(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).select("item", "vec", F.array_min("vec").alias("lo"), ((F.array_max("vec") - F.array_min("vec")) / 255).alias("step"))
    e = v.select("item", "lo", "step", F.posexplode("vec").alias("i", "x")).withColumn("code", F.floor((F.col("x") - F.col("lo")) / F.col("step") + 0.5))
    return e.select("item", (F.col("i") + 1).alias("i"), F.col("code").cast("int").alias("code"), F.round(F.col("lo") + F.col("step") * F.col("code"), 6).alias("back"))


@query(
    "q7_bias_and_outliers",
    "WITH r AS (SELECT p_brand, (p_retailprice - (900 + p_partkey / 10.0 % 1000)) / (1 + p_retailprice) AS d FROM part), m AS (SELECT p_brand, quantile_cont(d, 0.5) AS m FROM r GROUP BY p_brand) SELECT p_brand, round(max(m), 6) AS bias, round(1.4826 * quantile_cont(abs(d - m), 0.5), 6) AS nmad, round(avg(CASE WHEN abs(d) > 0.15 THEN 1.0 ELSE 0.0 END), 6) AS outliers FROM r JOIN m USING (p_brand) GROUP BY p_brand",
)
def q7_bias_and_outliers(spark: SparkSession, d: str) -> DataFrame:
    price, key = F.col("p_retailprice"), F.col("p_partkey")
    r = table(spark, d, "part").select("p_brand", ((price - (900 + key / 10.0 % 1000)) / (1 + price)).alias("d"))
    m = r.groupBy("p_brand").agg(F.percentile("d", 0.5).alias("m"))
    out = r.join(m, "p_brand").groupBy("p_brand")
    return out.agg(F.round(F.max("m"), 6).alias("bias"), F.round(1.4826 * F.percentile(F.abs(F.col("d") - F.col("m")), 0.5), 6).alias("nmad"), F.round(F.avg(F.when(F.abs("d") > 0.15, 1.0).otherwise(0.0)), 6).alias("outliers"))


@query(
    "q10_average_precision",
    f"""WITH {_V}, c AS (SELECT q.item AS q, g.item, q.label = g.label AS same, list_inner_product(g.vec, q.vec) AS s FROM v q JOIN v g ON q.item <> g.item WHERE q.item % 20 = 0),
r AS (SELECT q, same, row_number() OVER w AS rank, sum(same::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS hits FROM c WINDOW w AS (PARTITION BY q ORDER BY round(s, 9) DESC, item))
SELECT q, round(avg(hits / rank) FILTER (same), 6) AS ap, round(sum(CASE WHEN rank <= 10 THEN same::INT ELSE 0 END) / 10.0, 6)::DOUBLE AS p_at_10 FROM r GROUP BY q""",
)
def q10_average_precision(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("vec"), "label")  # in its own width, as it streams by
    return precision.label_precision(v.where("item % 20 = 0"), v).select("q", F.round("ap", 6).alias("ap"), F.round("best", 6).alias("p_at_10"))


@query("s8_ordered_gather", "SELECT k.rank, c_custkey, c_name FROM customer JOIN (SELECT unnest([9, 3, 77, 1]) AS k, unnest([0, 1, 2, 3]) AS rank) k ON c_custkey = k.k")
def s8_ordered_gather(spark: SparkSession, d: str) -> DataFrame:
    wanted = F.array(*map(F.lit, [9, 3, 77, 1]))
    return table(spark, d, "customer").where(F.col("c_custkey").isin(9, 3, 77, 1)).select((F.array_position(wanted, F.col("c_custkey").cast("int")) - 1).cast("int").alias("rank"), "c_custkey", "c_name")


@query("k14_dense_subset", "WITH k AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS item FROM customer WHERE c_custkey % 13 = 0) SELECT item::INT AS item, o_orderkey FROM orders JOIN k ON o_custkey = c_custkey")
def k14_dense_subset(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "customer").where("c_custkey % 13 = 0").select("c_custkey")
    return table(spark, d, "orders").join(statistics.numbered(kept, "c_custkey", "item"), F.col("o_custkey") == F.col("c_custkey")).select("item", "o_orderkey")


_WEIGHT = "exp(-0.5 * pow((b.k - a.k) / 2.0, 2))"


@query(
    "f11_smoothed",
    f"""WITH s AS (SELECT l_orderkey AS series, l_linenumber AS pos, avg(l_extendedprice / 1000) AS value FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY pos) AS k FROM s)
SELECT a.series, a.pos AS "at", round(sum({_WEIGHT} * b.value) / sum({_WEIGHT}), 6) AS smooth FROM r a JOIN r b ON a.series = b.series AND abs(a.k - b.k) <= 8 GROUP BY a.series, a.pos""",
)
def f11_smoothed(spark: SparkSession, d: str) -> DataFrame:
    means = sequences(spark, d).groupBy("series", "at").agg(F.avg("value").alias("value"))
    return means.select("series", "at", F.round(statistics.smoothed(["series"], "at", "value"), 6).alias("smooth"))


@query(
    "b12_moments",
    f"WITH {_V}, e AS (SELECT item, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM v) SELECT a.i::INT AS i, b.i::INT AS j, round(covar_pop(a.x, b.x), 9) AS cov FROM e a JOIN e b USING (item) GROUP BY a.i, b.i",
)
def b12_moments(spark: SparkSession, d: str) -> DataFrame:
    """Covariance of all pairs of dimensions (count, sums and products joined up map-side)."""
    width = SLOTS * CODES
    cov = linear.covariance(*linear.moments(vectors(spark, d), "vec", width))
    rows = [(i + 1, j + 1, float(cov[i, j])) for i in range(width) for j in range(width)]
    return spark.createDataFrame(rows, "i int, j int, cov double").select("i", "j", F.round("cov", 9).alias("cov"))
