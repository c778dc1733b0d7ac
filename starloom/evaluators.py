"""Registered queries over whole vectors: text-like search, scores against data, samples, and evaluators of rankings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.operators import linear, ranks, similarity, statistics
from starloom.queries import _FLOOR, _S, _V, SLOTS, _r, query
from starloom.sources.relations import CODES, mode_of, sequences, slots, table, vectors
from starloom.sources.shared import stored

#: Every 20th item is a query of the evaluators.
_E = f"{_V}, e AS (SELECT item, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS i FROM v)"
_MODE = "CASE WHEN i < 32 THEN 'image' WHEN i < 48 THEN 'spectrum' ELSE 'table' END"
_UNIFORM = "((('0x' || substr(md5({0}), 1, 8))::BIGINT) + 0.5) / 4294967296"
#: Upper ends of the Poisson distribution of mean 1.
_POISSON = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]


def _long(spark: SparkSession, d: str) -> DataFrame:
    long = vectors(spark, d).select("item", F.posexplode("vec").alias("i", "x"))
    return long.withColumn("mode", mode_of(F.floor(F.col("i") / CODES)))


def _queries(v: DataFrame) -> DataFrame:
    return v.where("item % 20 = 0").select(F.col("item").alias("q"), *[F.col(c).alias(f"q_{c}") for c in v.columns if c != "item"])


def uniform(key: Column) -> Column:
    """A number in (0, 1) that depends on the key alone, so reruns and partitions agree."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") + 0.5) / 4294967296


@query(
    "v20_direction_search",
    f"""WITH {_E}, m AS (SELECT i, avg(x) AS m FROM e GROUP BY i), o AS (SELECT i, m, x - m AS d FROM e JOIN m USING (i) WHERE item = 3), n AS (SELECT i, m, d / sqrt(sum(d * d) OVER ()) AS d FROM o),
c AS (SELECT item, {_MODE} AS mode, sum(x * d) AS s, sum((x - m) * d) AS c FROM e JOIN n USING (i) GROUP BY 1, 2), t AS (SELECT item, sum(s) AS score FROM c GROUP BY item ORDER BY round(sum(s), 9) DESC, item LIMIT 20)
SELECT item, mode, round(score, 6) AS score, round(c, 6) AS contribution FROM t JOIN c USING (item)""",
)
def v20_direction_search(spark: SparkSession, d: str) -> DataFrame:
    """Rank by the dot product with a centred, normalised direction; contributions of the modes against their baseline."""
    e = _long(spark, d)
    means = e.groupBy("i").agg(F.avg("x").alias("m"))
    away = e.where("item = 3").join(F.broadcast(means), "i").select("i", "m", (F.col("x") - F.col("m")).alias("away"))
    length = away.agg(F.sqrt(F.sum(F.col("away") * F.col("away"))).alias("length"))
    way = away.crossJoin(F.broadcast(length)).select("i", "m", (F.col("away") / F.col("length")).alias("d"))
    parts = e.join(F.broadcast(way), "i").groupBy("item", "mode").agg(F.sum(F.col("x") * F.col("d")).alias("s"), F.sum((F.col("x") - F.col("m")) * F.col("d")).alias("contribution"))
    top = parts.groupBy("item").agg(F.sum("s").alias("score")).orderBy(F.desc(F.round("score", 9)), "item").limit(20)
    return parts.join(F.broadcast(top), "item").select("item", "mode", _r("score"), _r("contribution"))


@query(
    "v3_sparse_overlap",
    f"""WITH {_S}, k AS (SELECT item, slot, code, p, row_number() OVER (PARTITION BY item, slot ORDER BY round(p, 12) DESC, code) AS k FROM s WHERE mode = 'image'),
q AS (SELECT slot, code, CASE WHEN k <= 4 THEN p ELSE sum(CASE WHEN k > 4 THEN p END) OVER (PARTITION BY slot) / 4 END AS q FROM k WHERE item = 7),
b AS (SELECT item, slot, (1 - sum(p)) / 6 AS b FROM k WHERE k <= 2 GROUP BY item, slot), f AS (SELECT slot, sum(q) AS f FROM q GROUP BY slot)
SELECT item, slot, round(ln(greatest(sum((p - b) * q) + max(b * f), {_FLOOR})), 6) AS lo FROM k JOIN b USING (item, slot) JOIN q USING (slot, code) JOIN f USING (slot) WHERE k <= 2 GROUP BY item, slot""",
)
def v3_sparse_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of top codes over a flat background: 2 codes of a gallery slot, 4 of a query slot."""
    w = Window.partitionBy("item", "slot").orderBy(F.desc(F.round("p", 12)), "code")
    ordered = slots(spark, d).where("mode = 'image'").withColumn("k", F.row_number().over(w))
    one = ordered.where("item = 7")
    tail = F.sum(F.when(F.col("k") > 4, F.col("p"))).over(Window.partitionBy("slot")) / 4
    one = one.select("slot", "code", F.when(F.col("k") <= 4, F.col("p")).otherwise(tail).alias("q"))
    one = one.withColumn("full", F.sum("q").over(Window.partitionBy("slot")))
    # a slot's 2 codes meet in one group: the background is 1 less their sum, over the other 6 codes
    found = ordered.where("k <= 2").join(F.broadcast(one), ["slot", "code"]).groupBy("item", "slot")
    found = found.agg(F.sum(F.col("p") * F.col("q")).alias("pq"), F.sum("q").alias("sq"), ((1 - F.sum("p")) / 6).alias("b"), F.max("full").alias("full"))
    return found.select("item", "slot", F.round(F.log(F.greatest(F.col("pq") + F.col("b") * (F.col("full") - F.col("sq")), F.lit(float(_FLOOR)))), 6).alias("lo"))


_REFERENCE = "m AS (SELECT i, quantile_disc(x, 0.5) AS m FROM e GROUP BY i)"


@query(
    "v24_against_data",
    f"""WITH {_E}, {_REFERENCE}, k AS (SELECT q.item AS q, g.item, sum((q.x - m) * g.x * (1 + abs(g.x))) - 0.5 * sum((q.x * q.x - m * m) * (1 + abs(g.x))) AS score FROM e q JOIN m USING (i) JOIN e g ON g.i = q.i AND g.item <> q.item WHERE q.item % 20 = 0 GROUP BY q.item, g.item),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, item) AS rank FROM k) SELECT q, item, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 10""",
)
def v24_against_data(spark: SparkSession, d: str) -> DataFrame:
    """Score of a prediction against weighted data, less that of the median prediction."""
    v = vectors(spark, d).select("item", "vec")
    median = np.array(statistics.lower_quantiles(v, "vec", SLOTS * CODES, 0.5))
    gallery = v.select("item", F.concat(F.transform("vec", lambda x: x * (1 + F.abs(x))), F.transform("vec", lambda x: 1 + F.abs(x))).alias("vec"))

    def score(q: np.ndarray, g: np.ndarray) -> np.ndarray:
        return (q - median) @ g[:, : len(median)].T - 0.5 * ((q * q - median * median) @ g[:, len(median) :].T)

    return linear.gram_top(v.where("item % 20 = 0"), gallery, 10, score=score).select("q", "item", _r("score"), "rank")


@query(
    "v25_against_data_anywhere",
    f"""WITH {_S}, x AS (SELECT * FROM s WHERE (item * 8 + slot) % 5 <> 0), k AS (SELECT g.item, q.slot AS q_slot, g.slot, sum(q.p * g.p) - 0.5 * sum(q.p * q.p) AS score FROM s q JOIN x g ON g.mode = q.mode AND g.code = q.code WHERE q.item = 7 AND g.item <> 7 GROUP BY ALL),
b AS (SELECT item, q_slot, max(score) AS best FROM k GROUP BY item, q_slot) SELECT item, count(*) AS n_slots, round(sum(best), 6) AS score FROM b GROUP BY item""",
)
def v25_against_data_anywhere(spark: SparkSession, d: str) -> DataFrame:
    """The best slot with data for each slot of the query, in the same mode, summed."""
    every = slots(spark, d)
    one = every.where("item = 7").select("mode", "code", F.col("slot").alias("q_slot"), F.col("p").alias("q"))
    data = every.where("item <> 7 and (item * 8 + slot) % 5 <> 0")
    each = data.join(F.broadcast(one), ["mode", "code"]).groupBy("item", "q_slot", "slot")
    each = each.agg((F.sum(F.col("p") * F.col("q")) - 0.5 * F.sum(F.col("q") * F.col("q"))).alias("score"))
    best = each.groupBy("item", "q_slot").agg(F.max("score").alias("best"))
    return best.groupBy("item").agg(F.count("*").alias("n_slots"), F.round(F.sum("best"), 6).alias("score"))


@query(
    "v26_prediction_gram",
    f"""WITH {_E}, u AS (SELECT item, i, x / sqrt(sum(x * x) OVER (PARTITION BY item)) AS x FROM e), k AS (SELECT q.item AS q, g.item, -0.5 * sum((q.x - g.x) * (q.x - g.x)) AS score FROM u q JOIN u g ON g.i = q.i AND g.item <> q.item WHERE q.item % 20 = 0 GROUP BY q.item, g.item),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, item) AS rank FROM k) SELECT q, item, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 10""",
)
def v26_prediction_gram(spark: SparkSession, d: str) -> DataFrame:
    """Half the squared distance of unit vectors, negative."""
    v = stored(vectors(spark, d).select("item", similarity.unit(F.col("vec")).alias("vec")))
    half = lambda a, b: -0.5 * ((a - b) ** 2).sum(1)
    score = lambda q, g: q @ g.T - 0.5 * (q * q).sum(1)[:, None] - 0.5 * (g * g).sum(1)[None, :]
    near = linear.gram_top(v.where("item % 20 = 0"), v, 10, score=score, exact=half, slack=lambda least, q, g: np.full(len(q), 3e-9))
    return near.select("q", "item", _r("score"), "rank")


@query(
    "b10_joint_embedding",
    f"""WITH {_E}, c AS (SELECT item, i, {_MODE} AS mode, x - avg(x) OVER (PARTITION BY i) AS x FROM e), n AS (SELECT mode, sqrt(sum(x * x) / count(DISTINCT item)) AS n FROM c GROUP BY mode)
SELECT item, i::INT AS i, round(x / n, 6) AS value FROM c JOIN n USING (mode)""",
)
def b10_joint_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Centred blocks, each scaled to a root-mean-square length of 1, side by side."""
    e = _long(spark, d)
    stats = e.groupBy("mode", "i").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    lengths = stats.groupBy("mode").agg(F.sqrt(F.sum("v")).alias("n"))
    scales = stats.join(lengths, "mode").select("i", "m", "n")
    return e.join(F.broadcast(scales), "i").select("item", "i", F.round((F.col("x") - F.col("m")) / F.col("n"), 6).alias("value"))


@query("t6_weighted_sample", f"SELECT p_partkey FROM part WHERE p_size > 0 ORDER BY round(-ln({_UNIFORM.format('p_partkey::VARCHAR')}) / p_size, 12), p_partkey LIMIT 50")
def t6_weighted_sample(spark: SparkSession, d: str) -> DataFrame:
    """50 parts, each drawn by its size: the least exponential keys, without a total over all rows."""
    key = -F.log(uniform(F.col("p_partkey"))) / F.col("p_size")
    return table(spark, d, "part").where("p_size > 0").orderBy(F.round(key, 12), "p_partkey").limit(50).select("p_partkey")


@query(
    "q3_topk_agreement",
    f"""WITH {_E}, k AS (SELECT q.item AS q, g.item, sum(q.x * g.x) AS exact, sum(CASE WHEN q.i < 32 THEN q.x * g.x ELSE 0 END) AS cut FROM e q JOIN e g ON g.i = q.i AND g.item <> q.item WHERE q.item % 20 = 0 GROUP BY q.item, g.item),
r AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY round(exact, 9) DESC, item) AS a, row_number() OVER (PARTITION BY q ORDER BY round(cut, 9) DESC, item) AS b FROM k) SELECT q, sum(CASE WHEN a <= 10 AND b <= 10 THEN 1 ELSE 0 END) / 10.0::DOUBLE AS agreement FROM r GROUP BY q""",
)
def q3_topk_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Share of the exact 10 best that a ranking by half of the dimensions has too."""
    v = vectors(spark, d).select("item", "vec")
    short = v.select("item", F.slice("vec", 1, 32).alias("vec"))
    best = lambda x: linear.gram_top(x.where("item % 20 = 0"), x, 10).select("q", "item")
    cut = best(short).withColumn("hit", F.lit(1))
    return best(v).join(cut, ["q", "item"], "left").groupBy("q").agg((F.count("hit") / 10.0).alias("agreement"))


@query(
    "q5_own_rank",
    f"""WITH {_E}, k AS (SELECT q.item AS q, g.item, round(sum(q.x * g.x), 9) AS s FROM e q JOIN e g ON g.i = q.i + 32 WHERE q.item % 20 = 0 AND q.i < 32 GROUP BY q.item, g.item), o AS (SELECT q, s AS own FROM k WHERE q = item),
r AS (SELECT q, 1 + sum(CASE WHEN s > own THEN 1 ELSE 0 END) + sum(CASE WHEN s = own AND item <> q THEN 1 ELSE 0 END) / 2.0 AS place FROM k JOIN o USING (q) GROUP BY q)
SELECT count(*) AS n, avg(CASE WHEN place <= 1 THEN 1.0 ELSE 0 END)::DOUBLE AS recall_1, avg(CASE WHEN place <= 10 THEN 1.0 ELSE 0 END)::DOUBLE AS recall_10, quantile_cont(place, 0.5)::DOUBLE AS median_rank FROM r""",
)
def q5_own_rank(spark: SparkSession, d: str) -> DataFrame:
    """Recall and median rank of each query's own row, by one half of the vector against the other; ties share a rank."""
    v = vectors(spark, d)
    gallery = v.select("item", F.slice("vec", 33, 32).alias("vec"))
    q = v.where("item % 20 = 0").select("item", F.slice("vec", 1, 32).alias("vec"), F.array(similarity.dot(F.slice("vec", 1, 32), F.slice("vec", 33, 32))).alias("own"))
    found = ranks.own_ranks(q, gallery, lambda a, b: [a @ b.T], ties=True)
    places = found.select((F.col("ranks")[0] + F.col("ties")[0] / 2.0).alias("place"))
    within = lambda k: F.avg(F.when(F.col("place") <= k, 1.0).otherwise(0.0))
    return places.agg(F.count("*").alias("n"), within(1).alias("recall_1"), within(10).alias("recall_10"), F.percentile("place", 0.5).alias("median_rank"))


@query(
    "q9_bootstrap",
    f"""WITH u AS (SELECT b, p_retailprice AS x, {_UNIFORM.format("b::VARCHAR || ':' || p_partkey::VARCHAR")} AS u FROM part, range(100) r(b)), w AS (SELECT b, x, {" + ".join(f"CASE WHEN u > {p} THEN 1 ELSE 0 END" for p in _POISSON)} AS w FROM u), m AS (SELECT b, sum(w * x) / sum(w) AS m FROM w GROUP BY b)
SELECT round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high FROM m""",
)
def q9_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Percentile interval of a mean from 100 replicates with Poisson weights; rows never meet in one task."""
    rows = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("b"))
    u = uniform(F.concat_ws(":", "b", "p_partkey"))
    weighted = rows.withColumn("u", u).withColumn("w", sum((F.when(F.col("u") > p, 1).otherwise(0) for p in _POISSON), F.lit(0)))
    means = weighted.groupBy("b").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"))
    return means.agg(F.round(F.percentile("m", 0.025), 4).alias("low"), F.round(F.percentile("m", 0.975), 4).alias("high"))


_NEAR = f"""{_E}, k AS (SELECT q.item AS q, g.item, sqrt(sum((q.x - g.x) * (q.x - g.x))) AS far FROM e q JOIN e g ON g.i = q.i AND g.item <> q.item WHERE q.item % 20 = 0 GROUP BY q.item, g.item),
r AS (SELECT q, item, row_number() OVER (PARTITION BY q ORDER BY round(far, 9), item) AS rank FROM k), l AS (SELECT r.q, r.rank, a.label AS mine, b.label AS theirs FROM r JOIN v a ON a.item = r.q JOIN v b ON b.item = r.item)"""


@query("q11_precision_at_k", f"WITH {_NEAR} SELECT q, avg(CASE WHEN mine = theirs THEN 1.0 ELSE 0 END)::DOUBLE AS precision FROM l WHERE rank <= 10 GROUP BY q")
def q11_precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Share of the 10 nearest with the query's label."""
    v = vectors(spark, d).select("item", "vec", "label")
    near = linear.nearest(v.where("item % 20 = 0"), v, 10).select("q", "item")
    labels = v.select("item", "label")
    near = near.join(labels, "item").join(labels.select(F.col("item").alias("q"), F.col("label").alias("mine")), "q")
    return near.groupBy("q").agg(F.avg(F.when(F.col("mine") == F.col("label"), 1.0).otherwise(0.0)).alias("precision"))


@query(
    "q12_neighbour_values",
    f"WITH {_NEAR} SELECT q, round(avg(CASE WHEN rank <= 10 THEN abs(mine - theirs) END), 6) AS near, round(avg(abs(mine - theirs)), 6) AS any FROM l GROUP BY q",
)
def q12_neighbour_values(spark: SparkSession, d: str) -> DataFrame:
    """Mean difference of a value between a query and its 10 nearest, beside that to all items.

    The mean over all items comes from how often each value occurs: a query's own difference to itself is 0 and isn't counted.
    """
    v = vectors(spark, d).select("item", "vec", F.col("label").alias("value"))
    values = v.select("item", "value")
    q = values.where("item % 20 = 0").select(F.col("item").alias("q"), F.col("value").alias("mine"))
    gap = F.abs(F.col("mine") - F.col("value"))
    near = linear.nearest(v.where("item % 20 = 0"), v, 10).select("q", "item").join(values, "item").join(q, "q")
    near = near.groupBy("q").agg(F.round(F.avg(gap), 6).alias("near"))
    counts = stored(values.where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n")))
    means = counts.select(F.col("value").alias("mine")).crossJoin(counts).groupBy("mine").agg((F.sum(gap * F.col("n")) / F.nullif(F.sum("n") - 1, F.lit(0))).alias("any"))
    return q.join(near, "q").join(means, "mine", "left").select("q", "near", F.round("any", 6).alias("any"))


_SEQ = "s AS (SELECT l_orderkey AS series, l_linenumber AS pos, l_extendedprice / 1000 AS value, 1 / l_quantity AS weight, l_returnflag = 'R' AS bad FROM lineitem)"


@query(
    "f7_equivalent_width",
    f"""WITH {_SEQ}, c AS (SELECT series, quantile_cont(value, 0.5) AS c FROM s WHERE pos NOT BETWEEN 3 AND 5 GROUP BY series HAVING quantile_cont(value, 0.5) > 0),
d AS (SELECT series, pos, value / c - 1 AS d FROM s JOIN c USING (series) WHERE pos BETWEEN 3 AND 5), t AS (SELECT series, (d + lead(d) OVER w) / 2 * (lead(pos) OVER w - pos) AS t FROM d WINDOW w AS (PARTITION BY series ORDER BY pos, d)) SELECT series, round(sum(t), 5) AS width FROM t WHERE t IS NOT NULL GROUP BY series""",
)
def f7_equivalent_width(spark: SparkSession, d: str) -> DataFrame:
    """Trapezoid integral of a line over its continuum, the median of the samples beside it."""
    s = sequences(spark, d)
    line, c = F.col("at").between(3, 5), F.percentile(F.when(~F.col("at").between(3, 5), F.col("value")), 0.5).over(Window.partitionBy("series"))
    inside = s.withColumn("c", c).where(line & (F.col("c") > 0)).select("series", "at", (F.col("value") / F.col("c") - 1).alias("d"))
    w = Window.partitionBy("series").orderBy("at", "d")  # samples at one place: by value
    part = (F.col("d") + F.lead("d").over(w)) / 2 * (F.lead("at").over(w) - F.col("at"))
    return inside.select("series", part.alias("t")).where("t is not null").groupBy("series").agg(F.round(F.sum("t"), 5).alias("width"))


@query(
    "f8_break_strength",
    f"""WITH {_SEQ}, b AS (SELECT series, avg(value) FILTER (pos <= 3) AS low, avg(value) FILTER (pos > 3) AS high, count(*) FILTER (pos <= 3) AS n_low, count(*) FILTER (pos > 3) AS n_high, sqrt(sum(1 / weight) FILTER (pos <= 3)) / count(*) FILTER (pos <= 3) AS e_low, sqrt(sum(1 / weight) FILTER (pos > 3)) / nullif(count(*) FILTER (pos > 3), 0) AS e_high FROM s WHERE NOT bad GROUP BY series)
SELECT series, round(high / low, 5) AS strength FROM b WHERE n_low >= 2 AND n_high >= 2 AND low > 3 * e_low AND high > 3 * e_high""",
)
def f8_break_strength(spark: SparkSession, d: str) -> DataFrame:
    """Ratio of two bands' means over good samples, where both have enough samples and stand out by 3 deviations."""
    low, high = F.col("at") <= 3, F.col("at") > 3
    aggs = []
    for name, band in (("low", low), ("high", high)):
        n = F.count_if(band)
        aggs += [F.avg(F.when(band, F.col("value"))).alias(name), n.alias(f"n_{name}"), (F.sqrt(F.sum(F.when(band, 1 / F.col("weight")))) / F.nullif(n, F.lit(0))).alias(f"e_{name}")]
    bands = sequences(spark, d).where("not bad").groupBy("series").agg(*aggs)
    return bands.where("n_low >= 2 and n_high >= 2 and low > 3 * e_low and high > 3 * e_high").select("series", F.round(F.col("high") / F.col("low"), 5).alias("strength"))


@query("k9_json_rows", "SELECT vec_id AS item, CAST(to_json({'item': vec_id, 'label': label}) AS VARCHAR) AS json FROM embeddings")
def k9_json_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each row as a JSON document."""
    return vectors(spark, d).select("item", F.to_json(F.struct("item", "label")).alias("json"))
