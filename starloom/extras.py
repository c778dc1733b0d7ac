"""Registered queries of catalogues, sequences, exports, sampling, samples of pages and low-rank scores, by inventory name."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.evaluators import _NEAR, _SEQ, _UNIFORM, _queries, uniform
from starloom.operators import linear, similarity, spectra, statistics
from starloom.queries import _S, _V, _r, query
from starloom.sources import stores
from starloom.sources.relations import MODES, sequences, slots, table, vectors

_E1 = f"{_V}, e AS (SELECT item, label, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM v)"


# ------------------------------------------------------------------ catalogues


@query("s16_row_counts", "SELECT 'part' AS name, count(*) AS n FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def s16_row_counts(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t: table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
    return one("part").unionAll(one("orders")).unionAll(one("lineitem"))


@query("s17_identities", f"WITH {_V} SELECT item, round(vec[1] + 150, 6) AS ra, round(vec[2] + 2, 6) AS dec, label FROM v WHERE item % 20 = 0")
def s17_identities(spark: SparkSession, d: str) -> DataFrame:
    vec = F.col("vec")
    return vectors(spark, d).where("item % 20 = 0").select("item", F.round(vec[0] + 150, 6).alias("ra"), F.round(vec[1] + 2, 6).alias("dec"), "label")


@query("s9_covering_range", "WITH k AS (SELECT c_custkey FROM customer WHERE c_acctbal > 9000) SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM k) GROUP BY o_custkey")
def s9_covering_range(spark: SparkSession, d: str) -> DataFrame:
    """Rows of wanted keys: the keys' range first, which scans of sorted files can use, then the keys themselves."""
    wanted = table(spark, d, "customer").where("c_acctbal > 9000").select("c_custkey")
    low, high = wanted.agg(F.min("c_custkey"), F.max("c_custkey")).first()
    near = table(spark, d, "orders").where(F.col("o_custkey").between(0 if low is None else low, -1 if high is None else high))
    return near.join(wanted, F.col("o_custkey") == F.col("c_custkey"), "left_semi").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("s4_flattened", f"WITH {_E1} SELECT item, (i - 1)::INT AS at, round(x, 6) AS value FROM e WHERE label % 3 <> 0 AND i <= 16")
def s4_flattened(spark: SparkSession, d: str) -> DataFrame:
    """Lists to one row for each entry, with its owner and place; rows without a list are left out."""
    lists = vectors(spark, d).select("item", F.when(F.col("label") % 3 != 0, F.slice("vec", 1, 16)).alias("vec")).where("vec is not null")
    return lists.select("item", F.posexplode("vec").alias("at", "value")).select("item", "at", _r("value"))


@query("s19_cell_values", f"WITH {_E1} SELECT item, CASE i WHEN 49 THEN 'flux' WHEN 50 THEN 'size' WHEN 51 THEN 'shape' ELSE 'colour' END AS name, round(x, 6) AS value FROM e WHERE i BETWEEN 49 AND 52")
def s19_cell_values(spark: SparkSession, d: str) -> DataFrame:
    """The named values that follow the image's part of a cell."""
    names = F.array(*map(F.lit, ["flux", "size", "shape", "colour"]))
    pairs = F.arrays_zip(names.alias("name"), F.slice("vec", 49, 4).alias("value"))
    return vectors(spark, d).select("item", F.explode(pairs).alias("p")).select("item", F.col("p.name").alias("name"), F.round("p.value", 6).alias("value"))


@query("s18_values_or_nan", "SELECT p_partkey AS item, CASE WHEN p_size % 5 = 0 THEN 'NaN'::DOUBLE ELSE p_size::DOUBLE END AS value FROM part WHERE p_partkey % 20 = 0")
def s18_values_or_nan(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("double"))
    return table(spark, d, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("item"), F.coalesce(value, F.lit(float("nan"))).alias("value"))


@query("p8_suffixed_columns", "SELECT o_orderkey AS item, 'o_custkey' AS name, o_custkey::DOUBLE AS value FROM orders UNION ALL SELECT o_orderkey, 'o_orderkey', o_orderkey::DOUBLE FROM orders")
def p8_suffixed_columns(spark: SparkSession, d: str) -> DataFrame:
    """Numeric columns chosen by the suffix of their names, as rows."""
    orders = table(spark, d, "orders")
    chosen = stores.suffixed(orders, "key")
    return orders.select(F.col("o_orderkey").alias("item"), *[F.col(c).cast("double") for c in chosen]).unpivot("item", chosen, "name", "value")


@query("p10_exclusion_reasons", "SELECT p_partkey AS item, CASE WHEN p_size % 7 = 0 THEN 'missing' WHEN p_size % 3 = 0 THEN 'warned' WHEN p_size > 40 THEN 'too far' END AS reason FROM part")
def p10_exclusion_reasons(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    value = F.when(size % 7 != 0, size)
    reason = F.when(value.isNull(), "missing").when(size % 3 == 0, "warned").when(value > 40, "too far")
    return table(spark, d, "part").select(F.col("p_partkey").alias("item"), reason.alias("reason"))


@query("p18_split_modes", f"WITH {_E1} SELECT item, CASE WHEN i <= 32 THEN 'image' WHEN i <= 48 THEN 'spectrum' ELSE 'table' END AS mode, count(*) AS n, round(sum(x), 6) AS total FROM e GROUP BY 1, 2")
def p18_split_modes(spark: SparkSession, d: str) -> DataFrame:
    """A vector over all modes cut into one for each."""
    parts = F.array(*[F.struct(F.lit(m).alias("mode"), F.slice("vec", first * 8 + 1, width * 8).alias("part")) for m, (first, width) in MODES.items()])
    rows = vectors(spark, d).select("item", F.explode(parts).alias("p"))
    return rows.select("item", "p.mode", F.size("p.part").cast("long").alias("n"), F.round(F.aggregate("p.part", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(
    "p19_catalogue_rows",
    "WITH m AS (SELECT p_brand, round(avg(p_size), 6) AS predicted FROM part GROUP BY p_brand) SELECT p_partkey AS item, CASE WHEN p_size % 2 = 0 THEN 'first' ELSE 'second' END AS survey, p_size AS value, CASE WHEN p_size % 2 = 0 OR p_size % 3 = 0 THEN predicted END AS predicted FROM part JOIN m USING (p_brand)",
)
def p19_catalogue_rows(spark: SparkSession, d: str) -> DataFrame:
    """A measured value with its survey, and the prediction beside those that show one."""
    part, size = table(spark, d, "part"), F.col("p_size")
    means = part.groupBy("p_brand").agg(F.round(F.avg("p_size"), 6).alias("mean"))
    shown = F.when((size % 2 == 0) | (size % 3 == 0), F.col("mean"))
    return part.join(means, "p_brand").select(F.col("p_partkey").alias("item"), F.when(size % 2 == 0, "first").otherwise("second").alias("survey"), size.alias("value"), shown.alias("predicted"))


@query("j3_fan_out", f"WITH {_S} SELECT s.item, slot, label, round(max(p), 6) AS top FROM s JOIN v USING (item) GROUP BY s.item, slot, label")
def j3_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an item's slots inherit its category."""
    tops = slots(spark, d).groupBy("item", "slot").agg(F.round(F.max("p"), 6).alias("top"))
    return tops.join(vectors(spark, d).select("item", "label"), "item").select("item", "slot", "label", "top")


@query(
    "k11_ecsv_rows",
    """SELECT p_partkey, concat_ws(' ', p_partkey::VARCHAR, CASE WHEN p_name = '' OR contains(p_name, ' ') OR contains(p_name, '"') THEN '"' || replace(p_name, '"', '""') || '"' ELSE coalesce(p_name, '""') END, p_size::VARCHAR) AS line FROM part""",
)
def k11_ecsv_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an ECSV export."""
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return rows.select("p_partkey", stores.ecsv_rows(rows).alias("line"))


@query("k7_mode_columns", f"WITH {_V} SELECT item, label % 2 = 0 AS has_image, label % 3 = 0 AS has_spectrum, CASE WHEN label % 2 = 0 THEN round(vec[1], 6) END AS image, CASE WHEN label % 3 = 0 THEN round(vec[33], 6) END AS spectrum, concat_ws(',', CASE WHEN label % 2 <> 0 THEN 'image' END, CASE WHEN label % 3 <> 0 THEN 'spectrum' END) AS predicted FROM v")
def k7_mode_columns(spark: SparkSession, d: str) -> DataFrame:
    """A nullable column for each mode, flags of what was observed, and the list of what is only predicted."""
    has = {"image": F.col("label") % 2 == 0, "spectrum": F.col("label") % 3 == 0}
    first = {"image": 0, "spectrum": 32}
    columns = [F.when(has[m], F.round(F.col("vec")[first[m]], 6)).alias(m) for m in has]
    return vectors(spark, d).select("item", *[h.alias(f"has_{m}") for m, h in has.items()], *columns, F.concat_ws(",", *[F.when(~h, m) for m, h in has.items()]).alias("predicted"))


# ------------------------------------------------------------------ aggregates, ranks and samples


@query("a15_extents", f"WITH {_V} SELECT label, round(min(vec[1]), 6) AS low, round(max(vec[1]), 6) AS high FROM v GROUP BY ROLLUP (label)")
def a15_extents(spark: SparkSession, d: str) -> DataFrame:
    """The extent of each label, and their union where the label is null."""
    x = F.col("vec")[0]
    return vectors(spark, d).rollup("label").agg(F.round(F.min(x), 6).alias("low"), F.round(F.max(x), 6).alias("high"))


@query("a16_mean_of_others", f"WITH {_V}, q AS (SELECT label, min(item) AS q FROM v GROUP BY label) SELECT label, q, round(avg(vec[2]) FILTER (item <> q), 6) AS mean FROM v JOIN q USING (label) GROUP BY label, q")
def a16_mean_of_others(spark: SparkSession, d: str) -> DataFrame:
    """The mean over matches without the query itself."""
    v = vectors(spark, d)
    q = v.groupBy("label").agg(F.min("item").alias("q"))
    return v.join(q, "label").groupBy("label", "q").agg(F.round(F.avg(F.when(F.col("item") != F.col("q"), F.col("vec")[1])), 6).alias("mean"))


@query("a17_largest_of_rows", f"WITH {_E1} SELECT label, i::INT AS i, round(max(x), 6) AS top FROM e GROUP BY label, i")
def a17_largest_of_rows(spark: SparkSession, d: str) -> DataFrame:
    """Element by element the largest of the chosen rows."""
    tops = vectors(spark, d).groupBy("label").agg(F.array(*[F.max(F.col("vec")[i]) for i in range(64)]).alias("t"))
    return tops.select("label", F.posexplode("t").alias("i", "top")).select("label", (F.col("i") + 1).alias("i"), _r("top"))


@query("a20_percentiles", "SELECT p_brand, round(quantile_cont(p_retailprice, 0.05), 6) AS p5, round(quantile_cont(p_retailprice, 0.5), 6) AS p50, round(quantile_cont(p_retailprice, 0.95), 6) AS p95 FROM part GROUP BY p_brand")
def a20_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(*[F.round(F.percentile("p_retailprice", p / 100), 6).alias(f"p{p}") for p in (5, 50, 95)])


@query("a21_scatter_add", "SELECT (l_orderkey % 97)::INT AS cell, sum(l_linenumber)::BIGINT AS total FROM lineitem GROUP BY 1")
def a21_scatter_add(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 97).cast("int").alias("cell")).agg(F.sum("l_linenumber").alias("total"))


@query("a23_root_mean_square", f"WITH {_E1} SELECT label, round(sqrt(avg(x * x)), 6) AS rms FROM e GROUP BY label")
def a23_root_mean_square(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).select("label", similarity.dot(F.col("vec"), F.col("vec")).alias("s"), F.size("vec").alias("n"))
    return v.groupBy("label").agg(F.round(F.sqrt(F.sum("s") / F.sum("n")), 6).alias("rms"))


_UPTO = f"{_S}, u AS (SELECT item, slot, code, p, sum(p) OVER (PARTITION BY item, slot ORDER BY code) AS upto FROM s)"


def _running(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("item", "slot").orderBy("code").rowsBetween(Window.unboundedPreceding, 0)
    return slots(spark, d).withColumn("upto", F.sum("p").over(w))


@query("w5_spread_quantile", f"WITH {_UPTO}, f AS (SELECT item, slot, arg_min(code + (0.5 - (upto - p)) / p, code) AS place FROM u WHERE round(upto, 9) >= 0.5 GROUP BY item, slot) SELECT item, slot, round(place, 6) AS place FROM f")
def w5_spread_quantile(spark: SparkSession, d: str) -> DataFrame:
    """The quantile within its code: a code's probability lies evenly over it."""
    place = F.col("code") + (0.5 - (F.col("upto") - F.col("p"))) / F.col("p")
    over = _running(spark, d).where(F.round("upto", 9) >= 0.5).groupBy("item", "slot")
    return over.agg(F.round(F.min(F.struct("code", place.alias("place")))["place"], 6).alias("place"))


@query("w6_inverse_sample", f"WITH {_UPTO}, r AS (SELECT *, {_UNIFORM.format(chr(40) + 'item::VARCHAR || chr(58) || slot::VARCHAR' + chr(41))} AS u FROM u) SELECT item, slot, sum(CASE WHEN round(upto, 9) < u THEN 1 ELSE 0 END)::INT AS code FROM r GROUP BY item, slot")
def w6_inverse_sample(spark: SparkSession, d: str) -> DataFrame:
    """One code drawn for each slot, by a number that depends on item and slot alone."""
    u = uniform(F.concat_ws(":", "item", "slot"))
    return _running(spark, d).groupBy("item", "slot").agg(F.least(F.lit(7), F.sum(F.when(F.round("upto", 9) < u, 1).otherwise(0))).cast("int").alias("code"))


@query("w10_prefix_offsets", "SELECT p_brand, count(*) AS width, (sum(count(*)) OVER (ORDER BY p_brand) - count(*))::BIGINT AS first FROM part GROUP BY p_brand")
def w10_prefix_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where each brand's rows begin when brands lie one after another."""
    widths = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("width"))
    return widths.select("p_brand", "width", (F.sum("width").over(Window.orderBy("p_brand")) - F.col("width")).alias("first"))


@query("w11_frames", "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after, (ntile(4) OVER w)::INT AS quarter, count(*) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def w11_frames(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    key = "o_orderkey"
    return table(spark, d, "orders").select(key, F.lag(key).over(w).alias("before"), F.lead(key).over(w).alias("after"), F.ntile(4).over(w).alias("quarter"), F.count("*").over(w.rowsBetween(-2, 0)).alias("near"))


@query("t8_token_sets", "WITH r AS (SELECT DISTINCT l_orderkey AS item, l_suppkey - 20 AS token FROM lineitem WHERE l_suppkey >= 20) SELECT item, string_agg(token::VARCHAR, ',' ORDER BY token) AS tokens FROM r GROUP BY item")
def t8_token_sets(spark: SparkSession, d: str) -> DataFrame:
    """The tokens of a selection, each once, in order, negative ones left out."""
    tokens = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("item")).agg(F.collect_set(F.col("l_suppkey") - 20).alias("t"))
    valid = F.array_sort(F.filter("t", lambda x: x >= 0))
    return tokens.where(F.size(valid) > 0).select("item", F.array_join(F.transform(valid, lambda x: x.cast("string")), ",").alias("tokens"))


@query(
    "t9_leading_contributions",
    f"WITH {_E1}, c AS (SELECT item, CASE WHEN i <= 32 THEN 'image' WHEN i <= 48 THEN 'spectrum' ELSE 'table' END AS mode, sum(x) AS c FROM e GROUP BY 1, 2), l AS (SELECT *, max(c) OVER (PARTITION BY item) AS lead FROM c) SELECT item, mode, round(100 * c / lead, 4) AS percent FROM l WHERE lead > 0 AND c >= 0.1 * lead",
)
def t9_leading_contributions(spark: SparkSession, d: str) -> DataFrame:
    """Contributions of a tenth of the largest or more, in percent of it."""
    part = lambda first, width: F.aggregate(F.slice("vec", first * 8 + 1, width * 8), F.lit(0.0), lambda a, x: a + x)
    each = F.array(*[F.struct(F.lit(m).alias("mode"), part(*at).alias("c")) for m, at in MODES.items()])
    rows = vectors(spark, d).select("item", each.alias("each"), F.array_max(F.transform(each, lambda x: x["c"])).alias("lead")).where("lead > 0")
    rows = rows.select("item", "lead", F.explode("each").alias("x")).where(F.col("x.c") >= 0.1 * F.col("lead"))
    return rows.select("item", "x.mode", F.round(100 * F.col("x.c") / F.col("lead"), 4).alias("percent"))


@query(
    "u6_phrases",
    "WITH n AS (SELECT DISTINCT p_name AS n FROM part), t AS (SELECT DISTINCT lower(p_type) AS t FROM part) SELECT CASE WHEN substr(t, 1, 1) IN ('a', 'e', 'i', 'o', 'u') THEN 'an ' ELSE 'a ' END || t || ' ' || n AS phrase FROM n, t",
)
def u6_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Every phrase of the vocabulary's parts, with its article."""
    part = table(spark, d, "part")
    kinds, names = part.select(F.lower("p_type").alias("t")).distinct(), part.select(F.col("p_name").alias("n")).distinct()
    article = F.when(F.substring("t", 1, 1).isin(*"aeiou"), "an").otherwise("a")
    return names.crossJoin(kinds).select(F.concat_ws(" ", article, "t", "n").alias("phrase"))


@query("u5_blocks", "SELECT o_orderkey, 'first' AS block FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'second' FROM orders WHERE o_orderkey % 2 = 1")
def u5_blocks(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey")
    return o.where("o_orderkey % 2 = 0").withColumn("block", F.lit("first")).unionByName(o.where("o_orderkey % 2 = 1").withColumn("block", F.lit("second")))


# ------------------------------------------------------------------ scalar functions and sequences


@query("f1_functions", "SELECT p_partkey AS item, round(asinh(p_retailprice / 1000), 6) AS a, round(sqrt(p_size * p_size + 16), 6) AS h, round_even(p_size / 4.0, 0)::DOUBLE AS r, least(40, greatest(10, p_size)) AS c FROM part")
def f1_functions(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.round(F.asinh(F.col("p_retailprice") / 1000), 6).alias("a"), F.round(F.hypot(size, F.lit(4)), 6).alias("h"), F.rint(size / 4).alias("r"), F.least(F.lit(40), F.greatest(F.lit(10), size)).alias("c"))


@query("f5_axis_ratio", f"WITH {_V}, r AS (SELECT item, sqrt(vec[1] * vec[1] + vec[2] * vec[2]) AS e FROM v) SELECT item, CASE WHEN e > 0 THEN round((1 - e) / (1 + e), 6) END AS ratio FROM r")
def f5_axis_ratio(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("item", F.round(spectra.axis_ratio(F.col("vec")[0], F.col("vec")[1]), 6).alias("ratio"))


@query("f6_rates", "SELECT p_partkey AS item, round(log10(p_retailprice), 6) AS rate, round(log10(p_retailprice) - p_size / 10.0, 6)::DOUBLE AS specific FROM part")
def f6_rates(spark: SparkSession, d: str) -> DataFrame:
    rate = F.log10("p_retailprice")
    return table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.round(rate, 6).alias("rate"), F.round(rate - F.col("p_size") / 10, 6).alias("specific"))


_WEIGHTS = [(0.7, 0.1, 0.0), (0.3, 0.6, 0.2), (0.0, 0.3, 0.8)]
_MIX = ["least(1, greatest(0, (" + " + ".join(f"{w[k]} * b{j}" for j, w in enumerate(_WEIGHTS)) + ") * CASE WHEN m > 0 THEN asinh(5 * m) / (5 * m) ELSE 0 END))" for k in range(3)]


@query("f9_colours", f"WITH {_V}, b AS (SELECT item, vec[1] * 2 AS b0, vec[2] * 3 AS b1, vec[3] * 4 AS b2, (vec[1] * 2 + vec[2] * 3 + vec[3] * 4) / 3 AS m FROM v) SELECT item, floor({_MIX[0]} * 255)::INT AS red, floor({_MIX[1]} * 255)::INT AS green, floor({_MIX[2]} * 255)::INT AS blue FROM b")
def f9_colours(spark: SparkSession, d: str) -> DataFrame:
    rgb = spectra.stretched([F.col("vec")[i] for i in range(3)], [2.0, 3.0, 4.0], _WEIGHTS, 5.0)
    return vectors(spark, d).select("item", rgb.alias("c")).select("item", F.col("c")[0].alias("red"), F.col("c")[1].alias("green"), F.col("c")[2].alias("blue"))


@query("f10_rescaled", "SELECT p_partkey AS item, round(p_retailprice * pow(10, -0.4 * 4.5), 6) AS flux FROM part")
def f10_rescaled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.round(spectra.rescaled(F.col("p_retailprice")), 6).alias("flux"))


_MEANS = f"{_SEQ}, g AS (SELECT series, pos::DOUBLE AS x, avg(value) AS value FROM s GROUP BY series, pos)"


@query(
    "f12_interpolated",
    f"WITH {_MEANS}, w AS (SELECT series, x + 0.3 AS x FROM g), b AS (SELECT w.series, w.x, arg_max(g.value, g.x) FILTER (g.x <= w.x) AS lv, max(g.x) FILTER (g.x <= w.x) AS la, arg_min(g.value, g.x) FILTER (g.x >= w.x) AS hv, min(g.x) FILTER (g.x >= w.x) AS ha FROM w JOIN g USING (series) GROUP BY w.series, w.x) SELECT series, round(x, 6) AS \"at\", floor(coalesce(lv + (hv - lv) * (x - la) / (ha - la), lv, hv) * 1000000 + 0.001) / 1000000 AS value FROM b",
)
def f12_interpolated(spark: SparkSession, d: str) -> DataFrame:
    means = sequences(spark, d).groupBy("series", F.col("at").cast("double").alias("at")).agg(F.avg("value").alias("value"))
    found = spectra.interpolated(means, means.select("series", (F.col("at") + 0.3).alias("at")), ["series"], "at", "value")
    return found.select("series", _r("at"), statistics.cut(F.col("value")).alias("value"))


@query(
    "f14_gridded",
    f"WITH {_SEQ}, p AS (SELECT series, value, pos * 0.7 AS place FROM s), c AS (SELECT series, floor(place)::BIGINT AS cell, value * (1 - (place - floor(place))) AS x FROM p UNION ALL SELECT series, floor(place)::BIGINT + 1, value * (place - floor(place)) FROM p WHERE place > floor(place)) SELECT series, cell, round(sum(x), 6) AS total FROM c GROUP BY series, cell",
)
def f14_gridded(spark: SparkSession, d: str) -> DataFrame:
    rows = sequences(spark, d).withColumn("place", F.col("at") * 0.7)
    return spectra.gridded(rows, ["series"], "place", "value", 0.0, 1.0).select("series", "cell", _r("total"))


@query(
    "f16_patches",
    f"WITH {_V}, i AS (SELECT k, j, (2 + (k // 2) * 2 + j // 2) * 8 + 2 + (k % 2) * 2 + j % 2 + 1 AS place FROM range(4) a(k), range(4) b(j)) SELECT item, k::INT AS patch, j::INT AS pixel, round(vec[place], 6) AS value FROM v, i",
)
def f16_patches(spark: SparkSession, d: str) -> DataFrame:
    """The middle of an image of 8 x 8 in patches of 2 x 2."""
    image = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("vec", r * 8 + 1, 8))
    cut = spectra.patches(spectra.cropped(image, 8, 8, 4), 4, 2)
    rows = vectors(spark, d).select("item", F.posexplode(cut).alias("patch", "pixels"))
    return rows.select("item", "patch", F.posexplode("pixels").alias("pixel", "value")).select("item", "patch", "pixel", _r("value"))


@query("f17_tokens", "SELECT p_partkey AS item, floor((p_size * 37.5 + 3500 - 3500) / 25.6)::INT AS token, round(3500 + (floor((p_size * 37.5 + 3500 - 3500) / 25.6) + 0.5) * 25.6, 6)::DOUBLE AS middle FROM part")
def f17_tokens(spark: SparkSession, d: str) -> DataFrame:
    token = spectra.token_of(F.col("p_size") * 37.5 + 3500)
    return table(spark, d, "part").select(F.col("p_partkey").alias("item"), token.alias("token"), F.round(spectra.middle_of(token), 6).alias("middle"))


@query("f18_strings", "SELECT c_custkey AS item, split_part(c_name, '#', 2) AS number, lower(split_part(c_name, '#', 1)) AS kind, regexp_replace(c_mktsegment, '^(A|B)', '') AS segment FROM customer")
def f18_strings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("item"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("number"), F.lower(F.split_part("c_name", F.lit("#"), F.lit(1))).alias("kind"), F.regexp_replace("c_mktsegment", "^(A|B)", "").alias("segment"))


@query("f20_wrapped", f"WITH {_V}, r AS (SELECT item, 180 - vec[1] * 3000 AS x FROM v) SELECT item, round(x - floor(x / 360) * 360, 4) AS longitude FROM r")
def f20_wrapped(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("item", F.round(spectra.wrapped(F.col("vec")[0] * 3000), 4).alias("longitude"))


@query("f26_timestamps", "SELECT o_orderkey AS item, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM orders")
def f26_timestamps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"))


@query("f27_fingerprints", "SELECT o_orderkey AS item, md5(concat_ws('|', o_orderkey::VARCHAR, o_orderpriority, o_orderstatus)) AS md5 FROM orders")
def f27_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.md5(F.concat_ws("|", "o_orderkey", "o_orderpriority", "o_orderstatus")).alias("md5"))


@query(
    "p20_scaled_shapes",
    f"WITH {_SEQ}, a AS (SELECT series, sum(weight * value * pos) / sum(weight * pos * pos) AS a FROM s WHERE NOT bad GROUP BY series) SELECT series, pos AS at, floor(coalesce(a, 1) * pos * 1000000 + 0.001)::DOUBLE / 1000000 AS flux, count(*) AS n FROM s LEFT JOIN a USING (series) GROUP BY series, pos, a",
)
def p20_scaled_shapes(spark: SparkSession, d: str) -> DataFrame:
    """A predicted shape at the amplitude of its data, or bare where there are none."""
    s = sequences(spark, d)
    both = s.join(statistics.amplitude(s, ["series"], F.col("at")), "series", "left")
    return both.groupBy("series", "at", "amplitude").agg(F.count("*").alias("n")).select("series", "at", statistics.cut(spectra.scaled_to(F.col("at").cast("double"), F.col("amplitude"))).alias("flux"), "n")


@query(
    "q13_reduced_chi_square",
    f"WITH {_SEQ} SELECT series, round(sum(weight * pow(value - pos, 2)) / count(*), 5) AS prediction, round((sum(weight * value * value) - pow(sum(weight * value), 2) / sum(weight)) / count(*), 5) + 0.0 AS floor, round(sum(weight * value * value) / count(*), 5) AS nothing FROM s GROUP BY series",
)
def q13_reduced_chi_square(spark: SparkSession, d: str) -> DataFrame:
    """Weighted squares per sample of a prediction, of the best constant and of nothing at all."""
    w, x, at = F.col("weight"), F.col("value"), F.col("at")
    square = F.sum(w * x * x)
    return sequences(spark, d).groupBy("series").agg(
        F.round(F.sum(w * (x - at) * (x - at)) / F.count("*"), 5).alias("prediction"),
        (F.round((square - F.pow(F.sum(w * x), 2) / F.sum(w)) / F.count("*"), 5) + 0.0).alias("floor"),
        F.round(square / F.count("*"), 5).alias("nothing"),
    )


# ------------------------------------------------------------------ scores, builds and evaluators


def _sql_top(score: str, k: int, e: str = "e") -> str:
    return f"k AS (SELECT q.item AS q, g.item, {score} AS score FROM {e} q JOIN {e} g ON g.i = q.i AND g.item <> q.item WHERE q.item % 20 = 0 GROUP BY q.item, g.item), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, item) AS rank FROM k) SELECT q, item, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= {k}"


@query("b7_gram_tiles", f"WITH {_E1}, {_sql_top('sum(q.x * g.x)', 10)}")
def b7_gram_tiles(spark: SparkSession, d: str) -> DataFrame:
    """The best of a matrix of scores, a tile at a time."""
    v = vectors(spark, d).select("item", "vec")
    return linear.gram_top(v.where("item % 20 = 0"), v, 10).select("q", "item", _r("score"), "rank")


@query("v21_factor_scores", f"WITH {_E1}, {_sql_top('sum(CASE WHEN q.i <= 16 THEN q.x * g.x ELSE 0 END) + max(CASE WHEN g.i = 17 THEN g.x END)', 10)}")
def v21_factor_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores from low-rank factors: the query's times an item's, and the item's offset."""
    v = vectors(spark, d)
    q = v.where("item % 20 = 0").select("item", F.concat(F.slice("vec", 1, 16), F.array(F.lit(1.0))).alias("vec"))
    return linear.gram_top(q, v.select("item", F.slice("vec", 1, 17).alias("vec")), 10).select("q", "item", _r("score"), "rank")


@query("v27_scaled_scores", f"WITH {_E1}, {_sql_top('sum(q.x * g.x) - 0.5 * sum(g.x * g.x)', 10)}")
def v27_scaled_scores(spark: SparkSession, d: str) -> DataFrame:
    """Dot products less half an item's squared length: the order of distances."""
    v = vectors(spark, d).select("item", "vec")
    score = lambda q, g: q @ g.T - 0.5 * (g * g).sum(1)[None, :]
    return linear.gram_top(v.where("item % 20 = 0"), v, 10, score=score).select("q", "item", _r("score"), "rank")


@query("b12_predictive_widths", f"WITH {_S}, m AS (SELECT item, slot, sum(p * code) AS m FROM s GROUP BY item, slot) SELECT item, slot, round(sqrt(sum(p * (code - m) * (code - m))), 6) AS width FROM s JOIN m USING (item, slot) GROUP BY item, slot")
def b12_predictive_widths(spark: SparkSession, d: str) -> DataFrame:
    """The spread of each slot's distribution over codes."""
    p, code = F.col("p"), F.col("code")
    sums = slots(spark, d).groupBy("item", "slot").agg(F.sum(p * code).alias("m"), F.sum(p * code * code).alias("s"))
    return sums.select("item", "slot", F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("s") - F.col("m") * F.col("m"))), 6).alias("width"))


@query(
    "b15_graph_distances",
    f"WITH {_E1}, k AS (SELECT q.item AS q, g.item, sum(q.x * g.x) AS s FROM e q JOIN e g ON g.i = q.i AND g.item <> q.item WHERE q.item % 20 = 0 GROUP BY q.item, g.item), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, item) AS rank, max(s) OVER (PARTITION BY q) AS best FROM k) SELECT q, item, rank::INT AS rank, round(1 + best - s, 6) AS distance FROM r WHERE rank <= 15",
)
def b15_graph_distances(spark: SparkSession, d: str) -> DataFrame:
    """The lists of a neighbour graph, with distances from the nearest's 1 upward."""
    v = vectors(spark, d).select("item", "vec")
    near = linear.gram_top(v.where("item % 20 = 0"), v, 15)
    return near.select("q", "item", "rank", F.round(1 + F.max("score").over(Window.partitionBy("q")) - F.col("score"), 6).alias("distance"))


_VIEWS = [("image",), ("image", "spectrum"), ("spectrum", "table"), ("image", "spectrum", "table")]
_SHARES = {m: sum(1 / len(v) for v in _VIEWS if m in v) / len(_VIEWS) for m in MODES}


@query("b19_mode_weights", f"WITH {_E1}, t AS (SELECT item, CASE WHEN i <= 32 THEN 'image' WHEN i <= 48 THEN 'spectrum' ELSE 'table' END AS mode, sum(x) AS t FROM e GROUP BY 1, 2) SELECT item, round(sum(t * CASE mode {' '.join(f'WHEN {chr(39)}{m}{chr(39)} THEN {w!r}' for m, w in _SHARES.items())} END), 6) AS total FROM t GROUP BY item")
def b19_mode_weights(spark: SparkSession, d: str) -> DataFrame:
    """Modes weighted by an even split of each view among its modes."""
    total = lambda first, width: F.aggregate(F.slice("vec", first * 8 + 1, width * 8), F.lit(0.0), lambda a, x: a + x)
    return vectors(spark, d).select("item", F.round(sum((total(*MODES[m]) * F.lit(w) for m, w in _SHARES.items()), F.lit(0.0)), 6).alias("total"))


@query("b5_components")
def b5_components(spark: SparkSession, d: str) -> DataFrame:
    """Each item along the 4 principal directions; tests/test_extras.py holds it against a decomposition of the whole matrix."""
    v = vectors(spark, d).select("item", "vec")
    mean, directions, _ = linear.principal(v, "vec", 64, 4)
    centred = F.zip_with("vec", F.array(*[F.lit(float(x)) for x in mean]), lambda a, b: a - b)
    return v.select("item", linear.times(centred, directions).alias("c")).select("item", F.posexplode("c").alias("k", "value")).select("item", "k", F.round("value", 5).alias("value"))


@query("b14_ridge")
def b14_ridge(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold predictions of a label by ridge regression; tests/test_extras.py holds it against the whole matrix."""
    rows = vectors(spark, d).select("item", "vec", F.col("label").cast("double").alias("label"), F.pmod("item", F.lit(5)).alias("fold"))
    _, weights, bias = linear.ridge(rows, "vec", "label", 64)
    out = F.lit(None).cast("double")
    for f, (w, b) in enumerate(zip(weights, bias, strict=True)):
        out = F.when(F.col("fold") == f, linear.times(F.col("vec"), np.array([w]))[0] + F.lit(b)).otherwise(out)
    return rows.select("item", "fold", F.round(out, 6).alias("predicted"))


@query("q8_neighbour_differences", f"WITH {_NEAR} SELECT q, round(quantile_cont(abs(mine - theirs) / (1.0 + mine), 0.5), 6)::DOUBLE AS middle FROM l WHERE rank <= 10 GROUP BY q")
def q8_neighbour_differences(spark: SparkSession, d: str) -> DataFrame:
    """The median relative difference of a value between a query and its 10 nearest."""
    v = vectors(spark, d)
    near = linear.nearest(v.where("item % 20 = 0"), v, 10).select("q", "item")
    near = near.join(v.select("item", "label"), "item").join(v.select(F.col("item").alias("q"), F.col("label").alias("mine")), "q")
    return near.groupBy("q").agg(F.round(F.percentile(F.abs(F.col("mine") - F.col("label")) / (1 + F.col("mine")), 0.5), 6).alias("middle"))


@query("q17_hidden_parts", f"WITH {_S}, o AS (SELECT item, mode, slot, ln(sum(p * p)) AS lo FROM s GROUP BY item, mode, slot) SELECT item, round(sum(lo), 6) AS whole, round(sum(lo) FILTER (slot % 4 <> item % 4), 6) AS seen FROM o GROUP BY item")
def q17_hidden_parts(spark: SparkSession, d: str) -> DataFrame:
    """A score with all of an item's slots, and with some hidden."""
    lo = slots(spark, d).groupBy("item", "slot").agg(F.log(F.sum(F.col("p") * F.col("p"))).alias("lo"))
    shown = F.when(F.col("slot") % 4 != F.col("item") % 4, F.col("lo"))
    return lo.groupBy("item").agg(F.round(F.sum("lo"), 6).alias("whole"), F.round(F.sum(shown), 6).alias("seen"))


@query(
    "q18_compressed_scores",
    f"WITH {_S}, k AS (SELECT item, slot, p, row_number() OVER (PARTITION BY item, slot ORDER BY round(p, 12) DESC, code) AS k FROM s) SELECT item, slot, round(sum(p * p), 6) AS exact, round(sum(p * p) FILTER (k <= 3) + pow(sum(p) FILTER (k > 3), 2) / 5, 6) AS compressed FROM k GROUP BY item, slot",
)
def q18_compressed_scores(spark: SparkSession, d: str) -> DataFrame:
    """The overlap of a distribution with itself, exact and from its 3 top codes over an even rest."""
    s = slots(spark, d).groupBy("item", "slot").agg(F.reverse(F.array_sort(F.collect_list("p"))).alias("p"))
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)
    rest = F.aggregate(F.slice("p", 4, 100), F.lit(0.0), lambda a, x: a + x)
    return s.select("item", "slot", F.round(square(F.col("p")), 6).alias("exact"), F.round(square(F.slice("p", 1, 3)) + rest * rest / 5, 6).alias("compressed"))


@query("q19_view_scores", f"WITH {_E1}, t AS (SELECT item, label, CASE WHEN i <= 32 THEN 0 WHEN i <= 48 THEN 1 ELSE 2 END AS m, sum(x) AS t FROM e GROUP BY 1, 2, 3) SELECT item, round(coalesce(avg(t) FILTER ((label + m) % 4 = 0), -1), 6) AS score FROM t GROUP BY item")
def q19_view_scores(spark: SparkSession, d: str) -> DataFrame:
    """The mean over the modes that are there, -1 where none is."""
    total = lambda first, width: F.aggregate(F.slice("vec", first * 8 + 1, width * 8), F.lit(0.0), lambda a, x: a + x)
    there = F.array_compact(F.array(*[F.when((F.col("label") + m) % 4 == 0, total(*at)) for m, at in enumerate(MODES.values())]))
    rows = vectors(spark, d).select("item", there.alias("t"))
    mean = F.aggregate("t", F.lit(0.0), lambda a, x: a + x) / F.size("t")
    return rows.select("item", F.round(F.when(F.size("t") > 0, mean).otherwise(F.lit(-1.0)), 6).alias("score"))


@query(
    "q20_phrase_rows",
    f"WITH {_V}, l AS (SELECT DISTINCT label FROM v), n AS (SELECT l.label, quantile_cont(vec[1], 0.95) FILTER (v.label <> l.label) AS nothing, avg(vec[1]) FILTER (v.label = l.label) AS mean, avg(CASE WHEN v.label = l.label THEN 1.0 ELSE 0 END) AS rate FROM v, l GROUP BY l.label) SELECT label, round(rate, 6)::DOUBLE AS rate, round(nothing, 6) AS nothing, mean > nothing AS passed FROM n",
)
def q20_phrase_rows(spark: SparkSession, d: str) -> DataFrame:
    """For each label its share, the level that 95 % of the other rows stay under, and whether its mean is above."""
    v = vectors(spark, d).select("label", F.col("vec")[0].alias("x"))
    labels = v.select(F.col("label").alias("l")).distinct()  # a few classes
    own = F.col("label") == F.col("l")
    rows = v.crossJoin(F.broadcast(labels)).groupBy("l").agg(F.percentile(F.when(~own, F.col("x")), 0.95).alias("nothing"), F.avg(F.when(own, F.col("x"))).alias("mean"), F.avg(own.cast("double")).alias("rate"))
    return rows.select(F.col("l").alias("label"), _r("rate"), _r("nothing"), (F.col("mean") > F.col("nothing")).alias("passed"))


@query("q24_window_samples", "SELECT vec_id AS item, (((vec_id + 11) * 2654435761) % 4294967296 % 6 + k)::INT AS slot FROM embeddings, range(3) r(k)")
def q24_window_samples(spark: SparkSession, d: str) -> DataFrame:
    """Three slots in a row of each item, from a place that depends on the item alone."""
    start = F.pmod(F.pmod((F.col("item") + 11) * F.lit(2654435761), F.lit(4294967296)), F.lit(6)).cast("int")
    return vectors(spark, d).select("item", F.explode(F.sequence(start, start + 2)).alias("slot"))


@query(
    "q26_versions_side_by_side",
    f"WITH {_E1}, k AS (SELECT q.item AS q, g.item, sum(q.x * g.x) AS now, sum(CASE WHEN q.i <= 32 THEN q.x * g.x ELSE 0 END) AS old FROM e q JOIN e g ON g.i = q.i AND g.item <> q.item WHERE q.item % 20 = 0 GROUP BY q.item, g.item), r AS (SELECT q, item, row_number() OVER (PARTITION BY q ORDER BY round(now, 9) DESC, item)::INT AS now, row_number() OVER (PARTITION BY q ORDER BY round(old, 9) DESC, item)::INT AS earlier FROM k) SELECT q, item, CASE WHEN now <= 5 THEN now END AS now, CASE WHEN earlier <= 5 THEN earlier END AS earlier FROM r WHERE now <= 5 OR earlier <= 5",
)
def q26_versions_side_by_side(spark: SparkSession, d: str) -> DataFrame:
    """The 5 best of two versions of a score beside each other."""
    v = vectors(spark, d).select("item", "vec")
    short = v.select("item", F.slice("vec", 1, 32).alias("vec"))
    best = lambda x, name: linear.gram_top(x.where("item % 20 = 0"), x, 5).select("q", "item", F.col("rank").alias(name))
    return best(v, "now").join(best(short, "earlier"), ["q", "item"], "full").select("q", "item", "now", "earlier")


@query("q27_scores_by_rank", f"WITH {_E1} SELECT a.item, round(sum(CASE WHEN a.i <= 8 THEN a.x * b.x ELSE 0 END), 6) AS r8, round(sum(CASE WHEN a.i <= 32 THEN a.x * b.x ELSE 0 END), 6) AS r32, round(sum(a.x * b.x), 6) AS r64 FROM e a JOIN e b ON b.item = a.item + 1 AND b.i = a.i GROUP BY a.item")
def q27_scores_by_rank(spark: SparkSession, d: str) -> DataFrame:
    """The score of each item and the next from the first 8, 32 and 64 dimensions."""
    v = vectors(spark, d).select("item", "vec")
    both = v.join(v.select((F.col("item") - 1).alias("item"), F.col("vec").alias("other")), "item")
    part = lambda k: F.round(similarity.dot(F.slice("vec", 1, k), F.slice("other", 1, k)), 6).alias(f"r{k}")
    return both.select("item", part(8), part(32), part(64))
