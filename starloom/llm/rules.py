"""Quality rules with thresholds from mergeable quantile sketches for each language and source, by DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.scratch import written

SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Words of a window of which repeats are counted.
WINDOW = 8
#: The base rules: fewest words, and the greatest share (in hundredths) of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30

#: What the thresholds are for: values of a document as whole parts in a million, and the least width of a fence. Where
#: half of a group has the same value its quartiles have no width; a document within the least width is kept even so.
METRICS = {"mean_word": 2_500_000, "symbols": 100_000, "dup_lines": 250_000, "echoes": 200_000}
#: Fences lie so many quartile widths beyond the quartiles (3 marks far outliers).
REACH = 3
#: Groups of fewer documents than this take the thresholds of their language, and those of all where that is small too.
LEAST_GROUP = 50
#: Sketch: bins are as wide as 1 / 2 ** PRECISION of their values at most.
PRECISION = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once for the row."""
    return F.transform(F.array(value), body)[0]


def lines_repeated(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rtrim(x, F.lit(SPACE)) != "")
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, SPACE, " " * len(SPACE)), " ", -1), lambda x: x != "")


def words_repeated(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a run of `window` words found twice or more.

    Hashes of runs pick the runs that may repeat, mostly none; those are compared as words. A run's words are joined
    by a space, which no word holds.
    """
    count = F.size(words) - window + 1

    def covered(starts: Column) -> Column:
        # each repeated run adds the words up to the next one's start, the last one all of its own
        return F.aggregate(F.transform(starts, lambda p, j: F.least(F.lit(window), F.coalesce(F.get(starts, j + 1) - p, F.lit(window)))), F.lit(0).cast("long"), lambda a, x: a + x)

    def twice(keyed: Column) -> Column:
        """Starts, in order, of those of the sorted (key, start) whose key is there twice."""
        near = lambda i: F.get(keyed, i)["k"]
        same = F.filter(keyed, lambda x, i: F.coalesce(x["k"] == near(i - 1), F.lit(False)) | F.coalesce(x["k"] == near(i + 1), F.lit(False)))
        return F.array_sort(F.transform(same, lambda x: x["p"]))

    def exact(w: Column, starts: Column) -> Column:
        keyed = F.array_sort(F.transform(starts, lambda p: F.struct(F.array_join(F.slice(w, p + 1, window), " ").alias("k"), p.alias("p"))))
        return let(keyed, lambda x: let(twice(x), covered))

    def maybe(w: Column, runs: Column) -> Column:
        keyed = F.array_sort(F.transform(runs, lambda h, i: F.struct(h.alias("k"), i.alias("p"))))
        return let(keyed, lambda x: let(twice(x), lambda p: F.when(F.size(p) == 0, F.lit(0).cast("long")).otherwise(exact(w, p))))

    def runs(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        return let(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(window)])))

    def found(w: Column) -> Column:
        return let(runs(w), lambda r: F.when(F.size(F.array_distinct(r)) == F.size(r), F.lit(0).cast("long")).otherwise(maybe(w, r)))

    return F.when(count < 2, F.lit(0).cast("long")).otherwise(let(words, found))


def echoes(words: Column) -> Column:
    """Words that equal the word before them."""
    return let(words, lambda w: F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False)))).cast("long"))


def measured(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_echoes of each row's whole text; null has none."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], text.alias("_text"), words_of(text).alias("_words"))
    bare = F.length(F.translate(F.col("_text"), SPACE, "")).cast("long")
    return rows.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        F.size("_words").cast("long").alias("n_words"),
        bare.alias("word_chars"),
        (F.length("_text") - F.length(F.translate(F.col("_text"), SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines_repeated(F.col("_text")).alias("n_dup_lines"),
        words_repeated(F.col("_words")).alias("n_repeat_words"),
        echoes(F.col("_words")).alias("n_echoes"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def values() -> dict[str, Column]:
    """The metrics of a measured row in whole millionths; null for a row without words."""
    of = {"mean_word": "word_chars", "symbols": "n_symbols", "dup_lines": "n_dup_lines", "echoes": "n_echoes"}
    return {m: F.when(F.col("n_words") > 0, F.expr(f"{c} * 1000000 div n_words")) for m, c in of.items()}


def bin_of(value: Column) -> Column:
    """The bin of a whole number from 0: exact up to 2 ** (PRECISION + 1), then as many bins in each power of two."""
    extra = F.greatest(F.length(F.bin(value)) - (PRECISION + 1), F.lit(0))
    return (extra * (1 << (PRECISION + 1)) + F.call_function("shiftright", value, extra)).cast("int")


def sketch(rows: DataFrame, by: list[str], metrics: dict[str, Column]) -> DataFrame:
    """Counts (by..., metric, bin, n, least, most): a histogram sketch of each metric for each group.

    Sketches merge by adding counts (see `merged`), so parts of a corpus may be sketched apart and days added up. A
    quantile read from one is off by 1 / 2 ** PRECISION of its value at most. A group has at most some two thousand
    bins a metric, however many rows: rows are counted before they are shuffled, so a group that holds a third of all
    rows sends no more than any other.
    """
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("v")) for m, v in metrics.items()])).alias("x")
    flat = rows.select(*by, each).select(*by, "x.metric", "x.v").where(F.col("v").isNotNull())
    return flat.groupBy(*by, "metric", bin_of(F.col("v")).alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))


def merged(counts: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of `by` from finer ones, or from several of the same groups."""
    return counts.groupBy(*by, "metric", "bin").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def quantiles(counts: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """(by..., metric, size, q0, q1, ...): of each sketch, the greatest value of the bin that holds the share's row.

    The share's row of n is number floor(share * (n - 1)), from 0.
    """
    bins = F.array_sort(F.collect_list(F.struct("bin", "n", "most")))
    held = counts.groupBy(*by, "metric").agg(F.sum("n").alias("size"), bins.alias("bins"))

    def at(share: float) -> Column:
        rank = F.floor(F.lit(share) * (F.col("size") - 1))
        start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("long").alias("value"))
        step = lambda a, x: F.struct((a["upto"] + x["n"]).alias("upto"), F.when(a["value"].isNull() & (a["upto"] + x["n"] > rank), x["most"]).otherwise(a["value"]).alias("value"))
        return F.aggregate("bins", start, step)["value"]

    return held.select(*by, "metric", "size", *[at(s).alias(f"q{i}") for i, s in enumerate(shares)])


def fences(counts: DataFrame, group: list[str], parent: list[str]) -> DataFrame:
    """One row for each group: (group..., METRIC_low, METRIC_high) in millionths, and level (0 own, 1 parent's, 2 all).

    Fences lie REACH quartile widths, or the least width of the metric, beyond the quartiles. A group of fewer than
    LEAST_GROUP documents takes its parent's sketch, and one of a small parent takes that of all.
    """
    low, high = F.col("q0"), F.col("q1")
    width = reduce(lambda a, m: F.when(F.col("metric") == m, METRICS[m]).otherwise(a), METRICS, F.lit(0).cast("long"))
    reach = F.greatest(REACH * (high - low), width)
    names = {m: F.col("metric") == m for m in METRICS}

    def wide(by: list[str]) -> DataFrame:
        sums = counts if by == group else merged(counts, by) if by else merged(counts.withColumn("_", F.lit(0)), ["_"]).drop("_")
        keyed = sums if by else sums.withColumn("_all", F.lit(0))
        q = quantiles(keyed, by or ["_all"], [0.25, 0.75])
        made = [F.max(F.when(here, e)).alias(f"{m}_{side}") for m, here in names.items() for side, e in (("low", low - reach), ("high", high + reach))]
        return q.groupBy(*(by or ["_all"])).agg(F.max("size").alias("size"), *made)

    sides = [f"{m}_{s}" for m in METRICS for s in ("low", "high")]
    own, ours, every = wide(group), wide(parent), wide([])
    ours = ours.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(parent)], F.col("size").alias("_psize"), F.struct(*sides).alias("_pf"))
    every = every.select(F.struct(*sides).alias("_ef"))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_p{i}")) for i, c in enumerate(parent)])
    joined = own.join(ours, on, "left").join(F.broadcast(every))  # every is one row
    level = F.when(F.col("size") >= LEAST_GROUP, 0).when(F.col("_psize") >= LEAST_GROUP, 1).otherwise(2)
    chosen = F.when(level == 0, F.struct(*sides)).when(level == 1, F.col("_pf")).otherwise(F.col("_ef"))
    return joined.select(*group, level.alias("level"), chosen.alias("_f")).select(*group, "level", "_f.*")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_echoes, base_failed, reasons, level, kept) for each row.

    The base rules have fixed bounds. Documents that pass them are sketched by language and source, and one whose
    mean word length, or whose share of symbols, repeated lines or echoes to words lies beyond the far fences of
    its group isn't kept; `reasons` names the metrics, and `level` tells whose sketch the fences are from (0 the group's
    own, 1 its language's, 2 that of all). Only the mean word length has a lower fence that can be met.

    Null and empty texts have no words and fail the base rules; so do brief ones. Null languages and sources are groups
    like others; null ids and repeated rows are judged each; equal values are on the same side of a fence; other
    columns aren't read; an empty table gives no rows. Texts are read once and never shuffled.
    """
    rows = measured(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source")), ["doc_id", "lang", "source"])
    rows = written(rows.withColumn("base_failed", base_failed()))
    good = rows.where(~F.col("base_failed"))
    counts = written(sketch(good, ["lang", "source"], values()))
    limits = written(fences(counts, ["lang", "source"], ["lang"]).withColumnsRenamed({"lang": "_lang", "source": "_source"}))
    beyond = [F.when((v < F.col(f"{m}_low")) | (v > F.col(f"{m}_high")), F.lit(m)) for m, v in values().items()]
    reasons = F.array_compact(F.array(*beyond))
    met = good.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_echoes", "base_failed"]
    passed = met.select(*columns, reasons.alias("reasons"), "level", (F.size(reasons) == 0).alias("kept"))
    failed = rows.where("base_failed").select(*columns, F.array().cast("array<string>").alias("reasons"), F.lit(None).cast("int").alias("level"), F.lit(False).alias("kept"))
    return passed.unionAll(failed)


def _sql() -> str:
    """DuckDB's SQL of the query."""
    word, sides = r"[^\x20\x09-\x0D]+", [f"{m}_{s}" for m in METRICS for s in ("low", "high")]
    of = {"mean_word": "word_chars", "symbols": "n_symbols", "dup_lines": "n_dup_lines", "echoes": "n_echoes"}
    value = {m: f"({c} * 1000000 // n_words)" for m, c in of.items()}
    flat = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {v} AS v FROM g" for m, v in value.items())
    width = " ".join(f"WHEN '{m}' THEN {w}" for m, w in METRICS.items())
    made = ", ".join(f"max(CASE WHEN metric = '{m}' THEN {e} END) AS {m}_{s}" for m in METRICS for s, e in (("low", "q0 - reach"), ("high", "q1 + reach")))

    def level(name: str, by: str) -> str:
        keys, over = (f"{by}, ", f"PARTITION BY {by}, metric") if by else ("", "PARTITION BY metric")
        at = lambda share: f"min(CASE WHEN upto > floor({share} * (size - 1)) THEN most END)"
        return f"""
{name}b AS (SELECT {keys}metric, bin, sum(n) AS n, max(most) AS most FROM c GROUP BY {keys}metric, bin),
{name}u AS (SELECT *, sum(n) OVER ({over} ORDER BY bin) AS upto, sum(n) OVER ({over}) AS size FROM {name}b),
{name}q AS (SELECT {keys}metric, max(size) AS size, {at(0.25)} AS q0, {at(0.75)} AS q1 FROM {name}u GROUP BY {keys}metric),
{name}r AS (SELECT *, greatest({REACH} * (q1 - q0), CASE metric {width} END) AS reach FROM {name}q),
{name} AS (SELECT {keys}max(size) AS size, {made} FROM {name}r {f"GROUP BY {by}" if by else ""})"""

    chosen = ", ".join(f"CASE WHEN o.size >= {LEAST_GROUP} THEN o.{s} WHEN p.size >= {LEAST_GROUP} THEN p.{s} ELSE e.{s} END AS {s}" for s in sides)
    reasons = "concat_ws(',', " + ", ".join(f"CASE WHEN {v} < {m}_low OR {v} > {m}_high THEN '{m}' END" for m, v in value.items()) + ")"
    symbols = SYMBOLS.replace("'", "''")
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents
), x AS (
  SELECT r, p, array_to_string(w[p : p + {WINDOW - 1}], ' ') AS run FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM d WHERE len(w) >= {WINDOW})
), y AS (
  SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, run) AS n FROM x) WHERE n > 1
), z AS (
  SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + {WINDOW})) AS q FROM y) GROUP BY r
), b AS (
  SELECT r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(translate(text, '{symbols}', '')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(list_filter(w, lambda v, i: i > 1 AND w[i - 1] = v))::BIGINT AS n_echoes, coalesce(z.n, 0)::BIGINT AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda v: regexp_matches(v, '{word}')) AS l FROM d) LEFT JOIN z USING (r)
), t AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM b
), g AS (
  SELECT * FROM t WHERE NOT base_failed
), c AS (
  SELECT lang, source, metric, extra * {1 << (PRECISION + 1)} + (v >> extra) AS bin, count(*) AS n, max(v) AS most
  FROM (SELECT *, greatest(length(bin(v)) - {PRECISION + 1}, 0)::INT AS extra FROM ({flat})) GROUP BY ALL
), {level("own_", "lang, source")}, {level("par_", "lang")}, {level("all_", "")},
f AS (
  SELECT o.lang, o.source, {chosen} FROM own_ o LEFT JOIN par_ p ON p.lang IS NOT DISTINCT FROM o.lang, all_ e
), j AS (
  SELECT g.*, {reasons} AS reasons FROM g JOIN f ON f.lang IS NOT DISTINCT FROM g.lang AND f.source IS NOT DISTINCT FROM g.source
)
SELECT t.doc_id, t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, t.base_failed, coalesce(j.reasons = '', false) AS kept, coalesce(j.reasons, '') AS reasons
FROM t LEFT JOIN j USING (r)
"""


SQL = _sql()
