"""URL filter: rules, and a ratio of two character language models where no rule fits."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.fitting import chance, logistic
from starloom.llm.scratch import written

#: (verdict, host/path prefix).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Characters of context at most.
ORDER = 5
SIDES = ("allow", "block")
#: Counts that a task holds before it empties them.
HELD = 1 << 19
#: Grams with at least one of so many uses are added up in place, at most so many; the others are joined.
FREQUENT = 1 << 14
START = "\x02"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: then up to "?", "#" or the end."""
    rest = F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does. Rules are a short list."""
    out = None
    for verdict, rule in sorted(rules, key=lambda x: -len(x[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def gram_counts(order: int) -> Callable:
    """(allowed, url) to (gram, times in allowed URLs, in blocked ones, in all), summed within the task.

    A gram is a character after its context of 0 to `order` characters; allowed is null for URLs that are no examples.
    """
    schema = pa.schema([("gram", pa.string()), ("allow", pa.int64()), ("block", pa.int64()), ("uses", pa.int64())])

    def rows(held: list[Counter]) -> pa.RecordBatch:
        keys = list(held[0] | held[1] | held[2])
        sides = [[x[k] for k in keys] for x in held]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array(x, pa.int64()) for x in (*sides[:2], map(sum, zip(*sides, strict=True))))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Counter(), Counter(), Counter()]
        for batch in batches:
            for allowed, url in zip(batch.column("allowed").to_pylist(), batch.column("url").to_pylist(), strict=True):
                url = START + url
                held[2 if allowed is None else not allowed].update(url[max(0, i - k) : i + 1] for i in range(1, len(url)) for k in range(min(order, i) + 1))
                if sum(map(len, held)) > HELD:
                    yield rows(held)
                    held = [Counter(), Counter(), Counter()]
        yield rows(held)

    return run


def gram_ratios(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, uses, value) of each gram of longest context in urls (allowed, url), allowed being null for no example.

    value is the log of the ratio of P(character | context) under allowed and blocked URLs, each interpolated over all
    its orders: an order weighs n / (n + kinds) against the shorter ones, n and kinds being the characters and different
    characters seen after the context (Witten and Bell); below all lies an even chance over 256.

    All counts are kept. Each order is joined to the one below by the gram without its first character; so a key has at
    most as many rows as there are characters. Every order is written.
    """
    counts = urls.mapInArrow(gram_counts(order), "gram string, allow long, block long, uses long").groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("allow", "block", "uses")])
    size, node = F.length("gram"), Window.partitionBy(F.expr("left(gram, length(gram) - 1)"))
    counts = counts.withColumns({f"{c}_n": F.sum(c).over(node) for c in SIDES} | {f"{c}_kinds": F.sum(F.signum(c)).over(node) for c in SIDES})
    counts, levels = written(counts.withColumn("size", size)), []
    for k in range(order + 1):
        level = counts.where(F.col("size") == k + 1)
        if k:
            below = levels[-1].select(F.col("gram").alias("suffix"), *[F.col(f"{c}_p").alias(f"{c}_below") for c in SIDES])
            level = level.join(below, F.expr("substr(gram, 2)") == F.col("suffix"))
        else:
            level = level.withColumns({f"{c}_below": F.lit(1 / 256) for c in SIDES})
        seen = {c: F.col(f"{c}_n") + F.col(f"{c}_kinds") for c in SIDES}
        p = {c: F.when(seen[c] > 0, (F.col(c) + F.col(f"{c}_kinds") * F.col(f"{c}_below")) / seen[c]).otherwise(F.col(f"{c}_below")) for c in SIDES}
        levels.append(written(level.select("gram", "uses", *[p[c].alias(f"{c}_p") for c in SIDES])))
    whole = levels[-1]
    for level in levels[:-1]:
        whole = whole.unionAll(level.where(F.col("gram").startswith(START)))
    return whole.select("gram", "uses", F.log(F.col("allow_p") / F.col("block_p")).alias("value"))


def rated(rows: DataFrame, ratios: DataFrame, order: int = ORDER) -> DataFrame:
    """rows, which have a column lower, with ratio: the mean value of the URL's characters, 0 for none; written.

    The few grams that make up large shares of all uses are added up where they are found; all others are joined.
    """
    total = ratios.agg(F.sum("uses")).first()[0] or 0
    often = rows.sparkSession.sparkContext.broadcast({r["gram"]: r["value"] for r in ratios.where(F.col("uses") * FREQUENT >= total).select("gram", "value").collect()})

    def split(url: str) -> tuple[float, list[str]]:
        url, known, total, rare = START + url, often.value, 0.0, []
        for i in range(1, len(url)):
            gram = url[max(0, i - order) : i + 1]
            if (x := known.get(gram)) is None:
                rare.append(gram)
            else:
                total += x
        return total, rare

    @F.pandas_udf("total double, rare array<string>")
    def parts(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([split(x) for x in urls], columns=["total", "rare"])

    names = rows.columns
    rows = written(rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_parts", parts("lower")))
    rest = rows.select("_at", F.explode("_parts.rare").alias("gram")).join(ratios.select("gram", "value"), "gram")
    # sorted, so that reruns add up in one order
    rest = rest.groupBy("_at").agg(F.aggregate(F.array_sort(F.collect_list("value")), F.lit(0.0), lambda a, x: a + x).alias("_rest"))
    sums = F.col("_parts.total") + F.coalesce("_rest", F.lit(0.0))
    return written(rows.join(rest, "_at", "left").select(*names, (sums / F.greatest(F.lit(1), F.length("lower"))).alias("ratio")))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, order: int = ORDER) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, ratio, chance.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest wins. URLs that a rule
    judges are the examples: two thirds of them, by hash, are counted in the two models, and the length-normalised
    ratio of the others is calibrated by logistic regression. Where no rule fits, a chance of at least 0.5 allows.

    Null URLs, and those without "://", have empty host and path; null scores as an empty URL, ratio 0. Repeated URLs
    count each. Where examples of one verdict are missing, URLs without a rule are allowed, with chance null.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    host, path = host_and_path(url)
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path")).withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("lower", F.lower("url"))
    allowed, tested = F.col("found.verdict") == "allow", F.pmod(F.xxhash64("lower", F.lit(3)), F.lit(3)) == 0
    ratios = gram_ratios(rows.select(F.when(~tested, allowed).alias("allowed"), F.col("lower").alias("url")), order)
    out = rated(rows, ratios, order)
    fitted = logistic(out.where(F.col("found").isNotNull() & tested).select(F.when(allowed, 1.0).otherwise(0.0).alias("label"), "ratio"), ["ratio"])
    p = F.lit(None).cast("double") if fitted is None else chance(fitted.log_odds())
    return out.withColumn("chance", p).select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.when(F.coalesce("chance", F.lit(1.0)) >= 0.5, "allow").otherwise("block")).alias("verdict"),
        "ratio",
        "chance",
    )
