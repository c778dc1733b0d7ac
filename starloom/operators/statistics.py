"""Quantiles, robust spread, ranks, sampling and spectra-like sequences."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: str, by: list[str]) -> Column:
    """Rank from 1 in rising order, ties at their mean rank."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def nmad(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """1.4826 times the median distance from the median, nulls and NaN left out."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    middle = rows.groupBy(*by).agg(F.percentile(value, 0.5).alias("middle"))
    return rows.join(middle, by).groupBy(*by).agg((1.4826 * F.percentile(F.abs(F.col(value) - F.col("middle")), 0.5)).alias("nmad"))


#: Values among which a quantile's is looked up at last, and buckets that a range is cut into before.
FEW, BUCKETS = 10_000, 1000


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles of a numeric column over all rows, between neighbours by a straight line; None without values.

    The two values beside a quantile are found by counting: a range is cut into buckets, counted in one aggregate, and
    the bucket that holds the place is cut again, until few values are left in it. A level is one pass for all places. No
    task holds all values. Infinite values have their places at the ends; nulls and NaN have none.
    """
    infinite = float("inf")
    x = F.col(value).cast("double")
    rows = df.select(x.alias("x")).where("x is not null and not isnan(x)")
    finite = F.abs("x") < infinite
    n, below, above, low, high = rows.agg(F.count("*"), F.count_if(F.col("x") == -infinite), F.count_if(F.col("x") == infinite), F.min(F.when(finite, F.col("x"))), F.max(F.when(finite, F.col("x")))).first()
    if not n:
        return [None] * len(shares)
    wanted = {min(n - 1, int(share * (n - 1)) + d) for share in shares for d in (0, 1)}
    found = {p: -infinite if p < below else infinite for p in wanted if p < below or p >= n - above}
    open_ = {p: (low, high, below, n - below - above) for p in wanted if p not in found}  # a range, rows before it, rows in it
    while open_:
        ranges = sorted({r for r in open_.values()})
        each = []
        for k, (left, right, _, held) in enumerate(ranges):
            step = (right / BUCKETS - left / BUCKETS) or 1.0
            bucket = F.least(F.lit(BUCKETS - 1.0), F.floor((F.col("x") - left) / step)).cast("double") if held > FEW else F.col("x")
            each.append(F.when((F.col("x") >= left) & (F.col("x") <= right), F.struct(F.lit(k).alias("k"), bucket.alias("b"))))
        inside = rows.select("x", F.explode(F.array_compact(F.array(*each))).alias("r"))
        counts = inside.groupBy("r.k", "r.b").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("k", "b").collect()
        for p, r in list(open_.items()):
            left, right, before, held = r
            for c in (c for c in counts if c["k"] == ranges.index(r)):
                if before + c["n"] > p:
                    # one value, or values too near each other for a bucket to tell them apart
                    if c["low"] == c["high"] or (c["low"], c["high"]) == (left, right):
                        found[p] = c["low"]
                        del open_[p]
                    else:
                        open_[p] = (c["low"], c["high"], before, c["n"])
                    break
                before += c["n"]
    out: list[float | None] = []
    for share in shares:
        place = share * (n - 1)
        a, b, part = found[int(place)], found[min(n - 1, int(place) + 1)], place - int(place)
        out.append(a if a == b or part == 0 else (1 - part) * a + part * b)
    return out


#: Ranges that `numbered` deals keys into, and keys that their bounds are taken from.
NUMBER_RANGES, NUMBER_SAMPLE = 256, 20_000


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with the number of each row from 0 in order of a unique key (null first): ranges of keys, their counts, then a place in each.

    The ranges' bounds are keys from a sample, and a row's range follows from its key alone. So however often the rows are
    worked out, dealt and merged, counts and places mean the same ranges; the sample only makes them even.
    """
    n = df.count()
    sample = df.select(key).where(F.col(key).isNotNull()).sample(min(1.0, 2 * NUMBER_SAMPLE / max(1, n)), seed=1) if n > NUMBER_SAMPLE else df.select(key).where(F.col(key).isNotNull())
    keys = sorted(r[0] for r in sample.limit(2 * NUMBER_SAMPLE).collect())
    bounds = sorted({keys[len(keys) * i // NUMBER_RANGES] for i in range(1, NUMBER_RANGES)}) if n > NUMBER_SAMPLE and keys else []
    of = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(key))) if bounds else F.lit(0)
    ranged = df.withColumn("_range", F.when(F.col(key).isNull(), 0).otherwise(of))
    counts = {r["_range"]: r["n"] for r in ranged.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    first, upto = [], 0
    for k in range(len(bounds) + 1):
        first.append(upto)
        upto += counts.get(k, 0)
    place = F.row_number().over(Window.partitionBy("_range").orderBy(F.col(key).asc_nulls_first())) - 1
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in first]), F.col("_range") + 1)
    return ranged.withColumn(name, (start + place).cast("int" if n < 1 << 31 else "long")).drop("_range")


def lower_quantiles(rows: DataFrame, vec: str, width: int, share: float) -> list[float]:
    """Of each place of a list, the value at floor(share * (n - 1)) of the sorted ones over all rows, by counting.

    All places are narrowed at once: a pass counts each place's range in buckets within the tasks, which send a
    histogram each, and goes on in the bucket that holds the value, until that has one value only.
    """
    n = rows.where(F.col(vec).isNotNull()).count()
    if not n:
        return []
    place = int(share * (n - 1))
    ends = rows.agg(*[f(F.col(vec)[j]) for f in (F.min, F.max) for j in range(width)]).first()
    low, high, before = np.array(ends[:width], float), np.array(ends[width:], float), np.zeros(width, np.int64)
    while (low < high).any():
        held = rows.sparkSession.sparkContext.broadcast((low, high))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high = held.value
            n, least, most = np.zeros((width, BUCKETS), np.int64), np.full((width, BUCKETS), np.inf), np.full((width, BUCKETS), -np.inf)
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                for j in range(width):
                    v = x[(x[:, j] >= low[j]) & (x[:, j] <= high[j]), j]
                    b = np.minimum(BUCKETS - 1, ((v - low[j]) / ((high[j] - low[j]) / BUCKETS or 1.0)).astype(np.int64))
                    np.add.at(n[j], b, 1)
                    np.minimum.at(least[j], b, v)
                    np.maximum.at(most[j], b, v)
            j, b = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(j), pa.array(b), pa.array(n[j, b]), pa.array(least[j, b]), pa.array(most[j, b])], ["j", "b", "n", "low", "high"])

        parts = rows.where(F.col(vec).isNotNull()).select(vec).mapInArrow(run, "j long, b long, n long, low double, high double")
        counts = parts.groupBy("j", "b").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("j", "b").collect()
        for j in range(width):
            upto = before[j]
            for c in (c for c in counts if c["j"] == j):
                if upto + c["n"] > place:
                    done = (c["low"], c["high"]) == (low[j], high[j])
                    low[j], high[j], before[j] = c["low"], c["low"] if done else c["high"], upto
                    break
                upto += c["n"]
    return [float(x) for x in low]


def cut(x: Column, places: int = 6) -> Column:
    """x cut to so many decimal places. A thousandth of a place is let off, as sums of floats differ in their last bits."""
    unit = float(10**places)
    return F.floor(x * unit + 0.001).cast("double") / unit


def hashed(key: Column, seed: int) -> Column:
    """A number from 0 to 1 (not 1) from an integer key; the same in every run and engine."""
    return F.pmod((key + F.lit(seed)) * F.lit(2654435761), F.lit(4294967296)) / F.lit(4294967296.0)


def quantile_code(rows: DataFrame, share: float) -> DataFrame:
    """(item, slot, code): the first code where the cumulative probability reaches `share`."""
    w = Window.partitionBy("item", "slot").orderBy("code").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("upto", F.sum("p").over(w))
    return run.groupBy("item", "slot").agg(F.sum(F.when(F.round("upto", 9) < share, 1).otherwise(0)).cast("int").alias("code"))


def islands(rows: DataFrame, by: list[str], at: str) -> DataFrame:
    """Runs of consecutive numbers: by, first, last, n."""
    w = Window.partitionBy(*by).orderBy(at)
    runs = rows.select(*by, at).distinct().withColumn("run", F.col(at) - F.row_number().over(w))
    return runs.groupBy(*by, "run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("run")


def amplitude(rows: DataFrame, by: list[str], model: Column) -> DataFrame:
    """Inverse-variance weighted amplitude of a model, over samples that aren't masked; null without any."""
    w = F.when(~F.col("bad"), F.col("weight")).otherwise(F.lit(0.0))
    up, down = F.sum(w * F.col("value") * model), F.sum(w * model * model)
    return rows.groupBy(*by).agg((up / F.nullif(down, F.lit(0.0))).alias("amplitude"))


def smoothed(by: list[str], at: str, value: str, reach: int = 8, sigma: float = 2.0) -> Column:
    """Gaussian mean of a sequence over `reach` samples to either side, over the samples that are there; a gap stays one."""
    w = Window.partitionBy(*by).orderBy(at)
    up, down = F.lit(0.0), F.lit(0.0)
    for d in range(-reach, reach + 1):
        g = math.exp(-0.5 * (d / sigma) ** 2)
        x = F.lag(value, d).over(w) if d >= 0 else F.lead(value, -d).over(w)
        up, down = up + F.coalesce(x * g, F.lit(0.0)), down + F.when(x.isNotNull(), g).otherwise(0.0)
    return F.when(F.col(value).isNotNull(), up / F.nullif(down, F.lit(0.0)))
