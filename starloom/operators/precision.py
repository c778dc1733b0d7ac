"""Average precision of many scores at once, with ties as one place, and what it says of phrases and their opposites."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.operators import linear, similarity, statistics
from starloom.sources.shared import stored

#: Ranges that the values of a score are cut into, and places to which scores are compared.
RANGES, PLACES = 256, 9
#: Hits that a task holds, 16 bytes each, and rows of the gallery that meet its queries at a time.
HITS, STREAM = 1 << 25, 4096
#: Sides of a measured value: above its upper tercile, under its lower one; each is the other's opposite.
SIDES = {"high": "low", "low": "high"}


def in_ranges(values: DataFrame, by: str, at: str, counted: list[str]) -> DataFrame:
    """values (by, at, counts) with upto_COUNT and all_COUNT: each count summed over what is at least as high, and over all of `by`.

    values is a written table with one row for each distinct `at`. They are cut into ranges, the ranges' counts are added up,
    and only a range's own values are put in order. Bounds are written before they are used, as a rerun of the sketch might
    give others.
    """
    shares = [i / RANGES for i in range(1, RANGES)]
    bounds = stored(values.groupBy(F.col(by).alias("_by")).agg(F.array_distinct(F.percentile_approx(at, shares, 10_000)).alias("_bounds")))
    ranged = values.join(bounds, F.col(by).eqNullSafe(F.col("_by"))).withColumn("_range", F.coalesce(F.size(F.filter("_bounds", lambda b: b > F.col(at))), F.lit(0))).drop("_by", "_bounds")
    sums = ranged.groupBy(by, "_range").agg(*[F.sum(c).alias(c) for c in counted])
    w = Window.partitionBy(by).orderBy("_range")  # at most RANGES rows
    before = [(F.sum(c).over(w) - F.col(c)).alias(f"_before_{c}") for c in counted]
    total = [F.sum(c).over(Window.partitionBy(by)).alias(f"all_{c}") for c in counted]
    sums = sums.select(F.col(by).alias("_by"), F.col("_range").alias("_r"), *before, *total)
    placed = ranged.join(sums, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r")))
    inside = Window.partitionBy(by, "_range").orderBy(F.desc(at))
    placed = placed.withColumns({f"upto_{c}": F.col(f"_before_{c}") + F.sum(c).over(inside) for c in counted})
    return placed.drop("_by", "_r", "_range", *[f"_before_{c}" for c in counted])


def average_precision(rows: DataFrame, by: str, score: str, sides: list[str]) -> DataFrame:
    """(by, one number for each side) of rows (by, score, sides as booleans): the mean precision over a side's rows, highest scores first.

    Rows of equal score are one place, so their order never matters, and no score is sorted whole. Rows without score (null,
    NaN) are left out, null sides are false; a side without rows has null.
    """
    value = F.col(score).cast("double")
    hit = lambda side: F.sum(F.when(F.col(side), 1).otherwise(0)).alias(side)
    known = rows.where(value.isNotNull() & ~F.isnan(value)).withColumn("_at", value + 0.0)
    values = stored(known.groupBy(by, "_at").agg(F.count("*").alias("_n"), *[hit(s) for s in sides]))
    placed = in_ranges(values, by, "_at", ["_n", *sides])
    parts = placed.select(by, *[(F.col(s) / F.when(F.col(f"all_{s}") > 0, F.col(f"all_{s}")) * F.col(f"upto_{s}") / F.col("upto__n")).alias(s) for s in sides])
    return parts.groupBy(by).agg(*[F.sum(s).alias(s) for s in sides])


@dataclass
class _Held:
    """What a task knows of its queries: their hits' scores and places in the stream, the first of query i at starts[i], and the rows before each.

    Of each query the hits so far; of all the rows that streamed by, both times.
    """

    starts: np.ndarray
    score: np.ndarray
    place: np.ndarray
    before: np.ndarray
    filled: np.ndarray
    seen: int = 0

    def add(self, keys: np.ndarray, hit: np.ndarray) -> None:
        r, c = np.nonzero(hit)
        each = hit.sum(1)
        first = np.cumsum(each) - each
        at = self.starts[r] + self.filled[r] + np.arange(len(r)) - first[r]
        self.score[at], self.place[at] = keys[r, c], self.seen + c
        self.filled += each

    def order(self) -> None:
        for i in range(len(self.filled)):
            here = slice(self.starts[i], self.starts[i] + self.filled[i])
            by = np.argsort(self.score[here], kind="stable")  # the stream comes by item, so equal ones stay by item
            self.score[here], self.place[here] = self.score[here][by], self.place[here][by]

    def count(self, keys: np.ndarray, out: np.ndarray, start: int) -> None:
        """Each row that is not `out` counts before the first hit behind it; `start` is the first row's place in the stream."""
        keys = np.where(out, np.inf, keys)
        for i in range(len(keys)):
            n, first = self.filled[i], self.starts[i]
            if not n:
                continue
            hits, x = self.score[first : first + n], np.sort(keys[i])
            at = np.searchsorted(hits, x)
            if (hits.take(at, mode="clip") == x).any():  # equal scores go by item
                x = keys[i]
                at, high = np.searchsorted(hits, x), np.searchsorted(hits, x, "right")
                mine = start + np.arange(len(x))
                while (open_ := np.flatnonzero(at < high)).size:
                    middle = (at[open_] + high[open_]) // 2
                    less = self.place[first + middle] < mine[open_]
                    at[open_], high[open_] = np.where(less, middle + 1, at[open_]), np.where(less, high[open_], middle)
                at = np.sort(at)
            at = at[: np.searchsorted(at, n)]  # what comes behind all hits
            edge = np.flatnonzero(np.diff(at, prepend=-1))
            self.before[first + at[edge]] += np.diff(edge, append=len(at))


def label_precision(queries: DataFrame, gallery: DataFrame, top: int = 10) -> DataFrame:
    """(q, ap, best): mean precision over the rows of gallery (item, vec, label) with a query's label, by their product, and the share of those among the `top`.

    Products are compared to PLACES places, equal ones by item; self is left out, no label is like none. A task holds a block
    of queries (item, vec, label); the gallery streams by twice: at first the hits of the block are kept, then all other rows are counted
    between them. What is held is a number of hits for each task, so blocks are smaller where labels are larger; no ranking is made whole.
    """
    sizes = gallery.where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("hits"))
    held = stored(queries.select("item", "vec", "label").join(sizes, "label", "left").select("item", "vec", "label", F.coalesce("hits", F.lit(0)).alias("hits")))
    cells = held.agg(F.sum("hits")).first()[0] or 0
    rows = gallery.count()

    def made(ours: pa.StructArray, theirs: pa.StructArray, state: _Held | None) -> _Held:
        qi, q, label = (linear.numbers(theirs, c) for c in ("item", "vec", "label"))
        if state is None:
            hits = linear.numbers(theirs, "hits")
            total = int(hits.sum())
            state = _Held(np.cumsum(hits) - hits, np.zeros(total), np.zeros(total, np.int32), np.zeros(total, np.int32), np.zeros(len(qi), np.int64))
        gi, g, other = (linear.numbers(ours, c) for c in ("item", "vec", "label"))
        keys = 0.0 - np.round(q.astype(np.float64) @ g.astype(np.float64).T, PLACES)
        own = qi[:, None] == gi[None, :]
        hit = (label[:, None] == other[None, :]) & ~own
        if state.seen < rows:
            state.add(keys, hit)
        else:
            if state.seen == rows:
                state.order()
            state.count(keys, hit | own, state.seen - rows)
        state.seen += len(gi)
        return state

    def ended(state: _Held, theirs: pa.StructArray) -> Iterator[pa.RecordBatch]:
        ap, best = [], []
        for first, n in zip(state.starts, state.filled):
            nth = np.arange(1, n + 1)
            rank = np.cumsum(state.before[first : first + n], dtype=np.int64) + nth
            ap.append(float((nth / rank).mean()) if n else None)
            best.append(float((rank <= top).sum() / top))
        yield pa.RecordBatch.from_arrays([theirs.field("item"), pa.array(ap, pa.float64()), pa.array(best, pa.float64()), pa.array([rows] * len(ap))], ["q", "ap", "best", "n"])

    count = linear.held_blocks(held, cells, HITS)
    found = linear.met(gallery.select("item", "vec", "label"), held, made, "q long, ap double, best double, n long", ended=ended, count=count, stream=STREAM, times=2)
    return found.where("n > 1").drop("n")


def terciles(rows: DataFrame, value: str) -> dict[str, Column]:
    """high, low and known of a measured value; the terciles are interpolated quantiles of what is known."""
    finite = F.col(value).isNotNull() & ~F.isnan(value)
    low, high = statistics.quantiles(rows.where(finite), value, [1 / 3, 2 / 3])
    bound = lambda x: F.lit(x).cast("double")
    return {"high": finite & (F.col(value) > bound(high)), "low": finite & (F.col(value) < bound(low)), "known": finite}


def edited(first: np.ndarray, second: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Unit directions on both sides of the middle of two, one pair for each step: rows of all plus, then of all minus."""
    middle, half = (first + second) / 2, np.linalg.norm(first - second) / 2
    both = np.concatenate([middle + half * steps, middle - half * steps])
    return both / np.linalg.norm(both, axis=1, keepdims=True)


@dataclass(frozen=True)
class Phrasings:
    """Directions of phrases: for each name the one of its high side and the one of its low side; edits and chance to hold them against."""

    pairs: dict[str, tuple[np.ndarray, np.ndarray]]
    steps: np.ndarray
    chance: np.ndarray

    def directions(self) -> np.ndarray:
        """All directions: high and low of each pair, each pair's edits, then those of chance."""
        texts = [d for pair in self.pairs.values() for d in pair]
        edits = [edited(*pair, self.steps) for pair in self.pairs.values()]
        return np.concatenate([np.array(texts), *edits, self.chance])


def phrase_rows(rows: DataFrame, vec: str, value: str, found: Phrasings, top: int = 10) -> DataFrame:
    """One row for each phrase and side: how well the score along its direction finds that side of a measured value.

    average_precision over rows whose value is known, its base_rate, specificity (what the opposite phrase falls short of it),
    edit_null and random_null (levels that 95 % of the differences between edits and of chance directions stay under),
    passes, precision and opposite_precision among the `top` known rows, measured share of the `top` rows. Rows of equal score
    are taken by item. Numbers are null where no row is known or a side is empty. What is collected is two numbers for each direction.
    """
    spark: SparkSession = rows.sparkSession
    directions = found.directions()
    sides = terciles(rows, value)
    scored = rows.select("item", *[c.alias(n) for n, c in sides.items()], linear.times(F.col(vec), directions).alias("scores"))
    scored = stored(scored.select("item", *sides, F.transform("scores", lambda x: F.round(x, PLACES)).alias("scores")))
    long = scored.where("known").select(F.posexplode("scores").alias("which", "score"), *SIDES)
    precision = {r["which"]: r for r in average_precision(long, "which", "score", list(SIDES)).collect()}
    rates = scored.where("known").agg(*[F.avg(F.col(s).cast("double")).alias(s) for s in SIDES]).first()

    texts = range(2 * len(found.pairs))
    few = scored.select(F.posexplode(F.slice("scores", 1, len(texts))).alias("which", "score"), "item", *sides)
    flags = ["high", "low", "known"]
    share = lambda df: {r["which"]: r for r in similarity.neighbours(df, top, "score", "which", "item").groupBy("which").agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in flags]).collect()}
    shown, page = share(few), share(few.where("known"))

    def ap(which: int, side: str) -> float:
        x = precision[which][side] if which in precision else None
        return float("nan") if x is None else x

    count, out = len(found.steps), []
    first_chance = len(texts) + 2 * count * len(found.pairs)
    null = {s: np.quantile([ap(first_chance + i, s) for i in range(len(found.chance))], 0.95) for s in SIDES}
    for k, name in enumerate(found.pairs):
        plus = len(texts) + 2 * count * k
        for i, (side, opposite) in enumerate(SIDES.items()):
            own, other = ap(2 * k + i, side), ap(2 * k + 1 - i, side)
            edit = np.quantile([abs(ap(plus + j, side) - ap(plus + count + j, side)) for j in range(count)], 0.95)
            rate = float("nan") if rates[side] is None else rates[side]
            mine, all_rows = page.get(2 * k + i), shown.get(2 * k + i)
            numbers = [own, rate, own - other, edit, null[side], *([mine[side], mine[opposite]] if mine else [np.nan] * 2), all_rows["known"] if all_rows else np.nan]
            out.append((name, side, bool(own - other > edit and own > rate), *[None if np.isnan(x) else round(float(x), 6) for x in numbers]))
    names = ["average_precision", "base_rate", "specificity", "edit_null", "random_null", "precision", "opposite_precision", "measured"]
    return spark.createDataFrame(out, "phrase string, side string, passes boolean, " + ", ".join(f"{n} double" for n in names))
