"""Similarity by the overlap of slot distributions, and rankings of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The least positive normal float: overlaps are floored here before their logarithm.
FLOOR = 1.17549435e-38


def validated(selection: dict[str, list[int]], known: dict[str, tuple[int, int]]) -> list[tuple[str, int]]:
    """The chosen (mode, slot) pairs, each once, in order; an error for unknown modes, slots out of range or none at all."""
    out = []
    for mode, slots in selection.items():
        if mode not in known:
            raise ValueError(f"unknown mode {mode}")
        first, width = known[mode]
        for slot in sorted(set(slots)):
            if not 0 <= slot < width:
                raise ValueError(f"{mode} has no slot {slot}")
            out.append((mode, first + slot))
    if not out:
        raise ValueError("select at least one slot")
    return out


def checked(selection: dict[str, list[int]], known: dict[str, tuple[int, int]], anywhere: set[str] | frozenset[str] = frozenset(), observed: dict[str, bool] | None = None) -> list[tuple[str, int]]:
    """validated(), and errors for a mode that may match anywhere but has no slot chosen, or that the query wasn't observed in.

    observed tells for each mode that needs an observation whether the query has one; other modes need none.
    """
    chosen = validated(selection, known)
    modes = {m for m, _ in chosen}
    if unselected := sorted(set(anywhere) - modes):
        raise ValueError(f"any position asked for modes without a slot: {', '.join(unselected)}")
    if unseen := sorted(m for m in modes if not (observed or {}).get(m, True)):
        raise ValueError(f"the query has no observation in {', '.join(unseen)}")
    return chosen


def missing(queries: DataFrame, observations: DataFrame, selection: dict[str, list[int]]) -> DataFrame:
    """(item, missing): the selected modes, in order of name, in which each of the queries (item) has no row (item, mode)."""
    wanted = sorted(selection)
    held = observations.where(F.col("mode").isin(wanted)).groupBy("item").agg(F.collect_set("mode").alias("held"))
    return queries.join(held, "item", "left").select("item", F.array_except(F.array(*[F.lit(m) for m in wanted]), F.coalesce("held", F.array().cast("array<string>"))).alias("missing"))


def log_overlap(p: Column, q: Column) -> Column:
    """Log of the floored sum of products; an aggregate."""
    return F.log(F.greatest(F.sum(p * q), F.lit(FLOOR)))


def same_place(gallery: DataFrame, query: DataFrame) -> DataFrame:
    """(item, mode, slot, lo): log overlap of each gallery slot with the query's same slot.

    query is one item's distribution: (slot, code, q), as many rows as an item has codes.
    """
    return gallery.join(F.broadcast(query), ["slot", "code"]).groupBy("item", "mode", "slot").agg(log_overlap(F.col("p"), F.col("q")).alias("lo"))


def any_place(gallery: DataFrame, query: DataFrame) -> DataFrame:
    """(item, mode, q_slot, lo, at): the best slot of the same mode for each query slot; the lowest slot of equal ones.

    query has (mode, q_slot, code, q) of one item.
    """
    each = gallery.join(F.broadcast(query), ["mode", "code"]).groupBy("item", "mode", "q_slot", "slot").agg(F.sum(F.col("p") * F.col("q")).alias("o"))
    best = each.groupBy("item", "mode", "q_slot").agg(F.max(F.struct(F.round("o", 12).alias("r"), (-F.col("slot")).alias("s"), "o")).alias("b"))
    return best.select("item", "mode", "q_slot", F.log(F.greatest(F.col("b.o"), F.lit(FLOOR))).alias("lo"), (-F.col("b.s")).alias("at"))


def totals(overlaps: DataFrame) -> DataFrame:
    return overlaps.groupBy("item", "mode").agg(F.sum("lo").alias("total"))


def combined(rows: DataFrame, always: bool = False) -> DataFrame:
    """(item, score): one mode's raw total, or the mean of the standardised totals of several (of one too with always)."""
    n = rows.select("mode").distinct().count()
    if n == 1 and not always:
        return rows.select("item", F.col("total").alias("score"))
    stats = rows.groupBy("mode").agg(F.avg("total").alias("mean"), F.stddev_pop("total").alias("dev"))
    z = (F.col("total") - F.col("mean")) / F.nullif("dev", F.lit(0.0))
    return rows.join(F.broadcast(stats), "mode").groupBy("item").agg((F.sum(z) / n).alias("score"))


def ranked(scores: DataFrame, query: int, n: int) -> DataFrame:
    """The query at rank 0, then the n best others: highest score first, then the smallest item. One pass that keeps n + 1 rows."""
    order = [F.col("item") != query, F.desc(F.round("score", 9)), F.col("item")]
    best = scores.orderBy(*order).limit(n + 1)
    there = F.max((F.col("item") == query).cast("int")).over(Window.partitionBy())
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - there).where(F.col("rank") <= n)


def neighbours(pairs: DataFrame, k: int, value: str = "score", left: str = "q", right: str = "item", places: int = 9) -> DataFrame:
    """The k best of each `left`, with their rank."""
    w = Window.partitionBy(left).orderBy(F.desc(F.round(value, places)), right)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def log_dot(a: Column, b: Column) -> Column:
    """Log of the floored product of two distributions in arrays."""
    return F.log(F.greatest(dot(a, b), F.lit(FLOOR)))


def mode_scores(pairs: DataFrame, chosen: dict[str, list[int]]) -> DataFrame:
    """Rows (item, dist, q_dist) with one column for each mode of chosen: its slots' log overlaps, summed. No row is exploded."""
    return pairs.select("*", *[sum((log_dot(F.col("dist")[s], F.col("q_dist")[s]) for s in slots[1:]), log_dot(F.col("dist")[slots[0]], F.col("q_dist")[slots[0]])).alias(mode) for mode, slots in chosen.items()])


def contributions(rows: DataFrame, modes: list[str]) -> DataFrame:
    """rows with each mode's column standardised over all rows, over the number of modes; null where all are alike.

    Means and deviations are one row, which meets all others.
    """
    stats = rows.agg(*[f(m).alias(f"_{n}_{m}") for m in modes for n, f in (("mean", F.avg), ("dev", F.stddev_pop))])
    z = {m: (F.col(m) - F.col(f"_mean_{m}")) / F.nullif(F.col(f"_dev_{m}"), F.lit(0.0)) / len(modes) for m in modes}
    return rows.crossJoin(F.broadcast(stats)).select(*[c for c in rows.columns if c not in modes], *[c.alias(m) for m, c in z.items()])


def unit(v: Column) -> Column:
    # the length is worked out once, not once for each number
    return F.flatten(F.transform(F.array(F.sqrt(dot(v, v))), lambda n: F.transform(v, lambda x: x / n)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def against(gallery: DataFrame, queries: DataFrame, score: Column, k: int) -> DataFrame:
    """The k best of the gallery (item, vec) for each of a stated set of queries (q, q_vec), self left out."""
    return neighbours(queries.crossJoin(gallery).where(F.col("q") != F.col("item")).select("q", "item", score.alias("score")), k)
