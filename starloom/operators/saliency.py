"""Which slots drive a similarity: partial correlation over the other items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.operators.linear import met, numbers
from starloom.sources.shared import stored

#: Other items that a saliency at any position looks at.
SAMPLE = 512


def partial_correlations(overlaps: DataFrame, query: int) -> DataFrame:
    """(slot, rho): correlation of a slot's standardised log overlap with the score, given the mean agreement.

    overlaps is (item, slot, lo). The query is left out. The score of an item is the mean of its standardised slots; the
    control is the mean of its log overlaps. Where a correlation isn't defined rho is 0; it stays within -1 and 1.
    """
    rows = overlaps.where(F.col("item") != query)
    stats = rows.groupBy("slot").agg(F.avg("lo").alias("mean"), F.stddev_pop("lo").alias("dev"))
    rows = rows.join(F.broadcast(stats), "slot").withColumn("z", F.coalesce((F.col("lo") - F.col("mean")) / F.nullif("dev", F.lit(0.0)), F.lit(0.0)))
    items = rows.groupBy("item").agg(F.avg("z").alias("score"), F.avg("lo").alias("control"))
    both = rows.join(items, "item").groupBy("slot").agg(correlation(F.col("z"), F.col("score")).alias("a"), correlation(F.col("z"), F.col("control")).alias("b"), correlation(F.col("score"), F.col("control")).alias("c"))
    low = F.sqrt((1 - F.col("b") * F.col("b")) * (1 - F.col("c") * F.col("c")))
    rho = F.when(low > 1e-12, (F.col("a") - F.col("b") * F.col("c")) / low)
    return both.select("slot", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(rho, F.lit(0.0)))).alias("rho"))


def correlation(a: Column, b: Column) -> Column:
    """corr() that is null, not an error, where one side has no spread; an aggregate."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers below 2 ** 32 spread over that range (the finaliser of murmur3)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(16))) * np.uint64(2246822507) % np.uint64(1 << 32)
    x = (x ^ (x >> np.uint64(13))) * np.uint64(3266489909) % np.uint64(1 << 32)
    return x ^ (x >> np.uint64(16))


def draws(queries: np.ndarray, items: np.ndarray) -> np.ndarray:
    """A number below 2 ** 32 for each query and item, keyed by the query."""
    low, span = np.uint64(1 << 32), lambda x: x.astype(np.uint64) % np.uint64(1 << 32)
    return mixed((mixed(span(queries))[:, None] + (span(items) * np.uint64(2654435761) % low)[None, :]) % low)


def sampled(items: DataFrame, queries: DataFrame, size: int = SAMPLE, block: int = 4096) -> DataFrame:
    """(q, item): for each of the queries (item), the `size` other items with the least draws, equal ones by item.

    A bottom-k sample by a keyed hash: the same in every run and however the tables are partitioned. Blocks of queries meet
    blocks of items, and each leaves its least draws of each query, so the table is never sorted. Draws are even, so a
    bound that about `size` of them lie under keeps all but a few of the others out of the shuffle; a query that finds too
    few under it is asked again without it.
    """
    n = items.count()
    bound = int(min(1 << 32, (1 << 32) * (size + 8 * size**0.5 + 8) / max(1, n)))

    def drawn(queries: DataFrame, bound: int) -> DataFrame:
        def made(ours: pa.StructArray, theirs: pa.StructArray) -> Iterator[pa.RecordBatch]:
            q, found = numbers(ours, "item"), np.sort(numbers(theirs, "item"))
            draw = draws(q, found).astype(np.int64)
            draw[q[:, None] == found[None, :]] = 1 << 40
            best = np.argsort(draw, axis=1, kind="stable")[:, :size]
            least = np.take_along_axis(draw, best, 1)
            kept = least < bound
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, kept.sum(1))), pa.array(found[best][kept]), pa.array(least[kept])], ["q", "item", "draw"])

        pairs = met(queries.select("item"), items.select("item"), made, "q long, item long, draw long", block)
        nth = F.row_number().over(Window.partitionBy("q").orderBy("draw", "item"))
        return pairs.withColumn("nth", nth).where(F.col("nth") <= size).select("q", "item")

    if bound == 1 << 32:
        return drawn(queries, bound)
    first = stored(drawn(queries, bound))
    full = first.groupBy(F.col("q").alias("item")).count().where(F.col("count") >= size).select("item")
    short = stored(queries.select("item").join(full, "item", "left_anti"))
    if short.isEmpty():
        return first
    return first.join(full.withColumnRenamed("item", "q"), "q", "left_semi").unionByName(drawn(short, 1 << 32))


def slot_correlations(values: DataFrame, chosen: list[int], slots: int) -> DataFrame:
    """(q, slot, rho) of rows (q, item, values): each slot's correlation with the score, given the control.

    The score of an item is the sum of its values at the chosen slots, the control the mean of the others. One
    aggregate of sums for each query; rho is 0 where it isn't defined.
    """
    wanted = sorted(set(chosen))
    rest = [s for s in range(slots) if s not in wanted]
    add = lambda which: sum((F.col("values")[s] for s in which), F.lit(0.0))
    rows = values.select("q", "values", add(wanted).alias("score"), (add(rest) / max(1, len(rest))).alias("control"))
    both = rows.groupBy("q").agg(correlation(F.col("score"), F.col("control")).alias("c"), F.array(*[F.struct(F.lit(s).alias("slot"), correlation(F.col("values")[s], F.col("score")).alias("a"), correlation(F.col("values")[s], F.col("control")).alias("b")) for s in range(slots)]).alias("x"))
    low = F.sqrt((1 - F.col("b") * F.col("b")) * (1 - F.col("c") * F.col("c")))
    rho = F.when(low > 1e-12, (F.col("a") - F.col("b") * F.col("c")) / low)
    return both.select("q", "c", F.explode("x").alias("x")).select("q", "x.slot", "x.a", "x.b", "c").select("q", "slot", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(rho, F.lit(0.0)))).alias("rho"))
