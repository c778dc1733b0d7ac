"""Samples that depend on a seed and an item alone: cells, windows in a row, values that are there. The same in every run and partitioning."""

from __future__ import annotations

import heapq
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def word(seed: int, *parts: Column) -> Column:
    """32 hex digits from a seed and keys; null keys count as empty."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *texts).cast("binary"))


def uniform(seed: int, *parts: Column) -> Column:
    """A number from 0 to 1 (not 1)."""
    return F.conv(F.substring(word(seed, *parts), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def some(values: Column, count: int, seed: int, item: Column) -> Column:
    """`count` different ones of an array's values in rising order, all if there are fewer; nulls are never drawn, a null array has none."""
    there = F.array_distinct(F.array_compact(values))
    drawn = F.slice(F.array_sort(F.transform(there, lambda v: F.struct(word(seed, item, v).alias("word"), v.alias("value")))), 1, count)
    return F.array_sort(F.transform(drawn, lambda x: x["value"]))


def cells(total: int, count: int, seed: int, item: Column) -> Column:
    """`count` different cells of 0 to total - 1: some() of them, hashed from a batch of items at a time."""
    suffixes = [str(v).encode() for v in range(total)]

    @F.pandas_udf("array<long>")
    def drawn(items):  # noqa: ANN001, ANN202
        import hashlib

        import pandas as pd

        out = []
        for item in items:
            begun = hashlib.md5(f"{seed}:{item}:".encode())
            words = []
            for v, suffix in enumerate(suffixes):
                word = begun.copy()
                word.update(suffix)
                words.append((word.digest(), v))
            out.append(sorted(v for _, v in heapq.nsmallest(count, words)))
        return pd.Series(out)

    return drawn(F.coalesce(item.cast("string"), F.lit("")))


def window(values: Column, width: int, seed: int, item: Column) -> Column:
    """`width` of an array's different values that follow each other in rising order, each place equally likely; all if there are fewer."""
    ordered = F.sort_array(F.array_distinct(F.array_compact(values)))
    places = F.greatest(F.size(ordered) - width, F.lit(0)) + 1
    return F.slice(ordered, F.floor(uniform(seed, item) * places).cast("int") + 1, width)


def observed(*surveys: Column) -> Column:
    """Whether any of some arrays holds a value."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.size(F.array_compact(s)) > 0, F.lit(False)) for s in surveys])
