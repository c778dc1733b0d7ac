"""Distributions as 8-bit coefficients of a basis: coding, decoding, and overlaps that are worked out on the codes.

A distribution p is mean + c @ directions, for directions of length 1 at right angles. c is kept as whole codes of 0 to
255 with a step and an offset for each row. All is arithmetic on arrays of a row, so it stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.operators.linear import principal, times
from starloom.operators.similarity import dot

#: Greatest code.
LEVELS = 255


def cosines(width: int, rank: int) -> np.ndarray:
    """A fixed basis (rank x width): waves of 1 to rank half turns, of length 1, each without a mean."""
    k, i = np.arange(1, rank + 1)[:, None], np.arange(width)[None, :]
    return np.sqrt(2 / width) * np.cos(np.pi * k * (i + 0.5) / width)


def fitted(rows: DataFrame, dist: str, width: int, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean and the directions (rank x width) along which the rows' distributions vary most."""
    mean, directions, _ = principal(rows, dist, width, rank)
    return mean, directions


def _literal(numbers: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in numbers])


def coded(rows: DataFrame, dist: str, mean: np.ndarray, directions: np.ndarray) -> DataFrame:
    """rows with `codes` (array<int>), `step` and `offset` in place of `dist`: c is offset + step * code, as near as codes allow.

    The offset is the least coefficient and 255 steps reach the greatest, so no coefficient is off by more than half a
    step. Where all are equal the step is 0 and so are the codes. A null distribution has null codes.
    """
    with_c = rows.withColumn("_c", F.when(F.col(dist).isNotNull(), times(F.zip_with(dist, _literal(mean), lambda a, b: a - b), directions)))
    low, high = F.array_min("_c"), F.array_max("_c")
    with_c = with_c.withColumn("offset", low).withColumn("step", (high - low) / LEVELS)
    code = F.transform("_c", lambda c: F.when(F.col("step") > 0, F.floor((c - F.col("offset")) / F.col("step") + 0.5)).otherwise(0).cast("int"))
    return with_c.withColumn("codes", F.when(F.col("_c").isNotNull(), code)).drop("_c", dist)


def coefficients(codes: str = "codes", step: str = "step", offset: str = "offset") -> Column:
    """The coefficients that codes stand for."""
    return F.transform(codes, lambda k: F.col(offset) + F.col(step) * k)


def decoded(c: Column, mean: np.ndarray, directions: np.ndarray) -> Column:
    """The whole distribution of coefficients: mean + c @ directions. It sums to 1 as far as the directions have no mean; it may dip below 0."""
    return F.zip_with(times(c, directions.T), _literal(mean), lambda a, b: a + b)


def query_form(c: Column, mean: np.ndarray, directions: np.ndarray) -> Column:
    """(base, weights, total) of a query's coefficients: what its overlap with any codes needs."""
    projected = directions @ mean
    weights = F.zip_with(c, _literal(projected), lambda a, b: a + b)
    base = F.lit(float(mean @ mean)) + dot(c, _literal(projected))
    return F.struct(base.alias("base"), weights.alias("weights"), F.aggregate(weights, F.lit(0.0), lambda a, x: a + x).alias("total"))


def overlap(form: Column, floor: float, codes: str = "codes", step: str = "step", offset: str = "offset") -> Column:
    """The overlap of a query's form with coded rows, at least `floor`.

    (mean + c D)(mean + k D) is mean.mean + c.(D mean) + k.(D mean + c), as the directions are at right angles, and with k
    as offset + step * code the last product is offset * sum(weights) + step * codes.weights: the codes are never decoded.
    """
    by_codes = dot(F.transform(codes, lambda k: k.cast("double")), form["weights"])
    return F.greatest(form["base"] + F.col(offset) * form["total"] + F.col(step) * by_codes, F.lit(floor))
