"""Sequences on a grid: interpolation, gridding, scales and tokens of positions, crops and patches of images, colours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: First position and width of a token on the wavelength scale.
ORIGIN, TOKEN = 3500.0, 25.6
#: Magnitudes between two photometric zero points, for `rescaled`.
ZERO_POINTS = 4.5


def interpolated(samples: DataFrame, wanted: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """by, at, value at each wanted place: on the line between the samples beside it, the end's value beyond the ends.

    samples has by, at and value, one for each place; wanted has by and at. Both are sorted together within a series, and
    each wanted place takes the last sample up to it and the first from it on.
    """
    both = samples.select(*by, F.col(at).cast("double").alias("at"), F.col(value).alias("value"), F.lit(False).alias("asked"))
    both = both.unionByName(wanted.select(*by, F.col(at).cast("double").alias("at"), F.lit(None).cast("double").alias("value"), F.lit(True).alias("asked")))
    pair = F.when(~F.col("asked"), F.struct("at", "value"))
    order = Window.partitionBy(*by).orderBy("at", "asked")
    back = Window.partitionBy(*by).orderBy(F.desc("at"), "asked")
    both = both.withColumns({"low": F.last(pair, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "high": F.last(pair, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))})
    low, high = F.coalesce("low", "high"), F.coalesce("high", "low")
    share = F.when(high["at"] > low["at"], (F.col("at") - low["at"]) / (high["at"] - low["at"])).otherwise(F.lit(0.0))
    return both.where("asked").select(*by, F.col("at").alias(at), (low["value"] + share * (high["value"] - low["value"])).alias(value))


def gridded(samples: DataFrame, by: list[str], at: str, value: str, first: float, step: float) -> DataFrame:
    """by, cell, total: each sample shared between the two grid cells beside it, nearer ones more: the transpose of interpolation."""
    place = (F.col(at) - first) / step
    low = F.floor(place).cast("long")
    parts = F.array(F.struct(low.alias("cell"), (1 - (place - low)).alias("share")), F.struct((low + 1).alias("cell"), (place - low).alias("share")))
    rows = samples.select(*by, F.col(value).alias("_value"), F.explode(parts).alias("p")).where("p.share > 0")
    return rows.groupBy(*by, F.col("p.cell").alias("cell")).agg(F.sum(F.col("_value") * F.col("p.share")).alias("total"))


def token_of(position: Column) -> Column:
    """The number of the token that a wavelength falls in."""
    return F.floor((position - ORIGIN) / TOKEN).cast("int")


def middle_of(token: Column) -> Column:
    """The wavelength in the middle of a token."""
    return ORIGIN + (token + 0.5) * TOKEN


def rescaled(flux: Column) -> Column:
    """A flux in units of the brighter of two zero points."""
    return flux * F.lit(math.pow(10, -0.4 * ZERO_POINTS))


def cropped(image: Column, height: int, width: int, size: int) -> Column:
    """The middle size x size of an image, an array of rows; halves round to even."""
    top, left = round((height - size) / 2), round((width - size) / 2)
    return F.transform(F.slice(image, top + 1, size), lambda row: F.slice(row, left + 1, size))


def patches(image: Column, size: int, patch: int) -> Column:
    """A square image as patches of patch x patch, row by row: an array of their pixels, each row by row."""
    across = size // patch
    one = lambda k: F.flatten(F.transform(F.slice(image, F.floor(k / across).cast("int") * patch + 1, patch), lambda row: F.slice(row, F.pmod(k, F.lit(across)) * patch + 1, patch)))
    return F.transform(F.sequence(F.lit(0), F.lit(across * across - 1)), one)


def stretched(bands: list[Column], scales: list[float], weights: list[tuple[float, float, float]], softening: float) -> Column:
    """Red, green and blue from 0 to 255: bands scaled, shrunk by the arcsinh of their mean, and mixed by weights."""
    scaled = [b * F.lit(s) for b, s in zip(bands, scales, strict=True)]
    mean = sum(scaled[1:], scaled[0]) / len(scaled)
    shrink = F.when(mean > 0, F.asinh(softening * mean) / (softening * mean)).otherwise(F.lit(0.0))
    mixed = [sum((b * F.lit(w[k]) for b, w in zip(scaled, weights, strict=True)), F.lit(0.0)) * shrink for k in range(3)]
    return F.array(*[F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), m)) * 255).cast("int") for m in mixed])


def axis_ratio(e1: Column, e2: Column) -> Column:
    """Minor over major axis from the two parts of an ellipticity; null for a round shape, which has no measured one."""
    e = F.hypot(e1, e2)
    return F.when(e > 0, (1 - e) / (1 + e))


def wrapped(longitude: Column) -> Column:
    """A longitude turned about, from 0 up to 360."""
    return F.pmod(F.pmod(180 - longitude, F.lit(360.0)) + 360, F.lit(360.0))


def scaled_to(shape: Column, amplitude: Column) -> Column:
    """A predicted shape at its observed flux; the bare shape where there is none."""
    return shape * F.coalesce(amplitude, F.lit(1.0))
