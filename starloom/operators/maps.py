"""Colouring, regions and cross-matching of points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Colour bins of measured values; predicted ones follow, then "no value".
BINS = 32


def color(value: Column, low: Column, high: Column, predicted: Column) -> Column:
    """Bin 0 to 31 of a measured value between low and high, 32 more for a predicted one, 64 for none."""
    span = F.when(high > low, high - low).otherwise(F.lit(1.0))
    place = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((value - low) / span * BINS)))
    return F.when(value.isNull(), F.lit(2 * BINS)).otherwise(place + F.when(predicted, BINS).otherwise(0)).cast("int")


def box(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    xs, ys = zip(*corners, strict=True)
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys))


def lasso(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Inside the polygon, by crossings; its bounding box is a condition of its own that scans can use."""
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
        if ay == by:
            continue
        over = (F.lit(ay) > y) != (F.lit(by) > y)
        crossings = crossings + F.when(over & (x < (y - ay) * ((bx - ax) / (by - ay)) + ax), 1).otherwise(0)
    return box(x, y, corners) & (crossings % 2 == 1)


def separation(ra: Column, dec: Column, o_ra: Column, o_dec: Column) -> Column:
    """Great-circle distance in degrees, from degrees."""
    half = lambda a: F.pow(F.sin(F.radians(a) / 2), 2)
    return F.degrees(2 * F.asin(F.sqrt(half(o_dec - dec) + F.cos(F.radians(dec)) * F.cos(F.radians(o_dec)) * half(o_ra - ra))))


def crossmatch(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Each left (item, ra, dec) with its nearest right one within `radius` degrees, or nulls: match, separation.

    Cells are cubes around the unit sphere, at least as wide as the chord of `radius`, so a match lies in one of 27
    cells at any ra and dec, poles and ra 0/360 included. Rows meet by equal cells; equally near matches go to the
    smallest item.
    """
    wide = 2 * math.sin(math.radians(min(radius, 180.0)) / 2) * (1 + 1e-9) + 1e-12
    ra, dec = F.radians("ra"), F.radians("dec")
    at = {"cx": F.cos(dec) * F.cos(ra), "cy": F.cos(dec) * F.sin(ra), "cz": F.sin(dec)}
    own = {c: F.floor(x / wide) for c, x in at.items()}
    cells = left.select("item", "ra", "dec", *[x.alias(c) for c, x in own.items()])
    for c in own:
        cells = cells.withColumn(c, F.explode(F.array(*[F.col(c) + n for n in (-1, 0, 1)])))
    other = right.select(F.col("item").alias("match"), F.col("ra").alias("o_ra"), F.col("dec").alias("o_dec"), *[x.alias(c) for c, x in own.items()])
    near = cells.join(other, list(own)).withColumn("separation", separation(F.col("ra"), F.col("dec"), F.col("o_ra"), F.col("o_dec"))).where(F.col("separation") <= radius)
    best = near.groupBy("item").agg(F.min(F.struct(F.round("separation", 12).alias("r"), "match", "separation")).alias("b"))
    return left.join(best, "item", "left").select("item", F.col("b.match").alias("match"), F.col("b.separation").alias("separation"))
