"""A store of sky positions laid out by cells along a space-filling curve, and reads of boxes and cones from it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators.maps import separation

#: Cells halve the sky so often in right ascension and in sine of declination; the first ZONE_BITS halvings of each name a folder.
BITS, ZONE_BITS = 10, 3
#: A region is covered by at most about so many ranges of cells; beyond, neighbouring ranges are joined, and rows tested.
RANGES = 64


def cell_of(ra: Column, dec: Column, bits: int = BITS) -> Column:
    """The cell's number: bits of right ascension and sine of declination by turns, so near cells have near numbers.

    Cells of sin(dec) have equal areas up to the poles. Right ascension counts modulo 360.
    """
    side = 1 << bits
    x = F.least(F.lit(side - 1), F.floor(F.pmod(ra, F.lit(360.0)) / 360.0 * side)).cast("long")
    y = F.least(F.lit(side - 1), F.greatest(F.lit(0), F.floor((F.sin(F.radians(dec)) + 1) / 2 * side))).cast("long")
    spread = lambda v, shift: [F.shiftleft(F.shiftright(v, i).bitwiseAND(F.lit(1)), 2 * i + shift) for i in range(bits)]
    out = F.lit(0).cast("long")
    for part in [*spread(x, 0), *spread(y, 1)]:
        out = out + part
    return out


def write_catalogue(df: DataFrame, path: str, ra: str = "ra", dec: str = "dec", files: int | None = None, rows_per_group: int = 10_000) -> None:
    """df as Parquet in folders of zones, sorted by cell in each, in small row groups, so that a region reads few of them.

    Rows are ranged by cell, so a crowded zone becomes several files. Rows without a position go to zone -1, which no
    region reads.
    """
    cell = F.when(F.col(ra).isNotNull() & F.col(dec).isNotNull(), cell_of(F.col(ra), F.col(dec)))
    rows = df.withColumn("cell", cell).withColumn("zone", F.coalesce(F.shiftright("cell", 2 * (BITS - ZONE_BITS)), F.lit(-1)).cast("int"))
    ranged = rows.repartitionByRange("cell") if files is None else rows.repartitionByRange(files, "cell")
    ranged.sortWithinPartitions("zone", "cell").write.mode("overwrite").option("compression", "zstd").option("parquet.block.row.count.limit", rows_per_group).partitionBy("zone").parquet(path)


def _pieces(low: float, high: float) -> list[tuple[float, float]]:
    """A range of right ascensions as ranges within 0 and 360."""
    if high - low >= 360:
        return [(0.0, 360.0)]
    a, b = low % 360.0, low % 360.0 + (high - low)
    return [(a, b)] if b <= 360 else [(a, 360.0), (0.0, b - 360.0)]


def cover(ra: tuple[float, float], dec: tuple[float, float], bits: int = BITS, most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of cells, first and last, that hold a box. ra may begin below 0 or end above 360; it runs upwards."""
    side = 1 << bits
    at = lambda d: min(side - 1, max(0, math.floor((math.sin(math.radians(max(-90.0, min(90.0, d)))) + 1) / 2 * side)))
    y0, y1 = max(0, at(dec[0]) - 1), min(side - 1, at(dec[1]) + 1)  # a cell of slack for rounding
    boxes = [(max(0, math.floor(a / 360 * side) - 1), min(side - 1, math.floor(b / 360 * side) + 1), y0, y1) for a, b in _pieces(*ra)]
    found: list[tuple[int, int]] = []

    def walk(x: int, y: int, size: int, first: int) -> None:
        x1, y1_ = x + size - 1, y + size - 1
        touching = [b for b in boxes if b[0] <= x1 and b[1] >= x and b[2] <= y1_ and b[3] >= y]
        if not touching:
            return
        if size == 1 or any(b[0] <= x and b[1] >= x1 and b[2] <= y and b[3] >= y1_ for b in touching):
            last = first + size * size - 1
            if found and found[-1][1] == first - 1:
                found[-1] = (found[-1][0], last)
            else:
                found.append((first, last))
            return
        half = size // 2
        for k, (dx, dy) in enumerate(((0, 0), (half, 0), (0, half), (half, half))):
            walk(x + dx, y + dy, half, first + k * half * half)

    walk(0, 0, side, 0)
    while len(found) > most:  # join the two ranges that lie nearest
        gaps = [found[i + 1][0] - found[i][1] for i in range(len(found) - 1)]
        i = gaps.index(min(gaps))
        found[i : i + 2] = [(found[i][0], found[i + 1][1])]
    return found


def _within(ranges: list[tuple[int, int]]) -> Column:
    """zone for the folders, cell for the row groups."""
    shift = 2 * (BITS - ZONE_BITS)
    zones = sorted({z for a, b in ranges for z in range(a >> shift, (b >> shift) + 1)})
    cells = F.lit(False)
    for a, b in ranges:
        cells = cells | F.col("cell").between(a, b)
    return F.col("zone").isin(zones) & cells & F.col("cell").between(ranges[0][0], ranges[-1][1])


def _ra_within(ra: str, low: float, high: float) -> Column:
    out = F.lit(False)
    for a, b in _pieces(low, high):
        out = out | F.pmod(F.col(ra), F.lit(360.0)).between(a, b)
    return out


def read_box(spark: SparkSession, path: str, ra: tuple[float, float], dec: tuple[float, float], ra_col: str = "ra", dec_col: str = "dec", columns: list[str] | None = None) -> DataFrame:
    """Rows of a catalogue within a box, edges included. ra runs upwards and may cross 0/360 (350 to 370, or -10 to 10)."""
    if ra[1] < ra[0] or dec[1] < dec[0]:
        raise ValueError("a box runs from low to high")
    rows = spark.read.parquet(path).where(_within(cover(ra, dec)))
    rows = rows.where(F.col(dec_col).between(*dec) & _ra_within(ra_col, *ra))
    return rows.select(*columns) if columns else rows.drop("zone", "cell")


def read_cone(spark: SparkSession, path: str, ra: float, dec: float, radius: float, ra_col: str = "ra", dec_col: str = "dec", columns: list[str] | None = None) -> DataFrame:
    """Rows of a catalogue within `radius` degrees of a place. Over a pole all right ascensions are read."""
    low, high = dec - radius, dec + radius
    if low <= -90 or high >= 90:
        wide = 180.0
    else:
        wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(radius)) / math.cos(math.radians(dec))))) + 1e-9 if radius < 90 else 180.0
    rows = spark.read.parquet(path).where(_within(cover((ra - wide, ra + wide), (max(-90.0, low), min(90.0, high)))))
    rows = rows.where(separation(F.lit(float(ra)), F.lit(float(dec)), F.col(ra_col), F.col(dec_col)) <= radius)
    return rows.select(*columns) if columns else rows.drop("zone", "cell")
