"""Catalogues by sky cell: what a region reads, and that it reads all of it."""

import glob
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from starloom.sources import sky

RANDOM = random.Random(2)


@pytest.fixture(scope="module")
def rows():
    out = [(i, RANDOM.uniform(0, 360), float(np.degrees(np.arcsin(RANDOM.uniform(-1, 1))))) for i in range(20000)]
    out += [(50000 + i, RANDOM.uniform(149, 151), RANDOM.uniform(1, 3)) for i in range(20000)]  # a crowded field
    return out + [(90000, 0.0, 90.0), (90001, 0.0, -90.0), (90002, 360.0, 0.0), (90003, 0.0, 0.0), (90004, -5.0, 10.0), (90005, None, 3.0), (90006, 3.0, None)]


@pytest.fixture(scope="module")
def path(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sky") / "catalogue")
    sky.write_catalogue(spark.createDataFrame(rows, "item long, ra double, dec double"), at, files=8, rows_per_group=500)
    return at


def inside(rows, ra, dec):
    return sorted(i for i, a, d in rows if a is not None and d is not None and dec[0] <= d <= dec[1] and any(ra[0] <= a % 360 + k <= ra[1] for k in (-720, -360, 0, 360, 720)))


@pytest.mark.parametrize(("ra", "dec"), [((149.5, 150.5), (1.5, 2.5)), ((350.0, 370.0), (-10.0, 10.0)), ((-10.0, 10.0), (-10.0, 10.0)), ((0.0, 360.0), (80.0, 90.0)), ((10.0, 20.0), (-90.0, -60.0)), ((0.0, 0.0), (0.0, 0.0)), ((354.0, 356.0), (9.0, 11.0)), ((100.0, 600.0), (-90.0, 90.0))])
def test_boxes_are_whole(spark, rows, path, ra, dec):
    found = sorted(r["item"] for r in sky.read_box(spark, path, ra, dec).select("item").collect())
    assert found == inside(rows, ra, dec)


@pytest.mark.parametrize(("ra", "dec", "radius"), [(150.0, 2.0, 0.3), (0.5, 0.0, 4.0), (20.0, 88.0, 5.0), (200.0, -89.9, 2.0), (0.0, 90.0, 10.0), (40.0, 30.0, 100.0)])
def test_cones_are_whole(spark, rows, path, ra, dec, radius):
    def apart(a, d):
        a, d, ra_, dec_ = map(np.radians, (a, d, ra, dec))
        return np.degrees(2 * np.arcsin(np.sqrt(np.sin((d - dec_) / 2) ** 2 + np.cos(d) * np.cos(dec_) * np.sin((a - ra_) / 2) ** 2)))

    want = sorted(i for i, a, d in rows if a is not None and d is not None and apart(a, d) <= radius)
    assert sorted(r["item"] for r in sky.read_cone(spark, path, ra, dec, radius).select("item").collect()) == want


def groups_touched(path, ranges):
    """Files and row groups of the store, and those whose cells meet the ranges."""
    files = total = touched = 0
    for f in glob.glob(f"{path}/zone=*/*.parquet"):
        files += 1
        meta = pq.ParquetFile(f).metadata
        at = meta.schema.to_arrow_schema().names.index("cell")
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(at).statistics
            total += 1
            touched += stats.has_min_max and any(a <= stats.max and b >= stats.min for a, b in ranges)
    return files, total, touched


def test_a_small_box_reads_few_files_and_row_groups(spark, path):
    ra, dec = (149.9, 150.1), (1.9, 2.1)
    found = sky.read_box(spark, path, ra, dec)
    assert all("zone=" in f for f in found.inputFiles())
    files, total, touched = groups_touched(path, sky.cover(ra, dec))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "zone" in plan and "PushedFilters" in plan and "GreaterThanOrEqual(cell" in plan
    scan = found.select("item")
    scan.collect()
    metrics = scan._jdf.queryExecution().executedPlan()
    while metrics.children().size():
        metrics = metrics.children().apply(0)
    values = metrics.metrics()
    read_files, read_rows = values.apply("numFiles").value(), values.apply("numOutputRows").value()
    assert read_files <= files / 4 and touched <= total / 8 and read_rows <= 0.2 * 40000, (files, read_files, total, touched, read_rows)


def test_cells_cover_their_boxes(spark):
    for ra, dec in (((3.0, 7.0), (-3.0, 4.0)), ((-2.0, 2.0), (70.0, 90.0))):
        ranges = sky.cover(ra, dec, most=5)
        assert len(ranges) <= 5 and all(a <= b for a, b in ranges)
        points = [(RANDOM.uniform(*ra), RANDOM.uniform(*dec)) for _ in range(300)]
        cells = spark.createDataFrame(points, "ra double, dec double").select(sky.cell_of(F.col("ra"), F.col("dec")).alias("c")).collect()
        assert all(any(a <= r["c"] <= b for a, b in ranges) for r in cells)


def test_wrong_boxes(spark, path):
    with pytest.raises(ValueError, match="low to high"):
        sky.read_box(spark, path, (20.0, 10.0), (0.0, 1.0))
