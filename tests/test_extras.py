"""Low-rank factors, ridge regression, interpolation and stores against numpy and small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom import extras, queries
from starloom.operators import linear, spectra, statistics
from starloom.sources import stores
from starloom.sources.relations import vectors

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def matrix(spark):
    rows = vectors(spark, SF).orderBy("item").collect()
    return np.array([r["item"] for r in rows]), np.array([r["vec"] for r in rows]), np.array([float(r["label"]) for r in rows])


def test_components(spark, matrix):
    items, x, _ = matrix
    centred = x - x.mean(0)
    _, _, directions = np.linalg.svd(centred, full_matrices=False)
    found = {(r["item"], r["k"]): r["value"] for r in extras.b5_components(spark, SF).collect()}
    for k in range(4):
        expected = centred @ directions[k]
        got = np.array([found[i, k] for i in items.tolist()])
        assert min(np.abs(got - expected).max(), np.abs(got + expected).max()) < 2e-5


def test_ridge(spark, matrix):
    items, x, y = matrix
    folds = items % 5

    def out_of_fold(penalty):
        out = np.zeros(len(y))
        for f in range(5):
            a, b = x[folds != f], y[folds != f]
            centred = a - a.mean(0)
            w = np.linalg.solve(centred.T @ centred + penalty * np.eye(64), centred.T @ (b - b.mean()))
            out[folds == f] = (x[folds == f] - a.mean(0)) @ w + b.mean()
        return out

    best = min(linear.PENALTIES, key=lambda p: ((out_of_fold(p) - y) ** 2).sum())
    found = {r["item"]: r["predicted"] for r in extras.b14_ridge(spark, SF).collect()}
    assert np.allclose([found[i] for i in items.tolist()], out_of_fold(best), atol=1e-5)


def test_tiles_don_t_change_the_best(spark):
    v = vectors(spark, SF).select("item", "vec")
    of = lambda block: sorted(tuple(r) for r in linear.gram_top(v.where("item % 20 = 0"), v, 7, block).collect())
    assert of(13) == of(5000) and len(of(13)) > 0
    assert linear.gram_top(v.limit(0), v, 3).count() == 0


def test_interpolation_is_numpy_s(spark):
    samples = [("a", 1.0, 5.0), ("a", 2.0, 7.0), ("a", 4.0, 1.0), ("b", 3.0, 2.0)]
    wanted = [(s, x) for s in "ab" for x in (0.0, 1.0, 1.5, 3.0, 3.9, 4.0, 9.0)]
    found = spectra.interpolated(spark.createDataFrame(samples, "s string, x double, y double"), spark.createDataFrame(wanted, "s string, x double"), ["s"], "x", "y")
    got = {(r["s"], r["x"]): r["y"] for r in found.collect()}
    for s, x in wanted:
        xs, ys = zip(*[(a, b) for name, a, b in samples if name == s], strict=True)
        assert abs(got[s, x] - np.interp(x, xs, ys)) < 1e-12


def test_gridding_is_the_transpose_of_interpolation(spark):
    rng = np.random.default_rng(1)
    x, y = rng.uniform(0, 9, 30), rng.normal(size=30)
    rows = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y, strict=True)], "s string, x double, y double")
    found = {r["cell"]: r["total"] for r in spectra.gridded(rows, ["s"], "x", "y", 0.0, 1.0).collect()}
    for cell in range(11):
        assert abs(found.get(cell, 0.0) - (np.interp(x, range(11), np.eye(11)[cell]) * y).sum()) < 1e-9


def test_smoothing_keeps_gaps_and_reaches_four_deviations(spark):
    values = [1.0, None, 3.0, 8.0, 2.0, 5.0, 1.0, 9.0, 4.0, 4.0, 7.0, 3.0]
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "s string, i int, v double")
    got = [r["x"] for r in rows.select("i", statistics.smoothed(["s"], "i", "v").alias("x")).orderBy("i").collect()]
    for i, v in enumerate(values):
        w = [(np.exp(-0.5 * ((j - i) / 2) ** 2), u) for j, u in enumerate(values) if u is not None and abs(j - i) <= 8]
        assert got[i] is None if v is None else abs(got[i] - sum(a * b for a, b in w) / sum(a for a, _ in w)) < 1e-12


def test_stores(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 4).alias("part"), F.when(F.col("id") % 2 == 0, 'a "b').alias("name"))
    stores.write_store(df, f"{tmp_path}/store", "id", 3)
    assert spark.read.parquet(f"{tmp_path}/store").count() == 100
    stores.write_parts(df.where("part < 2"), f"{tmp_path}/parts", "part")
    stores.write_parts(df.withColumn("id", F.col("id") + 1000), f"{tmp_path}/parts", "part")
    got = spark.read.parquet(f"{tmp_path}/parts").groupBy("part").agg(F.min("id").alias("low"), F.count("*").alias("n")).collect()
    assert {r["part"]: (r["low"], r["n"]) for r in got} == {0: (0, 25), 1: (1, 25), 2: (1002, 25), 3: (1003, 25)}
    stores.write_ecsv(df.where("id < 3").orderBy("id"), f"{tmp_path}/e", {"made": "now"})
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/e").collect()]
    assert lines[0] == "# %ECSV 1.0" and "#   made: now" in lines and lines[-3:] == ['0 0 "a ""b"', '1 1 ""', '2 2 "a ""b"']
    stores.write_csv(df, f"{tmp_path}/c", ["id", "name"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").columns == ["id", "name"]


def test_extras_are_registered():
    assert {"b7_gram_tiles", "f12_interpolated", "w6_inverse_sample"} <= set(queries.ORACLE_SQL)
