"""Quantiles, numbers, medians, parts and scores against data, at the places where they went wrong or might."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom import factored
from starloom.operators import against, factors, linear, statistics
from starloom.sources import stores
from starloom.sources.relations import MODES

INF = float("inf")


def test_quantiles_with_infinite_values(spark):
    numbers = [-INF, *map(float, range(1, 20001))]
    df = spark.createDataFrame([(x,) for x in numbers + [None, float("nan")]], "v double").repartition(5)
    assert statistics.quantiles(df, "v", [0.5, 0.0, 1.0]) == [10000.0, -INF, 20000.0]
    many = spark.createDataFrame([(x,) for x in [INF] * 3 + [-INF] * 2 + [7.0]], "v double")
    assert statistics.quantiles(many, "v", [0.0, 0.2, 0.4, 0.6, 1.0]) == [-INF, -INF, 7.0, INF, INF]
    assert statistics.quantiles(many.where("v > 8"), "v", [0.5]) == [INF] and statistics.quantiles(many.where("v is null"), "v", [0.5]) == [None]


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    for numbers in (rng.normal(size=30000), np.repeat(rng.integers(0, 9, 300), 100).astype(float), np.concatenate([rng.normal(size=15000) * 1e-9, [1e300, -1e300]]), np.full(20000, 2.5)):
        df = spark.createDataFrame([(float(x),) for x in numbers], "v double")
        shares = [0.0, 0.01, 0.25, 0.5, 0.731, 0.99, 1.0]
        assert np.allclose(statistics.quantiles(df, "v", shares), np.quantile(numbers, shares), rtol=1e-12, atol=0)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_numbers_are_dense_over_many_ranges(spark, kind, monkeypatch):
    monkeypatch.setattr(statistics, "NUMBER_SAMPLE", 1000)
    rows = spark.range(0, 300_000, 1, 7).select((F.col("id") * 7919 % 300_007).cast(kind).alias("key"), F.repeat(F.lit("wide"), 50).alias("pad")).repartition(9)
    found = statistics.numbered(rows, "key", "n")
    got = found.agg(F.count("*"), F.countDistinct("n"), F.min("n"), F.max("n"), F.count_if(F.col("n").isNull())).first()
    assert tuple(got) == (300_000, 300_000, 0, 299_999, 0)
    from pyspark.sql import Window

    assert found.withColumn("r", F.lag("n").over(Window.partitionBy(F.lit(1)).orderBy("key"))).where("r >= n").count() == 0


def test_numbers_of_few_rows_and_null_keys(spark):
    df = spark.createDataFrame([(5, "a"), (None, "b"), (2, "c")], "key long, x string")
    assert {r["x"]: r["n"] for r in statistics.numbered(df, "key", "n").collect()} == {"b": 0, "c": 1, "a": 2}
    assert statistics.numbered(df.where("key > 9"), "key", "n").collect() == []


def test_lower_quantiles_of_lists(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(5000, 3))
    x[:, 1] = rng.integers(0, 4, 5000)
    x[:, 2] = 1.5
    df = spark.createDataFrame([(r.tolist(),) for r in x] + [(None,)], "v array<double>").repartition(6)
    for share in (0.0, 0.5, 0.9, 1.0):
        assert statistics.lower_quantiles(df, "v", 3, share) == [float(c) for c in np.sort(x, axis=0)[int(share * 4999)]]
    assert statistics.lower_quantiles(df.where("v is null"), "v", 3, 0.5) == []


def test_parts_are_written_once_and_null_is_a_part(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "x=y/z"), (4, None), (5, "01")], "id long, part string")
    path = f"{tmp_path}/parts"
    for _ in range(3):
        stores.write_parts(df, path, "part")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4, 5]
    os.makedirs(f"{path}/_writing-broken/part=b")
    more = spark.createDataFrame([(9, "b"), (8, "a"), (7, None)], "id long, part string")
    stores.write_parts(more, path, "part")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4, 5, 9]
    assert not [n for n in os.listdir(path) if n.startswith("_")]


def test_free_amplitudes_are_the_best_ones(spark):
    rng = np.random.default_rng(8)
    x, w, m = rng.normal(size=(30, 6)), rng.uniform(0, 2, (30, 6)), rng.normal(size=(4, 6))
    w[3], w[4, :5] = 0, 0  # no data at all; data in one place
    m[2] = 0
    reference = np.sort(x, axis=0)[14]
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, w))], "item long, x array<double>, w array<double>")
    rows = against.prepared(df, reference.tolist()).cache()
    models = spark.createDataFrame([(100 + i, a.tolist()) for i, a in enumerate(m)], "item long, vec array<double>")
    got = {(r["q"], r["item"]): r["score"] for r in linear.gram_top(models, against.packed(rows), 100, block=7, score=against.free_amplitude).collect()}
    chi = lambda model, i: min((((x[i] - a * model) ** 2) * w[i]).sum() for a in ([(model * x[i] * w[i]).sum() / (model**2 * w[i]).sum()] if (model**2 * w[i]).sum() else [0]))
    saturation = {r["item"]: r["saturation"] for r in rows.collect()}
    assert set(saturation) == set(range(30)) - {3}
    for (q, i), score in got.items():
        assert abs(score - (chi(reference, i) - chi(m[q - 100], i)) / 2) < 1e-8 and score <= saturation[i] + 1e-9
        assert abs(saturation[i] - chi(reference, i) / 2) < 1e-9


def test_positive_part_of_an_indefinite_matrix(spark):
    rows = factored.flat(spark, "/root/testdata/sf0.001").where("item < 120").cache()
    held = rows.orderBy("item").collect()
    dist = np.array([r["dist"] for r in held]).reshape(120, 8, -1)
    score = factored.either_way(*MODES["table"])
    matrix = score(dist, dist)[0]
    assert np.allclose(matrix, matrix.T)
    centred = matrix - matrix.mean(0) - matrix.mean(1, keepdims=True) + matrix.mean()
    values, vectors = np.linalg.eigh(centred)
    assert values.min() < -1e-3  # it is indefinite
    places, found = factors.positive(rows, score, 8, rank=119, block=50)
    assert np.allclose(found, values[values > values.max() * 1e-12][::-1][: len(found)], rtol=1e-6, atol=1e-9)
    p = np.array([r["vec"] for r in places.orderBy("item").collect()])
    keep = values > 0
    want = (vectors[:, keep] * values[keep]) @ vectors[:, keep].T
    assert np.abs(p @ p.T - want).max() < 1e-6
    q, gallery = factors.placed(places, places)
    left, right = (np.array([r["vec"] for r in df.orderBy("item").collect()]) for df in (q, gallery))
    assert np.abs(left @ right.T - (want - (np.diag(want) - np.diag(matrix)) / 2)).max() < 1e-6
