"""Coded distributions, samples, saliency at any position and selection rules against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom import coded
from starloom.operators import coefficients, linear, saliency, similarity
from starloom.searches import packed
from starloom.sources.relations import CODES, MODES

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("basis", ["fixed", "fitted"])
def test_overlap_on_codes_is_decode_then_dot(spark, basis):
    rows = coded.spectra(spark, D).cache()
    mean, directions = (coded.EVEN, coded.BASIS) if basis == "fixed" else coefficients.fitted(rows, "dist", CODES, 6)
    assert np.allclose(directions @ directions.T, np.eye(len(directions)))
    held = coefficients.coded(rows, "dist", mean, directions).where("item < 60").withColumn("p", coefficients.decoded(coefficients.coefficients(), mean, directions)).cache()
    got = held.orderBy("slot", "item").collect()
    p = {s: np.array([r["p"] for r in got if r["slot"] == s]) for s in (4, 5)}
    assert all(0 <= c <= 255 for r in got for c in r["codes"])
    want = sum(np.log(np.maximum(p[s] @ p[s].T, coded.BASIS_FLOOR)) for s in (4, 5))
    # row by row
    q = held.where("item = 3").withColumn("form", coefficients.query_form(coefficients.coefficients(), mean, directions)).select("slot", "form")
    one = held.join(F.broadcast(q), "slot").withColumn("lo", F.log(coefficients.overlap(F.col("form"), coded.BASIS_FLOOR))).groupBy("item").agg(F.sum("lo").alias("t")).orderBy("item").collect()
    assert np.allclose([r["t"] for r in one], want[3])
    # by tiles
    asked, gallery, score = coded.tile_forms(held, held.where("item < 5"), mean, directions)
    for r in linear.gram_top(asked, gallery, 4, block=17, score=score).collect():
        assert abs(r["score"] - want[r["q"], r["item"]]) < 1e-8
    exact = {(r["item"], r["slot"]): np.array(r["dist"]) for r in rows.collect()}
    if basis == "fitted":  # nearly all of a distribution lies in six directions
        assert np.mean([np.abs(np.array(r["p"]) - exact[r["item"], r["slot"]]).mean() for r in got]) < 0.02


def test_codes_of_flat_and_missing_rows(spark):
    rows = spark.createDataFrame([(1, [0.125] * 8), (2, None)], "item long, dist array<double>")
    got = {r["item"]: r for r in coefficients.coded(rows, "dist", coded.EVEN, coded.BASIS).collect()}
    assert got[1]["codes"] == [0] * coded.BASIS_RANK and got[1]["step"] == 0 and got[2]["codes"] is None


def test_sample_is_the_same_however_partitioned(spark):
    items = spark.range(1000).withColumnRenamed("id", "item")
    queries = items.where("item % 100 = 0")
    key = lambda df: sorted(map(tuple, df.collect()))
    a = key(saliency.sampled(items.repartition(7), queries, 50, block=64))
    assert a == key(saliency.sampled(items.repartition(2), queries.repartition(3), 50, block=5000)) and len(a) == 500
    drawn = saliency.draws(np.array([200]), np.arange(1000))[0].astype(np.int64)
    drawn[200] = 1 << 40
    assert sorted(i for q, i in a if q == 200) == sorted(np.argsort(drawn, kind="stable")[:50])
    assert len({tuple(i for q, i in a if q == x) for x in range(0, 1000, 100)}) == 10  # each query's is another
    assert len(saliency.sampled(items, queries, 5000).collect()) == 10 * 999


def test_sample_without_enough_draws_under_the_bound(spark, monkeypatch):
    items = spark.range(3000).withColumnRenamed("id", "item")
    queries = items.where("item % 1000 = 0")
    want = sorted(map(tuple, saliency.sampled(items, queries, 4).collect()))
    real = saliency.draws
    high = lambda q, i: np.where((q[:, None] == 1000) & (i[None, :] >= 2), real(q, i) | np.uint64(1 << 31), real(q, i))
    monkeypatch.setattr(saliency, "draws", high)
    got = sorted(map(tuple, saliency.sampled(items, queries, 4).collect()))
    assert [x for x in got if x[0] != 1000] == [x for x in want if x[0] != 1000] and len(got) == 12


def test_saliency_is_the_partial_correlation(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(80, 8)) - 2
    v[:, 7] = -1.0  # a slot without any spread
    rows = spark.createDataFrame([(5, i, [float(x) for x in row]) for i, row in enumerate(v)], "q long, item long, values array<double>").repartition(4)
    got = {r["slot"]: r["rho"] for r in saliency.slot_correlations(rows, [1, 4, 4], 8).collect()}
    score, control = v[:, [1, 4]].sum(1), v[:, [0, 2, 3, 5, 6, 7]].mean(1)
    for s in range(7):
        left = [np.ones(80), control]
        rest = lambda y: y - np.stack(left, 1) @ np.linalg.lstsq(np.stack(left, 1), y, rcond=None)[0]
        assert abs(got[s] - np.corrcoef(rest(v[:, s]), rest(score))[0, 1]) < 1e-9
    assert got[7] == 0


def test_any_position_takes_the_best_slot_of_the_mode(spark):
    gallery = packed(spark, D).where("item < 12")
    pairs = gallery.select(F.col("item").alias("q"), F.col("dist").alias("q_dist")).crossJoin(gallery)
    dist = {r["item"]: np.array(r["dist"]) for r in gallery.collect()}
    for r in coded.any_place(pairs, {"table"}).collect():
        a, b = dist[r["q"]], dist[r["item"]]
        for mode, (first, width) in MODES.items():
            for s in range(first, first + width):
                want = max(a[s] @ b[t] for t in range(first, first + width)) if mode == "table" else a[s] @ b[s]
                assert abs(r["values"][s] - np.log(want)) < 1e-9


def test_selection_rules(spark):
    assert similarity.checked({"image": [1, 0, 1]}, MODES, {"image"}, {"image": True}) == [("image", 0), ("image", 1)]
    for selection, anywhere, observed, said in (({}, set(), None, "at least one"), ({"image": []}, set(), None, "at least one"), ({"image": [0]}, {"table"}, None, "table"), ({"image": [0], "spectrum": [0]}, set(), {"spectrum": False}, "spectrum"), ({"image": [4]}, set(), None, "slot"), ({"radio": [0]}, set(), None, "radio")):
        with pytest.raises(ValueError, match=said):
            similarity.checked(selection, MODES, anywhere, observed)
    seen = spark.createDataFrame([(1, "image"), (1, "spectrum"), (2, "image"), (2, "table")], "item long, mode string")
    got = {r["item"]: r["missing"] for r in similarity.missing(spark.range(4).withColumnRenamed("id", "item"), seen, {"spectrum": [0], "image": [0]}).collect()}
    assert got == {0: ["image", "spectrum"], 1: [], 2: ["spectrum"], 3: ["image", "spectrum"]}
