"""Average precision, rank agreement and rows of phrases against brute force."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from starloom.operators import precision, ranks
from starloom.operators.precision import Phrasings

RANDOM = random.Random(5)


def mean_precision(scores, hits):
    """Over distinct scores from the highest: what a place adds to recall, times precision up to it."""
    out, seen, found = 0.0, 0, 0
    for at in sorted(set(scores), reverse=True):
        here = [h for s, h in zip(scores, hits, strict=True) if s == at]
        seen, found = seen + len(here), found + sum(here)
        out += sum(here) / sum(hits) * found / seen
    return out


@pytest.mark.parametrize("ranges", [1, 5, 256])
def test_average_precision(spark, monkeypatch, ranges):
    monkeypatch.setattr(precision, "RANGES", ranges)
    rows = [(w, RANDOM.choice([RANDOM.random(), RANDOM.randrange(6) / 5, -0.0, 0.0, 1e300, -math.inf]), RANDOM.random() < 0.3, RANDOM.choice([True, False, None])) for w in (0, 1, None) for _ in range(400)]
    rows += [(2, 0.5, False, True), (2, 0.5, False, False), (3, 7.0, True, None), (1, math.nan, True, True), (1, None, True, True), (4, None, True, True)]
    found = {r["w"]: r for r in precision.average_precision(spark.createDataFrame(rows, "w int, score double, high boolean, low boolean").repartition(5), "w", "score", ["high", "low"]).collect()}
    assert set(found) == {0, 1, 2, 3, None} and found[2]["high"] is None and found[3]["low"] is None and found[2]["low"] == 0.5
    for w in (0, 1, None):
        mine = [r for r in rows if r[0] == w and r[1] is not None and not math.isnan(r[1])]
        for k, side in ((2, "high"), (3, "low")):
            assert math.isclose(found[w][side], mean_precision([r[1] for r in mine], [bool(r[k]) for r in mine]), abs_tol=1e-12)


@pytest.mark.parametrize("ranges", [3, 256])
def test_spearman(spark, monkeypatch, ranges):
    monkeypatch.setattr(precision, "RANGES", ranges)
    rows = pd.DataFrame([(q, x, round(x + RANDOM.gauss(0, 1), 1)) for q in range(3) for x in [RANDOM.randrange(20) / 4 for _ in range(300)]] + [(9, 1.0, 2.0), (9, 1.0, 3.0), (8, 1.0, 1.0)], columns=["q", "a", "b"])
    found = {r["q"]: r["rho"] for r in ranks.spearman(spark.createDataFrame(rows).repartition(4), "q", "a", "b").collect()}
    assert found[9] is None and found[8] is None
    for q in range(3):
        mine = rows[rows.q == q]
        assert math.isclose(found[q], mine.a.rank().corr(mine.b.rank()), abs_tol=1e-12)
    assert ranks.spearman(spark.createDataFrame(rows[:0], "q int, a double, b double"), "q", "a", "b").count() == 0


def test_scores_of_both_kinds_by_tiles(spark):
    data = np.random.default_rng(1).random((30, 6))
    rows = spark.createDataFrame([(i, x[:3].tolist(), x[3:].tolist()) for i, x in enumerate(data)], "item long, one array<double>, two array<double>")
    for block in (7, 100):
        found = {(r["q"], r["item"]): (r["first"], r["second"]) for r in ranks.both_scores(rows.where("item % 5 = 0"), rows, lambda a, b: a @ b.T, block).collect()}
        assert set(found) == {(q, i) for q in range(0, 30, 5) for i in range(30) if i != q}
        assert all(np.allclose(v, (data[q, :3] @ data[i, :3], data[q, 3:] @ data[i, 3:]), atol=1e-9) for (q, i), v in found.items())


def test_phrase_rows(spark):
    made = np.random.default_rng(3)
    vec = made.standard_normal((200, 4))
    value = np.where(np.arange(200) % 4 == 0, np.nan, vec[:, 0] + 0.1 * made.standard_normal(200))
    unit = lambda rows: rows / np.linalg.norm(rows, axis=1, keepdims=True)
    found = Phrasings({"size": (np.eye(4)[0], -np.eye(4)[0]), "none": (np.eye(4)[1], np.eye(4)[2])}, unit(made.standard_normal((5, 4))), unit(made.standard_normal((8, 4))))
    schema = "item long, vec array<double>, value double"
    rows = spark.createDataFrame([(i, vec[i].tolist(), None if i % 8 == 0 else float(value[i])) for i in range(200)], schema)
    got = {(r["phrase"], r["side"]): r for r in precision.phrase_rows(rows, "vec", "value", found, 10).collect()}
    known = np.isfinite(value)
    low, high = np.nanquantile(value, [1 / 3, 2 / 3])
    sides = {"high": value[known] > high, "low": value[known] < low}
    score = np.round(vec @ found.directions().T, 9)
    ap = lambda which, side: mean_precision(score[known, which].tolist(), sides[side].tolist())
    for k, name in enumerate(found.pairs):
        for i, (side, opposite) in enumerate((("high", "low"), ("low", "high"))):
            r, own = got[name, side], ap(2 * k + i, side)
            plus = 4 + 10 * k
            edit = np.quantile([abs(ap(plus + j, side) - ap(plus + 5 + j, side)) for j in range(5)], 0.95)
            page = np.argsort(-score[known, 2 * k + i], kind="stable")[:10]
            shown = np.argsort(-score[:, 2 * k + i], kind="stable")[:10]
            wanted = [own, sides[side].mean(), own - ap(2 * k + 1 - i, side), edit, np.quantile([ap(24 + j, side) for j in range(8)], 0.95), sides[side][page].mean(), sides[opposite][page].mean(), known[shown].mean()]
            assert np.allclose(list(r)[3:], wanted, atol=1e-6) and r["passes"] == (wanted[2] > edit and own > wanted[1])
    assert got["size", "high"]["passes"] and got["size", "low"]["passes"]
    for few in (rows.limit(0), rows.where("value IS NULL"), rows.where("item = 1")):
        nothing = precision.phrase_rows(few, "vec", "value", found, 10).collect()
        assert len(nothing) == 4 and not any(r["passes"] for r in nothing) and all(r["average_precision"] is None for r in nothing)


def test_edits_lie_on_both_sides_of_the_middle():
    first, second, steps = np.eye(3)[0], np.eye(3)[1], np.eye(3)[2:]
    plus, minus = precision.edited(first, second, steps)
    assert np.allclose([np.linalg.norm(plus), np.linalg.norm(minus)], 1) and np.allclose(plus[:2], minus[:2]) and np.allclose(plus[2], -minus[2])


@pytest.mark.parametrize("hits, stream", [(40, 7), (1 << 25, 4096)])
def test_label_precision(spark, monkeypatch, hits, stream):
    monkeypatch.setattr(precision, "HITS", hits)
    monkeypatch.setattr(precision, "STREAM", stream)
    made = np.random.default_rng(3).integers(-2, 3, (80, 3)).astype(float)  # many equal products
    labels = [None if i % 11 == 0 else 99 if i == 40 else int(i % 4 == 1) for i in range(80)]
    rows = spark.createDataFrame([(i, x.tolist(), y) for i, (x, y) in enumerate(zip(made, labels, strict=True))], "item long, vec array<float>, label int").repartition(5)
    df = precision.label_precision(rows.where("item % 4 < 2"), rows, 5)
    found = {r["q"]: (r["ap"], r["best"]) for r in df.collect()}
    assert set(found) == {i for i in range(80) if i % 4 < 2}
    for q, (ap, best) in found.items():
        order = sorted((i for i in range(80) if i != q), key=lambda i: (-float(made[i] @ made[q]), i))
        same = [labels[i] is not None and labels[i] == labels[q] for i in order]
        ranks_ = [k for k, s in enumerate(same, 1) if s]
        assert best == sum(same[:5]) / 5
        assert ap is None if not ranks_ else math.isclose(ap, sum(n / k for n, k in enumerate(ranks_, 1)) / len(ranks_), abs_tol=1e-12)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert precision.label_precision(rows.where("item = 1"), rows.where("item = 1")).count() == 0


@pytest.mark.parametrize("held", [50, 1 << 24])
def test_agreement_of_two_scores(spark, monkeypatch, held):
    monkeypatch.setattr(ranks, "HELD", held)
    made = np.random.default_rng(4).integers(-1, 3, (60, 4)).astype(float)
    made[50:] = made[:10]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(made)], "item long, vec array<float>").repartition(4)
    score = lambda a, b: [a @ b.T, a[:, :2] @ b[:, :2].T]
    df = ranks.agreement(rows.where("item % 3 = 0"), rows, score, 6)
    found = {r["q"]: r for r in df.collect()}
    assert set(found) == set(range(0, 60, 3))
    for q, r in found.items():
        other = np.delete(np.arange(60), q)
        a, b = (pd.Series(m[0]) for m in score(made[q : q + 1], made))
        want = a[other].rank().corr(b[other].rank())
        assert r["rho"] is None if math.isnan(want) else math.isclose(r["rho"], want, abs_tol=1e-12)
        top = [sorted(other, key=lambda i: (-m[i], i))[:6] for m in (a, b)]
        assert r["shared"] == len(set(top[0]) & set(top[1]))
        assert r["own"] == [a[q], b[q]] and r["most"] == [a[other].max(), b[other].max()]
    assert ranks.agreement(rows.where("item = 3"), rows.where("item = 3"), score, 6).count() == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_agreement_sends_its_gallery_once_to_each_block_however_many_pairs(spark, monkeypatch):
    made = np.random.default_rng(5).integers(-1, 3, (300, 4)).astype(float)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(made)], "item long, vec array<float>")
    score = lambda a, b: [a @ b.T, a[:, :2] @ b[:, :2].T]
    found = []
    for held, kept, piece in ((1 << 24, 1 << 26, 1 << 16), (700, 100, 90)):  # rows in memory, and in a task's file
        for name, x in (("HELD", held), ("KEPT", kept), ("PIECE", piece)):
            monkeypatch.setattr(ranks, name, x, raising=False)
        df = ranks.agreement(rows.where("item % 3 = 0"), rows, score, 6)
        assert df.rdd.getNumPartitions() == 1  # 100 queries with 300 rows: one block, as blocks have 64 queries at least
        found.append(sorted(tuple(r) for r in df.collect()))
    assert found[0] == found[1] and len(found[0]) == 100
