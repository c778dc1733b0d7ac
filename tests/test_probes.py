"""Own ranks, bases of groups, whitening and stacked probes against numpy."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from starloom import probes
from starloom.operators import bases, linear, ranks

RNG = np.random.default_rng(4)


def frame(spark, x, first=0, **columns):
    rows = [(first + i, v.tolist(), *[c[i] for c in columns.values()]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "item long, vec array<double>" + "".join(f", {k}" for k in columns))


def test_own_ranks_count_what_beats_them(spark):
    g = RNG.integers(0, 3, (90, 4)).astype(float)  # many equal scores
    two = lambda a, b: [a @ b.T, -((a[:, None] - b[None]) ** 2).sum(2)]
    gallery = frame(spark, g).repartition(3)
    asked = gallery.where("item % 9 = 0")
    own = ranks.pair_scores(asked.select("item", F.col("vec").alias("a"), F.col("vec").alias("b")), two)
    for block in (7, 500):
        got = {r["item"]: list(r["ranks"]) for r in ranks.own_ranks(asked.join(own, "item"), gallery, two, block).collect()}
        matrices = two(g, g)
        assert got == {i: [1 + int((np.delete(m[i], i) > m[i, i]).sum()) for m in matrices] for i in range(0, 90, 9)}
    assert ranks.own_ranks(asked.join(own, "item").where("item < 0"), gallery, two).collect() == []


def test_hidden_modes_are_means(spark):
    rows = frame(spark, RNG.random((20, 64)))
    x = np.array([r["vec"] for r in rows.orderBy("item").collect()])
    got = np.array([r["vec"] for r in probes.hidden(rows, "spectrum").orderBy("item").collect()])
    assert np.allclose(got[:, 32:48], x[:, 32:48].mean(0)) and (got[:, :32] == x[:, :32]).all() and (got[:, 48:] == x[:, 48:]).all()


def test_bases_fall_back_to_the_family(spark):
    x = RNG.normal(size=(500, 5)) * [3, 1, 1, 0.5, 0.1] + 1
    kind = ["a"] * 300 + ["b"] * 100 + ["c"] * 60 + ["d"] * 40
    family = {"a": "1", "b": "2", "c": "2", "d": "3"}
    rows = frame(spark, x, **{"kind string": kind}).repartition(6)
    found = bases.bases(rows, family, 5, 3)
    kind = np.array(kind)
    r = np.zeros_like(x)
    for k in family:
        less = x[kind == k] - x[kind == k].mean(0)
        r[kind == k] = less / np.linalg.norm(less, axis=1, keepdims=True)
    for k, members in (("a", "a"), ("b", "bc"), ("c", "bc"), ("d", "d")):
        mine = r[np.isin(kind, list(members))]
        _, s, vt = np.linalg.svd(mine - mine.mean(0), full_matrices=False)
        scale = s[:3] / np.sqrt(len(mine))
        b = found[k]
        assert b.n == (kind == k).sum() and b.shared == (k != "a") and np.allclose(b.center, mine.mean(0)) and np.allclose(b.scale, np.maximum(scale, 0.1 * np.median(scale)))
        assert np.allclose(np.abs((b.components * vt[:3]).sum(1)), 1)
    for row in bases.on_bases(rows, found).where("item % 50 = 7").collect():
        b = found[row["kind"]]
        assert np.allclose(row["coefficients"], (r[row["item"]] - b.center) @ b.components.T / b.scale)


def test_whitened_vectors_have_no_correlations(spark):
    x = RNG.normal(size=(400, 4)) @ RNG.normal(size=(4, 4)) + 5
    offset, projection = bases.whitening(frame(spark, x), "vec", 4, 3)
    assert np.allclose(np.cov(((x - offset) @ projection).T), np.eye(3), atol=1e-8)
    flat = np.concatenate([x, np.ones((400, 1))], axis=1)  # a direction that isn't there
    offset, projection = bases.whitening(frame(spark, flat), "vec", 5, 5)
    assert np.isfinite(projection).all() and np.allclose(((flat - offset) @ projection).std(0, ddof=1), [1, 1, 1, 1, 0], atol=1e-6)


def test_weights_of_one_sign_are_the_best_ones():
    for seed in range(40):
        rng = np.random.default_rng(seed)
        a, y = rng.normal(size=(30, 5)), rng.normal(size=30)
        gram, right = a.T @ a, a.T @ y
        loss = lambda w: w @ gram @ w / 2 - right @ w
        best = 0.0
        for n in range(1, 6):
            for chosen in itertools.combinations(range(5), n):
                w = np.zeros(5)
                w[list(chosen)] = np.linalg.solve(gram[np.ix_(chosen, chosen)], right[list(chosen)])
                if (w >= 0).all():
                    best = min(best, loss(w))
        found = bases.nonnegative(gram, right)
        assert (found >= 0).all() and abs(loss(found) - best) < 1e-9


def test_stack_of_blocks(spark):
    x = RNG.normal(size=(600, 6))
    y = 2 * x[:, 0] + x[:, 4] + RNG.normal(size=600) * 0.1
    fold = [i % 5 for i in range(600)]
    rows = frame(spark, x, **{"y double": y.tolist(), "fold int": fold})
    predicted, weights, scores = bases.stacked(rows, "vec", "y", {"left": (0, 2), "none": (2, 2), "right": (4, 2)})
    got = {r["item"]: r["predicted"] for r in predicted.collect()}
    p = np.array([got[i] for i in range(600)])
    assert abs(scores["stack"] - (1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-9
    assert scores["stack"] > 0.97 > max(scores["left"], scores["right"]) and min(weights["left"], weights["right"]) > 0.9 and 0 <= weights["none"]
    # a block's score is that of its predictions out of fold
    penalty, w, b = linear.ridge(rows.withColumn("part", F.slice("vec", 1, 2)), "part", "y", 2)
    out = np.array([x[i, :2] @ w[f] + b[f] for i, f in enumerate(fold)])
    assert abs(scores["left"] - (1 - ((y - out) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-9
