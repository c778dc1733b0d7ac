"""What a search rewards, and keyed samplers, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.operators import bias, samplers

MADE = np.random.default_rng(4)


@pytest.mark.parametrize("block", [9, 500])
def test_bias(spark, block):
    n, flips, pool, reach, top = 80, 3, 7, 0.15, 4
    seen, unseen = np.round(MADE.random((n, 2)), 1), np.round(MADE.random((n, 2)), 1)
    z, shown = MADE.random(n), MADE.random((n, flips)) < 0.5
    z[::9] = np.nan
    gallery = spark.createDataFrame([(i, seen[i].tolist(), unseen[i].tolist(), None if i % 18 == 0 else float(z[i]), shown[i].tolist()) for i in range(n)], "item long, seen array<double>, unseen array<double>, z double, shown array<boolean>")
    queries = gallery.where("item % 10 = 5").select("item", F.col("seen").alias("vec"), "z")
    found = {r["q"]: r for r in bias.bias(queries, gallery, lambda a, b: a @ b.T, flips, pool, reach, top, block).collect()}
    assert set(found) == set(range(5, n, 10))
    for q, r in found.items():
        others = [i for i in range(n) if i != q]
        near = {i: bool(abs(z[i] - z[q]) / (1 + z[q]) < reach) for i in others}
        shares = {True: [], False: []}
        for f in range(flips):
            score = {i: round(float(seen[q] @ (seen if shown[i, f] else unseen)[i]), 9) for i in others}
            page = sorted(others, key=lambda i: (-score[i], i))[:pool]
            for kind, values in shares.items():
                picked, of = [shown[i, f] for i in page if near[i] == kind], [shown[i, f] for i in others if near[i] == kind]
                if picked:
                    values.append(np.mean(picked) - np.mean(of))
        for name, kind in (("evidence", True), ("availability", False)):
            assert r[name] is None if not shares[kind] else np.isclose(r[name], np.mean(shares[kind]), atol=1e-12)
        own = round(float(seen[q] @ unseen[q]), 9)
        assert r["identity"] == (sum(round(float(seen[q] @ seen[i]), 9) > own for i in others) < top)
    assert bias.bias(queries.limit(0), gallery, lambda a, b: a @ b.T, flips, pool, reach, top).count() == 0


def test_samplers(spark):
    rows = [(i, sorted(MADE.choice(30, 12, replace=False).tolist())) for i in range(3000)] + [(None, [1, 2, 3, None, 2]), (-1, []), (-2, None), (-3, [None])]
    df = spark.createDataFrame(rows, "item long, values array<int>")
    item, values = F.col("item"), F.col("values")
    made = {"some": samplers.some(values, 4, 1, item), "window": samplers.window(values, 5, 2, item), "cells": samplers.cells(16, 3, 3, item), "there": samplers.observed(values, F.lit(None).cast("array<int>"))}
    found = [{r["item"]: r for r in df.repartition(k, F.rand(k)).select("item", "values", *[c.alias(n) for n, c in made.items()]).collect()} for k in (2, 5)]
    assert found[0] == found[1]
    for i, held in rows[:3000]:
        r = found[0][i]
        assert len(r["some"]) == 4 and r["some"] == sorted(set(r["some"])) and set(r["some"]) <= set(held) and r["there"]
        at = held.index(r["window"][0])
        assert r["window"] == held[at : at + 5] and len(r["window"]) == 5 and len(set(r["cells"])) == 3 and r["cells"] == sorted(r["cells"])
    starts = np.bincount([rows[i][1].index(found[0][i]["window"][0]) for i in range(3000)], minlength=8)
    cells = np.bincount([c for i in range(3000) for c in found[0][i]["cells"]], minlength=16)
    assert len(starts) == 8 and abs(starts - 375).max() < 80 and abs(cells - 562.5).max() < 100  # four times their spread
    odd = found[0]
    assert odd[None]["some"] == [1, 2, 3] and odd[None]["window"] == [1, 2, 3] and odd[-1]["some"] == [] and odd[-1]["window"] == [] and not odd[-1]["there"]
    assert not odd[-2]["some"] and not odd[-2]["window"] and not odd[-2]["there"] and odd[-3]["some"] == [] and not odd[-3]["there"]
