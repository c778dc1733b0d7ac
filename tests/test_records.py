"""Records, their forms and the table of properties against numpy."""

import numpy as np
from pyspark.sql import functions as F

from starloom import coded
from starloom.operators import coefficients, linear, records
from starloom.searches import packed
from starloom.sources.relations import CODES, MODES

D = "/root/testdata/sf0.001"


def test_forms_of_records(spark):
    rows = packed(spark, D).where("item < 30")
    mean, directions = coefficients.fitted(coded.spectra(spark, D), "dist", CODES, 5)
    at = records.Layout(MODES, CODES, 3, mean, directions, 1e-3)
    held = records.recorded(rows, at)
    assert held.schema.simpleString() == spark.createDataFrame([], records.RECORD).schema.simpleString()
    dist = np.array([r["dist"] for r in rows.orderBy("item").collect()])
    got = records.forms(np.array([r["vec"] for r in records.packed(held).orderBy("item").collect()]), at)
    image = np.zeros((30, 4, 8))
    for i in range(30):
        for s in range(4):
            order = np.argsort(-np.round(dist[i, s], 12), kind="stable")
            image[i, s] = (1 - dist[i, s, order[:3]].sum()) / 5
            image[i, s, order[:3]] = dist[i, s, order[:3]]
    assert np.allclose(got["image"][0], image) and np.allclose(got["table"][0], dist[:, 6:])
    decoded = {(r["item"], r["slot"]): r["p"] for r in coefficients.coded(coded.spectra(spark, D).where("item < 30"), "dist", mean, directions).withColumn("p", coefficients.decoded(coefficients.coefficients(), mean, directions)).collect()}
    p = np.array([[decoded[i, s] for s in (4, 5)] for i in range(30)])
    form, shift, _ = got["spectrum"]
    assert np.allclose(np.einsum("asr,bsr->abs", form, form) + shift, np.einsum("asc,bsc->abs", p, p))
    want = sum(np.log(np.maximum(np.einsum("asc,bsc->abs", x, x), 1e-3 if m == "spectrum" else 0)).sum(2) for m, x in (("image", image), ("spectrum", p), ("table", dist[:, 6:])))
    both = records.packed(held)
    for r in linear.gram_top(both.where("item < 4"), both, 5, block=9, score=records.record_scores(at, list(MODES))).collect():
        assert abs(r["score"] - want[r["q"], r["item"]]) < 1e-8


def test_properties_out_of_fold(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=400) * 0.2
    rows = spark.createDataFrame([(i, i % 5, v.tolist(), float(t) if i % 4 else None) for i, (v, t) in enumerate(zip(x, y))], "item long, fold int, vec array<double>, y double")
    found = records.properties(rows, "vec", 3, {"y": F.col("y"), "none": F.lit(None)}).collect()
    assert len(found) == 800 and all(r["predicted"] is None and r["width"] is None for r in found if r["property"] == "none")
    penalty, w, b = linear.ridge(rows, "vec", "y", 3)
    got = {r["item"]: r for r in found if r["property"] == "y"}
    for i in range(400):
        each = [x[i] @ w[f] + b[f] for f in range(5)]
        assert abs(got[i]["predicted"] - (each[i % 5] if i % 4 else np.mean(each))) < 1e-9
    known = [i for i in range(400) if i % 4]
    assert abs(got[1]["width"] - np.sqrt(np.mean([(y[i] - got[i]["predicted"]) ** 2 for i in known]))) < 1e-9 and 0.15 < got[1]["width"] < 0.25
