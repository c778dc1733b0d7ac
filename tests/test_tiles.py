"""Tiles: nothing is broadcast, no pair is shuffled, and blocks, streams and copies of rows change no result."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom import evaluators, extras, factored, probes, queries, searches
from starloom.operators import grams, linear, ranks, similarity

D = "/root/testdata/sf0.001"


def plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def vectors(spark):
    """Rows of which many are copies or near copies, and the same as a matrix."""
    made = np.random.default_rng(5).standard_normal((40, 6)) * 100
    rows = np.concatenate([made, made[:25], made[:25] + 1e-7, made[:10]])
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "item long, vec array<double>").repartition(3), rows


def far(rows):
    out = np.round(np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(2)), 9)
    np.fill_diagonal(out, np.inf)
    return out


@pytest.mark.parametrize("sizes", [(7, 1, 3, 4), (1000, 48, 512, 1024)])
def test_nearest_and_places_with_copies(spark, vectors, monkeypatch, sizes):
    for name, value in zip(("BLOCK", "LEAST", "STREAM", "TILE"), sizes, strict=True):
        monkeypatch.setattr(linear, name, value)
    monkeypatch.setattr(ranks, "TILE", sizes[3])
    df, rows = vectors
    want = {q: np.lexsort((np.arange(len(rows)), d))[: len(rows) - 1] for q, d in enumerate(far(rows))}
    found = {}
    for r in linear.nearest(df.where("item % 4 = 0"), df, 9).collect():
        found.setdefault(r["q"], {})[r["rank"]] = (r["item"], r["score"])
    assert set(found) == set(range(0, len(rows), 4))
    for q, near in found.items():
        assert [near[k + 1][0] for k in range(9)] == want[q][:9].tolist()
        assert [round(-near[k + 1][1], 9) for k in range(9)] == far(rows)[q][want[q][:9]].tolist()
    asked = spark.createDataFrame([(q, i) for q in (0, 4, 60) for i in (1, 40, 66, 95)], "q long, item long")
    for r in ranks.distance_ranks(df.where("item % 4 = 0"), df, asked).collect():
        assert r["place"] == want[r["q"]].tolist().index(r["item"]) + 1


def test_a_block_keeps_the_bound_of_its_tiles():
    rng = np.random.default_rng(3)
    tiles = [np.round(rng.standard_normal((7, n)), 1) for n in (2, 3, 40, 1, 25)]
    top = np.full((7, 4), -np.inf)
    for t, tile in enumerate(tiles):
        least = top.min(1)
        r, c = np.nonzero(tile >= least[:, None])
        top = linear._raised(top, least, r, tile[r, c])
        every = np.concatenate([np.full((7, 4), -np.inf), *tiles[: t + 1]], axis=1)
        assert (np.sort(top, axis=1) == np.sort(every, axis=1)[:, -4:]).all()


def test_each_block_has_a_task(spark):
    rows = linear.dealt(spark.range(200).select("id", (F.col("id") % 10).cast("int").alias("block")), 10)
    found = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("block").alias("n")).collect()
    assert len(found) == 10 and {r["n"] for r in found} == {1}


def test_codes_below_the_top_share_what_is_left(spark):
    rows = spark.createDataFrame([(1, [0.1, 0.3, 0.3, 0.1, 0.05, 0.05, 0.05, 0.05] * 2)], "item long, vec array<double>")
    found = searches.flat_below(rows, 3).first()["vec"]
    assert np.allclose(found, [0.1, 0.3, 0.3, 0.06, 0.06, 0.06, 0.06, 0.06] * 2)


def test_no_tile_is_broadcast(spark, vectors):
    df, rows = vectors
    assert "BroadcastExchange" not in plan(linear.gram_top(df.where("item % 4 = 0"), df, 3))
    own = df.where("item % 4 = 0").withColumn("own", F.array(F.lit(0.5)))
    assert "BroadcastExchange" not in plan(ranks.own_ranks(own, df, lambda a, b: [a @ b.T]))
    assert "BroadcastExchange" not in plan(probes.ranks.both_scores(*[df.select("item", F.col("vec").alias("one"), F.col("vec").alias("two"))] * 2, lambda a, b: a @ b.T))


def test_ties_with_own(spark, vectors):
    df, rows = vectors
    s = np.round(rows @ rows.T, 9)
    own = spark.createDataFrame([(i, rows[i].tolist(), [float(s[i, 3])]) for i in (0, 1, 2)], "item long, vec array<double>, own array<double>")
    for r in ranks.own_ranks(own, df, lambda a, b: [a @ b.T], ties=True).collect():
        others = np.delete(s[r["item"]], r["item"])
        assert r["ranks"] == [1 + (others > s[r["item"], 3]).sum()] and r["ties"] == [(others == s[r["item"], 3]).sum()]


@pytest.mark.parametrize("name", ["v8_mode_totals_set", "v9_any_position_set", "v3_sparse_overlap_set", "v25_against_data_anywhere_set", "v13_similarity_set", "v17_mode_search_set", "p17_threshold_mask_set"])
def test_rows_of_pairs_are_not_shuffled(spark, name):
    text = plan(queries.QUERIES[name](spark, D))
    last = text.split("== Initial Plan ==")[0]
    assert "CartesianProduct" not in last and "NestedLoop" not in last and "Aggregate" not in last and last.count("Exchange hashpartitioning") == 1
    assert last.count("Generate explode") <= 1  # of a pack to all blocks: the rows of a pair leave their tile as rows


def test_the_saliency_of_a_set_makes_no_row_for_a_pair(spark):
    text = plan(searches.v19_saliency_set(spark, D)).split("== Initial Plan ==")[0]
    assert "NestedLoop" not in text and "CartesianProduct" not in text and text.count("Generate explode") <= 1  # of a query to all blocks


@pytest.mark.parametrize("f", [evaluators.q3_topk_agreement, evaluators.q5_own_rank, evaluators.q11_precision_at_k, evaluators.v24_against_data, evaluators.v26_prediction_gram, extras.q8_neighbour_differences, queries.v23_euclidean_knn])
def test_no_query_makes_a_row_for_each_pair(spark, f):
    text = plan(f(spark, D))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_equal_sides_leave_a_block_once(spark, vectors):
    df, rows = vectors
    sides = df.select("item", F.col("vec").alias("dist"), F.array(F.lit(1.0)).alias("x"))
    found = grams.applied(sides, sides, lambda a, b: [a[:, 0] @ b[:, 0].T], 1, 1)
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
    y = {r["item"]: r["y"][0] for r in found.collect()}
    assert np.allclose([y[i] for i in range(len(rows))], (rows @ rows.T).sum(1))


def test_gram_means_join_no_tiles(spark, monkeypatch):
    assert "Join" not in plan(factored.b7_slot_grams(spark, D))
    rng = np.random.default_rng(2)
    p = rng.random((150, 3, 4)) ** 8
    p[::9] = np.eye(4)[rng.integers(0, 4, (len(p[::9]), 3))]  # overlaps of 0, which are floored
    p /= p.sum(2, keepdims=True)
    for piece in ((64, 256), (7, 5)):
        monkeypatch.setattr(grams, "PIECE", piece)
        rows, columns = grams.tile_sums(p[:60], p[60:])
        same, forward, backward = grams.three_ways(p[:60], p[60:])
        assert np.allclose(rows, [m.sum(1) for m in (same, forward, backward)], rtol=1e-11)
        assert np.allclose(columns, [m.sum(0) for m in (same, backward, forward)], rtol=1e-11)


def test_a_mask_leaves_its_tile_as_one_number_and_counts_floored_overlaps(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = rng.normal(0, 0.3, (60, 64)).astype(np.float32)
    rows[::3] = 0
    rows[::3, ::8] = rng.choice([-40, 40], (20, 8))  # one code or none: overlaps under the floor
    rows[1::9] = 0  # all slots alike, so that the middle of equal logs is each of them
    spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(rows)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    e = np.exp(4.0 * rows.astype(np.float64)).reshape(60, 8, 8)
    p = e / e.sum(2, keepdims=True)
    lo = np.log(np.maximum(np.einsum("qsc,isc->qis", p[::20], p), similarity.FLOOR))
    assert (lo == np.log(similarity.FLOOR)).any()
    want = (lo >= (lo.min(1, keepdims=True) + lo.max(1, keepdims=True)) / 2 - 1e-13) != (np.arange(8) == 3)
    df = searches.p17_threshold_mask_set(spark, str(tmp_path))
    got = df.collect()
    assert len(got) == want.size and df.columns == ["q", "item", "slot", "shown"]
    assert all(r["shown"] == want[r["q"] // 20, r["item"], r["slot"]] for r in got)
    assert "Generate posexplode" in plan(df)
