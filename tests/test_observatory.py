import math

import pytest

from pyspark.sql import functions as F

from starloom import evaluators, queries
from starloom.operators import maps, similarity
from starloom.sources.relations import MODES

SF = "/root/testdata/sf0.001"


def test_selection_is_validated():
    assert similarity.validated({"image": [1, 0, 1], "spectrum": [1]}, MODES) == [("image", 0), ("image", 1), ("spectrum", 5)]
    for bad in ({}, {"image": []}, {"image": [4]}, {"sound": [0]}):
        with pytest.raises(ValueError):
            similarity.validated(bad, MODES)


def test_search_has_the_query_first(spark):
    rows = {r["rank"]: r for r in queries.v16_slot_search(spark, SF).collect()}
    assert rows[0]["item"] == 7 and len(rows) == 11
    assert [rows[i]["score"] for i in range(1, 11)] == sorted((rows[i]["score"] for i in range(1, 11)), reverse=True)


def test_crossmatch_finds_the_nearest(spark):
    left = spark.createDataFrame([(1, 10.0, 0.0), (2, 50.0, 60.0)], "item long, ra double, dec double")
    right = spark.createDataFrame([(5, 10.001, 0.0), (6, 10.0005, 0.0), (7, 50.1, 60.0)], "item long, ra double, dec double")
    found = {r["item"]: r for r in maps.crossmatch(left, right, 0.01).collect()}
    assert found[1]["match"] == 6 and math.isclose(found[1]["separation"], 0.0005, rel_tol=1e-6) and found[2]["match"] is None


def test_crossmatch_over_the_whole_sky(spark):
    left = [(1, 359.999, 10.0), (2, 0.0, 89.999), (3, 180.0, -89.9995), (4, 20.0, 87.0), (5, -0.001, -40.0), (6, 100.0, 90.0), (7, 5.0, 5.0)]
    right = [(11, 0.001, 10.0), (12, 180.0, 89.9985), (13, 0.0, -89.9995), (14, 20.1, 87.0), (15, 359.998, -40.0)]
    schema = "item long, ra double, dec double"
    found = {r["item"]: r for r in maps.crossmatch(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 0.01).collect()}
    assert {i: r["match"] for i, r in found.items()} == {1: 11, 2: 12, 3: 13, 4: 14, 5: 15, 6: 12, 7: None}
    assert math.isclose(found[2]["separation"], 0.0025, rel_tol=1e-6)


def test_every_query_has_a_name_and_sql():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_uniform_depends_on_the_key_alone(spark):
    rows = spark.range(1000).select("id", evaluators.uniform(F.col("id")).alias("u"))
    once = {r["id"]: r["u"] for r in rows.collect()}
    again = {r["id"]: r["u"] for r in rows.repartition(7).collect()}
    assert once == again and all(0 < u < 1 for u in once.values()) and 0.45 < sum(once.values()) / 1000 < 0.55


def test_sampled_rows_agree_between_runs(spark):
    first, second = ({r["p_partkey"] for r in evaluators.t6_weighted_sample(spark, SF).collect()} for _ in range(2))
    assert first == second and len(first) == 50
