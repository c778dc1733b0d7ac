"""What searches send between tasks, in bytes of shuffle for each byte of the embeddings; what a tile makes of rows as the table has them."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from starloom import queries, searches
from starloom.operators import linear

D = "/root/testdata/sf0.1"


def shuffled(spark, df):
    """Bytes that the tasks of a query wrote for others."""

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return sum(x.totalShuffleWrite() for x in (lambda every: [every.apply(i) for i in range(every.size())])(spark.sparkContext._jsc.sc().statusStore().executorList(True)))

    before = written()
    df().write.format("noop").mode("overwrite").save()
    return written() - before


@pytest.mark.parametrize(("name", "most"), [("v20_direction_search_set", 4), ("v19_saliency_set", 4), ("v17_mode_search_set", 4), ("v8_mode_totals_set", 3), ("v25_against_data_anywhere_set", 3)])
def test_a_search_sends_a_few_times_its_table(spark, name, most):
    assert shuffled(spark, lambda: queries.QUERIES[name](spark, D)) < most * os.path.getsize(f"{D}/embeddings.parquet")


def test_directions_join_no_rows_again(spark):
    assert "Join" not in searches.v20_direction_search_set(spark, D)._jdf.queryExecution().executedPlan().toString()


def test_parts_belong_to_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(linear, "TILE", 5)
    rows = np.round(np.random.default_rng(1).standard_normal((70, 4)), 1).astype(np.float32)
    df = spark.createDataFrame([(int(i) * 3 % 70, x.tolist()) for i, x in enumerate(rows)], "item long, vec array<float>").repartition(3)
    at = {int(i) * 3 % 70: x.astype(float) for i, x in enumerate(rows)}
    found = linear.gram_top(df.where("item % 20 = 0"), df, 6, block=30, own=True, parts=lambda q, g: q * g).collect()
    assert len(found) == 24
    for r in found:
        assert np.allclose(r["parts"], at[r["q"]] * at[r["item"]]) and np.isclose(sum(r["parts"]), r["score"])


def test_a_tile_makes_what_packed_makes(spark):
    def opened(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(searches.shares(batch.to_struct_array())))], ["item", "made"])

    rows = searches.floats(spark, D).limit(300).withColumn("more", F.array(F.col("item").cast("double")))
    found = rows.mapInArrow(opened, "item long, made array<double>").join(searches.packed(spark, D).select("item", F.flatten("dist").alias("dist")), "item").collect()
    assert len(found) == 300
    for r in found:
        assert np.allclose(r["made"][:-1], r["dist"], rtol=1e-14, atol=0) and r["made"][-1] == r["item"]
