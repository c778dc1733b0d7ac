"""Cells drawn in batches are those drawn one by one."""

from pyspark.sql import functions as F

from starloom.operators import samplers


def test_cells_are_some_of_all_cells(spark):
    rows = spark.createDataFrame([(i,) for i in [*range(-5, 40), 2**40, None]], "item long").repartition(3)
    for total, count in ((144, 4), (3, 5), (1, 1)):
        every = F.sequence(F.lit(0), F.lit(total - 1))
        both = rows.select(samplers.cells(total, count, 1, F.col("item")).alias("a"), samplers.some(every, count, 1, F.col("item")).cast("array<long>").alias("b"))
        assert both.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0
    assert "ArrowEvalPython" in rows.select(samplers.cells(144, 4, 1, F.col("item")))._jdf.queryExecution().executedPlan().toString()
