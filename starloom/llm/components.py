"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.scratch import written


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, comp): the same comp, one of the nodes, for all nodes that reach each other.

    Every round each node goes to the least of its neighbours and itself, and on to where that goes; then edges are
    those between different places that are left, each once. So tables shrink from round to round, and a chain halves.
    Rounds are written tables; a hub's neighbours are joined up map-side.
    """
    both = written(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = None
    while labels is None or not both.isEmpty():
        up = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("next")))
        to = written(up.join(up.select(F.col("node").alias("on"), F.col("next").alias("to")), F.col("next") == F.col("on")).select("node", "to"))
        labels = to.withColumnRenamed("to", "comp") if labels is None else written(_moved(labels, to))
        a, b = (to.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab")
        both = written(both.join(a, "a").join(b, "b").where("a_to <> b_to").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).distinct())
    return labels


def joined(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Labels (node, comp) with new edges (a, b) between any nodes: only edges between components are looked at."""
    if labels is None:
        return components(edges)
    for c in "ab":
        of = labels.select(F.col("node").alias(f"{c}_node"), F.col("comp").alias(f"{c}_comp"))
        edges = edges.join(of, F.col(c) == F.col(f"{c}_node"), "left").withColumn(c, F.coalesce(f"{c}_comp", c)).select("a", "b")
    to = components(edges).withColumnRenamed("comp", "to")
    fresh = to.join(labels.select(F.col("node").alias("known")), F.col("node") == F.col("known"), "left_anti").select("node", F.col("to").alias("comp"))
    return written(_moved(labels, to).unionAll(fresh))


def _moved(labels: DataFrame, to: DataFrame) -> DataFrame:
    """Labels (node, comp) after components moved by (node, to)."""
    to = to.select(F.col("node").alias("from"), "to")
    return labels.join(to, F.col("comp") == F.col("from"), "left").select("node", F.coalesce("to", "comp").alias("comp"))
