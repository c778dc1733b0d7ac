"""Bounded samples of labelled rows and logistic models on a few features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.scratch import written

#: Labelled rows that a model is fitted on, at most.
TRAIN_ROWS = 20_000


def labelled(labels: DataFrame, label: str, eligible: Column | None = None, most: int = TRAIN_ROWS) -> DataFrame:
    """At most `most` rows (l_id, label), by the order of a hash of the id, so that reruns agree; written.

    Null ids and labels are left out; an id with several labels has their mean.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if eligible is not None:
        rows = rows.where(eligible)
    rows = rows.groupBy(F.col("doc_id").alias("l_id")).agg(F.avg(label).alias("label"))
    return written(rows.orderBy(F.xxhash64("l_id", F.lit(17)), "l_id").limit(most).coalesce(1))


@dataclass
class Logistic:
    """log-odds = bias + sum of weight * feature."""

    names: list[str]
    weights: list[float]
    bias: float

    def log_odds(self) -> Column:
        out = F.lit(self.bias)
        for name, weight in zip(self.names, self.weights, strict=True):
            out = out + F.lit(weight) * F.col(name)
        return out


def logistic(rows: DataFrame, names: list[str], label: str = "label", ridge: float = 1e-3) -> Logistic | None:
    """Fitted by Spark on standardised features; None where a class is missing."""
    counts = rows.agg(F.sum(F.when(F.col(label) > 0.5, 1).otherwise(0)), F.count("*")).first()
    if not counts[0] or counts[0] == counts[1]:
        return None
    made = VectorAssembler(inputCols=names, outputCol="_features").transform(rows.withColumn("_label", F.when(F.col(label) > 0.5, 1.0).otherwise(0.0)))
    model = LogisticRegression(featuresCol="_features", labelCol="_label", regParam=ridge, maxIter=60).fit(made)
    return Logistic(names, [float(x) for x in model.coefficients], float(model.intercept))


def chance(log_odds: Column) -> Column:
    """The probability, never quite 0 or 1."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(log_odds, F.lit(-30.0)), F.lit(30.0))))
