"""Scores of predictions against weighted data with an amplitude of their own, less those of a reference."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.operators.similarity import dot


def _literal(numbers: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in numbers])


def _fit(linear: Column, square: Column) -> Column:
    """Twice what the best amplitude gains over none: linear ** 2 / square, 0 where the model has no weight."""
    return F.coalesce(linear * linear / F.nullif(square, F.lit(0.0)), F.lit(0.0))


def prepared(data: DataFrame, reference: list[float]) -> DataFrame:
    """data (item, x, w) with wx, base (the reference's fit) and saturation; rows without any weight are left out.

    The score of a model m is half of (m.wx)^2 / (m^2.w) less the same of the reference: its amplitude, (m.wx) / (m^2.w), is
    the best one and falls out. No model scores more than the saturation, which data that follow it reach.
    """
    m0 = _literal(reference)
    rows = data.withColumn("wx", F.zip_with("x", "w", lambda a, b: a * b)).where(F.exists("w", lambda b: b > 0))
    rows = rows.withColumn("base", _fit(dot(m0, F.col("wx")), dot(F.transform(m0, lambda a: a * a), F.col("w"))))
    return rows.withColumn("saturation", 0.5 * (dot(F.col("x"), F.col("wx")) - F.col("base")))


def packed(rows: DataFrame) -> DataFrame:
    """prepared() rows as (item, vec) for tiles."""
    return rows.select("item", F.concat("wx", "w", F.array("base")).alias("vec"))


def free_amplitude(models: np.ndarray, held: np.ndarray) -> np.ndarray:
    """A tile of scores from two products: models with weighted data, and squared models with weights."""
    width = models.shape[1]
    linear, square = models @ held[:, :width].T, (models * models) @ held[:, width : 2 * width].T
    return 0.5 * (np.where(square > 0, linear * linear / np.where(square > 0, square, 1.0), 0.0) - held[:, 2 * width])
