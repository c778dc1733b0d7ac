"""Compressed records of an item's distributions, the forms that tiles multiply, and a table of measured and predicted values."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.operators import coefficients
from starloom.operators.linear import moments, ridge, times
from starloom.operators.similarity import FLOOR

#: Schema of a record: image slots as their likeliest codes and what is left, spectrum slots as coefficients in 8 bits, table slots whole.
RECORD = "item long, image_codes array<array<int>>, image_shares array<array<double>>, image_rest array<double>, spectrum_codes array<array<int>>, spectrum_steps array<double>, spectrum_offsets array<double>, table_shares array<array<double>>"


@dataclass(frozen=True)
class Layout:
    """Where a mode's slots are, how many codes a slot has, how many an image record keeps, and the spectrum's basis."""

    modes: dict[str, tuple[int, int]]
    codes: int
    kept: int
    mean: np.ndarray
    directions: np.ndarray
    floor: float


def recorded(rows: DataFrame, at: Layout) -> DataFrame:
    """Records of rows (item, dist), an array of codes for each slot. Equal shares go to the smaller code."""
    part = lambda mode: F.slice("dist", at.modes[mode][0] + 1, at.modes[mode][1])
    order = F.transform(part("image"), lambda p: F.slice(F.array_sort(F.transform(p, lambda x, i: F.struct((-F.round(x, 12)).alias("r"), i.alias("i"), x.alias("x")))), 1, at.kept))
    spectrum = rows.select("item", F.posexplode(part("spectrum")).alias("slot", "p"))
    held = coefficients.coded(spectrum, "p", at.mean, at.directions).groupBy("item").agg(F.sort_array(F.collect_list(F.struct("slot", "codes", "step", "offset"))).alias("s"))
    image = rows.select("item", order.alias("top"), part("image").alias("image"), part("table").alias("table_shares"))
    field = lambda c, n: F.transform(c, lambda s: s[n])
    return image.join(held, "item").select(
        "item",
        F.transform("top", lambda t: field(t, "i")).alias("image_codes"),
        F.transform("top", lambda t: field(t, "x")).alias("image_shares"),
        F.transform("top", lambda t: F.lit(1.0) - F.aggregate(t, F.lit(0.0), lambda a, x: a + x["x"])).alias("image_rest"),
        field("s", "codes").alias("spectrum_codes"), field("s", "step").alias("spectrum_steps"), field("s", "offset").alias("spectrum_offsets"),
        "table_shares",
    )


def packed(records: DataFrame) -> DataFrame:
    """Records as (item, vec) for tiles: all their numbers in one list."""
    flat = lambda c: F.transform(F.flatten(c), lambda x: x.cast("double"))
    return records.select("item", F.concat(flat("image_codes"), flat("image_shares"), "image_rest", flat("spectrum_codes"), "spectrum_steps", "spectrum_offsets", flat("table_shares")).alias("vec"))


def forms(vec: np.ndarray, at: Layout) -> dict[str, tuple[np.ndarray, float, float]]:
    """Of packed records: for each mode its form (items x slots x numbers), and the shift and floor of a form's products.

    An image's codes stand on an even share of the rest. A spectrum's form is its coefficients and the mean's; with
    directions at right angles, what forms' products lack of the distributions' is the part of the mean that the directions
    don't reach, the shift.
    """
    n, (slots, spectra, tables), rank = len(vec), (at.modes[m][1] for m in ("image", "spectrum", "table")), len(at.directions)
    sizes = [slots * at.kept, slots * at.kept, slots, spectra * rank, spectra, spectra, tables * at.codes]
    codes, shares, rest, k, step, offset, table = np.split(vec, np.cumsum(sizes)[:-1], axis=1)
    image = np.repeat(rest.reshape(n, slots, 1) / (at.codes - at.kept), at.codes, axis=2)
    np.put_along_axis(image, codes.reshape(n, slots, at.kept).astype(np.int64), shares.reshape(n, slots, at.kept), axis=2)
    projected = at.directions @ at.mean
    spectrum = offset[:, :, None] + step[:, :, None] * k.reshape(n, spectra, rank) + projected
    return {"image": (image, 0.0, FLOOR), "spectrum": (spectrum, float(at.mean @ at.mean - projected @ projected), at.floor), "table": (table.reshape(n, tables, at.codes), 0.0, FLOOR)}


def record_scores(at: Layout, chosen: list[str]):  # noqa: ANN201
    """A scorer of tiles of packed records: the chosen modes' log overlaps at the same place, summed."""

    def score(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        a, b, total = forms(left, at), forms(right, at), np.zeros((len(left), len(right)))
        for mode in chosen:
            (x, shift, floor), (y, _, _) = a[mode], b[mode]
            for s in range(x.shape[1]):
                total += np.log(np.maximum(x[:, s] @ y[:, s].T + shift, floor))
        return total

    return score


def properties(rows: DataFrame, vec: str, width: int, measured: dict[str, Column], folds: int = 5) -> DataFrame:
    """(item, property, measured, predicted, width) of rows (item, fold, vec): each property as measured, and as its vector has it.

    A ridge regression predicts measured items out of their fold, and the others by the mean of all folds' models; width is the
    root mean square of the differences out of fold, which come from the models' sums. A property that nobody has measured
    has no predictions.
    """
    out = None
    for name, value in measured.items():
        own = rows.withColumn("_y", value.cast("double")).select("item", "fold", F.col(vec).alias("_v"), "_y")
        known = own.where(F.col("_y").isNotNull())
        if known.isEmpty():
            predicted, spread = F.lit(None).cast("double"), None
        else:
            _, weights, biases = ridge(own, "_v", "_y", width, folds)
            by_fold = [times(F.col("_v"), w[None])[0] + float(b) for w, b in zip(weights, biases)]
            predicted = sum(by_fold[1:], by_fold[0]) / folds
            for f, p in enumerate(by_fold):
                predicted = F.when(F.col("_y").isNotNull() & (F.col("fold") == f), p).otherwise(predicted)
            n, _, products = moments(known.select(F.array(F.col("_y") - predicted).alias("d")), "d", 1)
            spread = float(np.sqrt(products[0, 0] / max(1, n)))
        one = own.select("item", F.lit(name).alias("property"), F.col("_y").alias("measured"), predicted.alias("predicted"), F.lit(spread).cast("double").alias("width"))
        out = one if out is None else out.unionAll(one)
    return out
