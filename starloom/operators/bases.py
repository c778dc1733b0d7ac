"""Bases of groups from sums, with a wider group for small ones; whitening; blocks of features stacked with weights of one sign."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.operators.linear import covariance, moments, ridge, times

#: A kind of fewer rows takes its directions from its whole family; a direction's scale is at least this part of the median.
SHARED, LEAST_SCALE = 128, 0.1


def kind_sums(rows: DataFrame, width: int) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
    """Count, sums and sums of products of vec for each kind of rows (kind, vec): a task sends a row for each kind it met.

    Kinds are few and fixed; the driver gets width * (width + 1) numbers for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            kinds = np.array(batch.column(0).to_pylist(), object)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(kinds), width)
            for kind in set(kinds.tolist()):
                v = x[kinds == kind]
                sums[kind] = sums.get(kind, 0) + np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel()])
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], ["kind", "sums"])

    def added(table: pa.Table) -> pa.Table:
        total = np.sort(np.stack([v.values.to_numpy() for v in table.column("sums")]), axis=0).sum(0)
        return pa.table({"kind": table.column("kind").slice(0, 1), "sums": pa.array([total.tolist()])})

    schema = "kind string, sums array<double>"
    held = rows.select(F.col("kind").cast("string"), "vec").where("vec is not null and kind is not null").mapInArrow(run, schema).groupBy("kind").applyInArrow(added, schema).collect()
    return {r["kind"]: (int(r["sums"][0]), np.array(r["sums"][1 : width + 1]), np.array(r["sums"][width + 1 :]).reshape(width, width)) for r in held}


@dataclass
class Basis:
    """Of one kind: its mean vector, and the directions, centre and scales of its normalised residuals."""

    n: int
    shared: bool
    mean: np.ndarray
    components: np.ndarray
    center: np.ndarray
    scale: np.ndarray


def residual(vec: Column, mean: Column) -> Column:
    """vec less mean, of length 1; 0 where they are the same."""
    less = F.zip_with(vec, mean, lambda a, b: a - b)
    length = F.sqrt(F.aggregate(less, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(less, lambda x: F.coalesce(x / F.nullif(length, F.lit(0.0)), F.lit(0.0)))


def _means(found: dict[str, np.ndarray]) -> Column:
    return F.create_map(*[c for k, m in found.items() for c in (F.lit(k), F.array(*[F.lit(float(x)) for x in m]))])


def bases(rows: DataFrame, family: dict[str, str], width: int, rank: int, least: int = SHARED) -> dict[str, Basis]:
    """A basis for each kind of rows (kind, vec); family names the wider group of each kind.

    Vectors less their kind's mean are made as long as 1; their covariance gives the directions. Sums of kinds add up to those of
    a family, so a kind of fewer than `least` rows takes its family's without another pass. Two passes in all.
    """
    means = {k: total / n for k, (n, total, _) in kind_sums(rows, width).items()}
    if not means:
        return {}
    kinds = rows.withColumn("kind", F.col("kind").cast("string"))
    sums = kind_sums(kinds.withColumn("vec", residual(F.col("vec"), _means(means)[F.col("kind")])), width)
    out = {}
    for kind, (n, _, _) in sums.items():
        members = [k for k in sums if family[k] == family[kind]] if n < least else [kind]
        count, total, products = (sum(sums[k][i] for k in members) for i in range(3))
        values, vectors = np.linalg.eigh(covariance(count, total, products))
        order = np.argsort(-values)[:rank]
        found = vectors[:, order].T
        found = found * np.sign(found[np.arange(len(found)), np.abs(found).argmax(1)])[:, None]
        spread = np.sqrt(np.maximum(values[order], 0.0))
        out[kind] = Basis(n, n < least, means[kind], found, total / count, np.maximum(spread, LEAST_SCALE * np.median(spread)))
    return out


def on_bases(rows: DataFrame, found: dict[str, Basis]) -> DataFrame:
    """rows (kind, vec, ...) with `coefficients`: the residual less the centre, along the kind's directions, over their scales."""
    out = F.lit(None).cast("array<double>")
    for kind, b in found.items():
        less = F.zip_with(residual(F.col("vec"), _means({kind: b.mean})[F.lit(kind)]), F.array(*[F.lit(float(x)) for x in b.center]), lambda a, c: a - c)
        out = F.when(F.col("kind").cast("string") == kind, times(less, b.components / b.scale[:, None])).otherwise(out)
    return rows.withColumn("coefficients", out)


def whitening(rows: DataFrame, vec: str, width: int, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """(offset, projection): (vec - offset) times projection has no correlations and a sample variance of 1 in each direction that there is."""
    n, total, products = moments(rows, vec, width)
    values, vectors = np.linalg.eigh(covariance(n, total, products) * (n / max(1, n - 1)))
    order = np.argsort(-values)[:rank]
    there = values[order] > max(values.max(), 0.0) * 1e-12
    return total / max(1, n), vectors[:, order] * np.where(there, 1 / np.sqrt(np.where(there, values[order], 1.0)), 0.0)


def nonnegative(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The weights of at least 0 with the least w.gram.w / 2 - right.w, by Lawson and Hanson's active set."""
    n = len(right)
    w, active = np.zeros(n), np.zeros(n, bool)
    for _ in range(10 * n + 10):
        slope = right - gram @ w
        if active.all() or (slope[~active] <= 1e-10 * max(1.0, np.abs(right).max())).all():
            break
        active[np.argmax(np.where(active, -np.inf, slope))] = True
        while True:
            s = np.zeros(n)
            s[active] = np.linalg.lstsq(gram[np.ix_(active, active)], right[active], rcond=None)[0]
            low = active & (s <= 0)
            if not low.any():
                break
            step = np.min(w[low] / np.maximum(w[low] - s[low], 1e-300))
            w = w + step * (s - w)
            active &= w > 1e-12
            w[~active] = 0
        w = s
    return w


def stacked(rows: DataFrame, vec: str, target: str, blocks: dict[str, tuple[int, int]], folds: int = 5) -> tuple[DataFrame, dict[str, float], dict[str, float]]:
    """Rows with `predicted`, the blocks' weights (and the bias) and R squared of each block and of the stack.

    A ridge regression on each block (first, width) of vec predicts each row out of its fold; the stack is the mean that
    weighs those predictions by numbers of at least 0. rows has a column fold. Sums alone reach the driver.
    """
    names = list(blocks)
    for name, (first, width) in blocks.items():
        part = rows.withColumn("_part", F.slice(vec, first + 1, width))
        _, weights, biases = ridge(part, "_part", target, width, folds)
        found = F.lit(None).cast("double")
        for f in range(folds):
            found = F.when(F.col("fold") == f, times(F.col("_part"), weights[f][None])[0] + float(biases[f])).otherwise(found)
        rows = part.withColumn(f"_{name}", found).drop("_part")
    both = rows.where(F.col(target).isNotNull()).select(F.array(*[F.col(f"_{n}") for n in names], F.col(target).cast("double")).alias("x"))
    n, total, products = moments(both, "x", len(names) + 1)
    cov = covariance(n, total, products)
    w = nonnegative(cov[:-1, :-1], cov[:-1, -1])
    bias = (total[-1] - w @ total[:-1]) / max(1, n)
    fit = lambda v, b: 1 - (products[-1, -1] - 2 * (v @ products[:-1, -1] + b * total[-1]) + v @ products[:-1, :-1] @ v + 2 * b * (v @ total[:-1]) + n * b * b) / (n * cov[-1, -1])
    scores = {name: float(fit(np.eye(len(names))[i], 0.0)) for i, name in enumerate(names)} | {"stack": float(fit(w, bias))}
    predicted = sum((F.col(f"_{name}") * float(x) for name, x in zip(names, w)), F.lit(float(bias)))
    return rows.withColumn("predicted", predicted).drop(*[f"_{n}" for n in names]), dict(zip(names, w.tolist())) | {"bias": float(bias)}, scores
