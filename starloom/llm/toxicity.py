"""Toxic passages as maximum-scoring segments of token log-odds."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.fitting import TRAIN_ROWS, Logistic, chance, labelled, logistic
from starloom.llm.scratch import row_key, written
from starloom.llm.spans import ALNUM, Words, slices

#: Weight of the Dirichlet prior in words, its even part for each word, the standard errors that a word's log-odds must be from 0, and what
#: each word costs a segment.
PRIOR, EVEN, STANDARD_ERRORS, DRIFT = 500.0, 0.5, 3.0, 0.05
#: Bytes of the prefixes that stand in for words that the model doesn't know, longest first.
PREFIXES = (8, 6)
#: Expected number of chance segments in a text under which a segment is significant.
SIGNIFICANT = 0.05
EULER = 0.5772156649
FEATURES = ["best", "total", "segments", "density"]


@dataclass
class Model:
    """Sorted word hashes with their scores, and the extreme-value law of clean texts: scale and log of K."""

    words: np.ndarray
    scores: np.ndarray
    scale: float
    log_k: float


def forms(words: Words) -> list[np.ndarray]:
    """Hashes of each word and of its prefixes; 0 for a prefix that is the whole word."""
    out = [words.hashes().view(np.int64)]
    for k in PREFIXES:
        cut = Words(words.first, words.data, words.starts, np.minimum(words.ends, words.starts + k), words.bounds, words.offsets)
        out.append(np.where(words.ends - words.starts > k, cut.hashes().view(np.int64) ^ np.int64(k), 0))
    return out


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) to (word, texts with it that are toxic, that are clean, its number in clean texts), summed in each batch."""
    for batch in batches:
        label = batch.column("label").to_numpy(zero_copy_only=False) > 0.5
        found: list[list[np.ndarray]] = [[], [], [], []]
        for words in slices(batch.column("text"), ALNUM, True):
            hashes = np.stack(forms(words))
            for row in range(len(words)):
                w, n = np.unique(hashes[:, words.bounds[row] : words.bounds[row + 1]], return_counts=True)
                toxic = np.full(len(w), bool(label[words.first + row]))
                for held, x in zip(found, (w, toxic.astype(np.int64), (~toxic).astype(np.int64), np.where(toxic, 0, n)), strict=True):
                    held.append(x)
        if not found[0]:
            continue
        w, at = np.unique(np.concatenate(found[0]), return_inverse=True)
        sums = [np.bincount(at, np.concatenate(x), len(w)).astype(np.int64) for x in found[1:]]
        yield pa.RecordBatch.from_arrays([pa.array(w), *map(pa.array, sums)], ["word", "toxic", "clean", "clean_n"])


def fit_words(rows: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(label, text) to (word, score, clean_n): log-odds of a word or prefix among toxic and clean texts under a Dirichlet prior.

    The prior of a word is EVEN and `prior` times its share of all words, so a rare word needs more evidence. Words within
    STANDARD_ERRORS of 0 have no row; all others have. Their number is bounded by the labelled rows', not by the corpus.
    """
    counts = rows.mapInArrow(word_counts, "word long, toxic long, clean long, clean_n long").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "clean_n")])
    counts = written(counts)
    t, c = (float(x or 0) for x in counts.agg(F.sum("toxic"), F.sum("clean")).first())
    a = F.lit(EVEN) + (F.col("toxic") + F.col("clean")) * F.lit(prior / max(1.0, t + c))
    prior += EVEN * counts.count()

    def log_odds(y: Column, n: float) -> Column:
        return F.log((y + a) / (F.lit(n + prior) - y - a))

    error = F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a))
    scored = counts.withColumn("score", log_odds(F.col("toxic"), t) - log_odds(F.col("clean"), c)).withColumn("far", F.abs("score") / error)
    return scored.where((F.col("far") >= STANDARD_ERRORS) & (F.col("word") != 0)).select("word", "score", "clean_n")


def scale_of(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(share * exp(root * score)) = 1, by bisection; 1 where there is none."""
    if not (scores > 0).any() or (scores * shares).sum() >= 0:
        return 1.0
    value = lambda x: float((shares * np.exp(np.minimum(x * scores, 500.0))).sum()) - 1
    low, high = 0.0, 1.0
    while value(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return max(high, 1e-3)


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end), in one pass (Ruzzo and Tompa)."""
    upto = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[list[float]] = []  # sum before, sum after, start, end
    for i in np.flatnonzero(scores > 0).tolist():
        new = [float(upto[i]), float(upto[i + 1]), i, i + 1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= new[0]:
                j = int(stack[j][4])
            if j < 0 or stack[j][1] >= new[1]:
                stack.append([*new, j])
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(x[1] - x[0], int(x[2]), int(x[3])) for x in stack]


def passages(model: Model, significant: float = SIGNIFICANT) -> Callable:
    """(id, key, text) to the significant toxic passages of each text, and the features of its score.

    A segment of score s in a text of n words has K n exp(-scale s) equals by chance. `best` is the excess of the best
    segment in this law's units, `total` that of all significant ones, `density` their share of the words.
    """
    none = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("expected", pa.float64())]))
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), *((c, pa.float64()) for c in FEATURES), ("passages", none)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, features, spans = [], [], []
            for words in slices(batch.column("text"), ALNUM, True):
                scores = np.full(len(words.starts), -DRIFT)
                unknown = np.ones(len(scores), bool)
                for hashes in forms(words) if len(model.words) else ():
                    at = np.minimum(np.searchsorted(model.words, hashes), len(model.words) - 1)
                    known = unknown & (model.words[at] == hashes)
                    scores[known] += model.scores[at[known]]
                    unknown &= ~known
                for row in range(len(words)):
                    x = scores[words.bounds[row] : words.bounds[row + 1]]
                    n, found = len(x), segments(x)
                    excess = [(model.scale * s - model.log_k - math.log(n), a, b) for s, a, b in found]
                    hits = [(e, a, b) for e, a, b in excess if math.exp(min(-e, 50.0)) <= significant]
                    best = max((e for e, _, _ in excess), default=-10.0)
                    covered = sum(b - a for _, a, b in hits)
                    features.append((max(-10.0, min(best, 40.0)), min(sum(e for e, _, _ in hits), 200.0), min(len(hits), 20), covered / max(n, 1)))
                    sizes.append(n)
                    spans.append([{"start": a, "end": b, "expected": math.exp(-min(e, 700.0))} for e, a, b in hits])
            columns = np.array(features, np.float64).reshape(-1, len(FEATURES)).T
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(sizes, pa.int64()), *(pa.array(c) for c in columns), pa.array(spans, none)], schema=schema)

    return run


def detect(rows: DataFrame, model: Model) -> DataFrame:
    """(id, key, text) to id, key, n_words, FEATURES and passages."""
    kinds = ", ".join(f"{c} double" for c in FEATURES)
    return rows.mapInArrow(passages(model), f"id long, key long, n_words long, {kinds}, passages array<struct<start: long, end: long, expected: double>>")


def fit(train: DataFrame) -> tuple[Model, Logistic | None]:
    """From (id, key, label, text): words from two thirds of the rows, the law and the calibration from the other third."""
    held = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(3)) == 0
    train = written(train.where("label is not null"))
    words = fit_words(train.where(~held).select("label", "text")).toPandas().sort_values("word")
    scores = words["score"].to_numpy(np.float64)
    n = train.where(~held & (F.col("label") <= 0.5)).agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 1
    shares = words["clean_n"].to_numpy(np.float64) / max(n, words["clean_n"].sum(), 1)
    scale = scale_of(np.append(scores - DRIFT, -DRIFT), np.append(shares, 1 - shares.sum()))
    model = Model(words["word"].to_numpy(np.int64), scores, scale, 0.0)
    rest = train.where(held).dropDuplicates(["key"])  # a row repeated whole counts once here
    labels = rest.select(F.col("key").alias("t_key"), "label")
    seen = written(detect(rest.select("id", "key", "text"), model).join(labels, F.col("key") == F.col("t_key")))
    mean = seen.where("label <= 0.5 and best > -10").agg(F.avg("best")).first()[0]
    log_k = 0.0 if mean is None else min(5.0, max(-15.0, mean - EULER))  # the mean of the law is its place plus Euler's constant
    model.log_k = log_k
    seen = detect(rest.select("id", "key", "text"), model).join(labels, F.col("key") == F.col("t_key"))
    return model, logistic(seen, FEATURES)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted, n_words, passages.

    Labels are learned only from ids whose crc32 as text, modulo 3, is not 1, and from at most `train_rows` of them;
    only the text enters a score. Null and empty texts have no words and the score of a text without a toxic segment.
    Where the labels have one class only, every score is its share. A null id is held out of nothing.
    """
    part = lambda c: F.pmod(F.crc32(F.col(c).cast("string")), F.lit(3))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("key"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    sample = labelled(labels, "toxic", part("doc_id") != 1, train_rows)
    model, calibrated = fit(rows.join(sample, F.col("id") == F.col("l_id")).select("id", "key", "label", "text"))
    found = detect(rows, model)
    if calibrated is None:
        share = sample.agg(F.avg("label")).first()[0]
        score = F.lit(float(share or 0.0))
    else:
        score = chance(calibrated.log_odds())
    return found.select(
        F.col("id").alias("doc_id"),
        F.coalesce(part("id") == 1, F.lit(False)).alias("held_out"),
        score.alias("score"),
        F.when(score >= 0.7, 1).otherwise(0).cast("int").alias("predicted"),
        "n_words",
        "passages",
    )
