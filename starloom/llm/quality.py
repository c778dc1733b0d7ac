"""Quality classifier with hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.fitting import TRAIN_ROWS, chance, labelled, logistic
from starloom.llm.scratch import row_key, written
from starloom.llm.spans import NOT_SPACE, slices

#: Shape of a text, each between 0 and 1 or a logarithm.
FEATURES = ["log_words", "word_length", "upper", "digits", "symbols", "bars", "marked", "distinct", "repeated", "shouted", "line_words"]
#: A posterior under this is rejected; how much a site's evidence counts against the document's own.
THRESHOLD, SITE_WEIGHT = 0.5, 0.5
#: Words among which distinct ones are counted, so that the share doesn't fall with a text's length.
BLOCK = 256
_UPPER, _DIGIT, _SYMBOL, _LETTER = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SYMBOL[[ord(c) for c in "#$%&*!<>=@^_~{}[]\\+/"]] = True
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True


def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, text) to the features of each text."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), *((c, pa.float64()) for c in FEATURES)])
    for batch in batches:
        out: list[tuple[float, ...]] = []
        for words in slices(batch.column("text"), NOT_SPACE, False):
            hashes, data, b = words.hashes(), words.data, words.bounds
            upto = [np.concatenate([[0], np.cumsum(t[data])]) for t in (_UPPER, _DIGIT, _SYMBOL, _LETTER)]
            bars, lines = (np.concatenate([[0], np.cumsum(data == ord(c))]) for c in "|\n")
            sizes = words.ends - words.starts
            marked = np.concatenate([[0], np.cumsum(_SYMBOL[data[words.ends - 1]])])
            capital = (upto[0][words.ends] - upto[0][words.starts] >= 2) & (upto[0][words.ends] - upto[0][words.starts] >= 0.5 * (upto[3][words.ends] - upto[3][words.starts]))
            shouted = np.concatenate([[0], np.cumsum(capital)])
            for row in range(len(words)):
                low, high = b[row : row + 2]
                start, end = words.offsets[row : row + 2]
                n, size = int(high - low), max(1, int(end - start))
                if not n:
                    out.append((0.0,) * len(FEATURES))
                    continue
                of = [int(u[end] - u[start]) for u in upto]
                h = hashes[low:high]
                same = int((h[1:] == h[:-1]).sum())
                out.append(
                    (
                        float(np.log1p(n)),
                        min(1.0, float(sizes[low:high].mean()) / 20),
                        of[0] / max(1, of[3]),
                        of[1] / size,
                        min(1.0, 10 * of[2] / size),
                        min(1.0, (bars[end] - bars[start]) / n),
                        (marked[high] - marked[low]) / n,
                        sum(len(np.unique(h[i : i + BLOCK])) for i in range(0, n, BLOCK)) / n,
                        same / n,
                        (shouted[high] - shouted[low]) / n,
                        min(1.0, n / (1 + lines[end] - lines[start]) / 100),
                    )
                )
        columns = np.array(out, np.float64).reshape(-1, len(FEATURES)).T
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), *(pa.array(c) for c in columns)], schema=schema)


def strength(sites: DataFrame, n: str, mean: str, prior: str) -> Column:
    """Prior observations of a level, by moments: within variance over between variance, from 1 to 10,000.

    sites has a row for each site with its number of documents, its mean chance and the mean of the level above.
    """
    m, p = F.col(mean), F.col(prior)
    weight = F.col(n).cast("double")
    sums = sites.agg(
        F.sum(weight * (m - p) * (m - p)).alias("between"),
        F.sum(p * (1 - p)).alias("within"),
        F.sum(weight - 1).alias("free"),
        F.sum(weight * p * (1 - p)).alias("spread"),
    ).first()
    if not sums["free"] or not sums["spread"]:
        return F.lit(10_000.0)
    # E[sum n (m - p)^2] = sum p (1 - p) + tau sum (n - 1) p (1 - p), tau = 1 / (1 + strength)
    tau = max(1e-9, (sums["between"] - sums["within"]) / max(1e-9, sums["spread"] - sums["within"]))
    return F.lit(float(min(10_000.0, max(1.0, 1 / tau - 1))))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: doc_id, key (see `row_key`), host, path, classifier, site, quality, accepted.

    1. A logistic classifier on a text's shape, fitted on at most `train_rows` labelled rows, gives its own chance.
    2. Chances are summed by host and path, then by host, then in all. A host's posterior mean shrinks to the global
       mean, a path's to its host's, each by a strength estimated from how much sites differ: sparse sites stay near
       the level above.
    3. The site's log-odds against the global mean, without the document's own part, add to the document's.

    host and path are columns of docs, by default source and lang; null is a site of its own. Null and empty texts
    have all features 0. Where labels have one class only, every chance is its share.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("key"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text_col).alias("text"))
    kinds = ", ".join(f"{c} double" for c in FEATURES)
    packed = rows.select("id", "key", "text", "host", "path")
    shaped = packed.mapInArrow(_with_site, f"id long, key long, {kinds}, host string, path string")
    shaped = written(shaped)
    sample = labelled(labels, "quality", None, train_rows)
    model = logistic(shaped.join(sample, F.col("id") == F.col("l_id")), FEATURES)
    share = float(sample.agg(F.avg("label")).first()[0] or 0.5)
    own = F.lit(share) if model is None else chance(model.log_odds())
    scored = shaped.select("id", "key", "host", "path", own.alias("classifier"))
    by_path = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("classifier").alias("sum")))
    by_host = by_path.groupBy("host").agg(F.sum("n").alias("h_n"), F.sum("sum").alias("h_sum")).withColumnRenamed("host", "h_host")
    n, total = by_path.agg(F.sum("n"), F.sum("sum")).first()
    top = min(1 - 1e-6, max(1e-6, (total or 0.0) / max(1, n or 0)))
    hosts = by_host.withColumn("prior", F.lit(top)).withColumn("mean", F.col("h_sum") / F.col("h_n"))
    k_host = strength(hosts, "h_n", "mean", "prior")
    hosts = written(hosts.withColumn("h_mean", (F.col("h_sum") + k_host * top) / (F.col("h_n") + k_host)).select("h_host", "h_n", "h_sum", "h_mean"))
    paths = by_path.join(hosts, F.col("host").eqNullSafe(F.col("h_host"))).withColumn("mean", F.col("sum") / F.col("n"))
    k_path = strength(paths, "n", "mean", "h_mean")
    sites = written(paths.select(F.col("host").alias("s_host"), F.col("path").alias("s_path"), F.col("n").alias("s_n"), F.col("sum").alias("s_sum"), "h_n", "h_sum"))
    both = scored.join(sites, F.col("host").eqNullSafe(F.col("s_host")) & F.col("path").eqNullSafe(F.col("s_path")))
    p = F.col("classifier")
    above = (F.col("h_sum") - p + k_host * top) / (F.col("h_n") - 1 + k_host)
    site = (F.col("s_sum") - p + k_path * above) / (F.col("s_n") - 1 + k_path)
    odds = lambda x: F.log(x / (1 - x))
    site = F.least(F.greatest(site, F.lit(1e-6)), F.lit(1 - 1e-6))
    out = both.withColumn("site", site)
    out = out.withColumn("quality", chance(odds(p) + F.lit(SITE_WEIGHT) * (odds(F.col("site")) - odds(F.lit(top)))))
    return out.select(F.col("id").alias("doc_id"), "key", "host", "path", "classifier", "site", "quality", (F.col("quality") >= threshold).alias("accepted"))


def _with_site(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`shapes`, with the site of each row beside."""
    for batch in batches:
        for out in shapes(iter([batch])):
            yield pa.RecordBatch.from_arrays([*out.columns, batch.column("host"), batch.column("path")], [*out.schema.names, "host", "path"])
