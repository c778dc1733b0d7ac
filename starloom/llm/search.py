"""Ranked lexical search: bundles of items carry accumulators through the owners of terms, one after another."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.scratch import written
from starloom.llm.spans import ALNUM, slices

#: Terms in lower-cased (A-Z) texts.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most terms of the items that one dictionary holds; more terms make more dictionaries and more scans.
DICTIONARY = 200_000
#: Most accumulators of a block of documents (items x documents), and the bounds of its documents.
CELLS, LEAST_DOCS, MOST_DOCS = 1 << 19, 64, 4096
#: Owners of a dictionary's terms, rarest first: the terms in at most so large a part of all documents.
OWNERS = (1 / 64, 1 / 8, 1 / 2, 1.0)
SCALE, SOFT, SHARE = 1_000_000_000, 8, 75


@dataclass
class Dictionary:
    """Terms by hash, with their bytes."""

    hashes: np.ndarray
    order: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, terms: list[str]) -> Dictionary:
        found = [(w.hashes(), w.data[np.concatenate([np.arange(s, e) for s, e in zip(w.starts, w.ends)])], w.ends - w.starts) for w in slices(pa.array(terms, pa.string()), ALNUM, True)]
        hashes, sizes = np.concatenate([f[0] for f in found]), np.concatenate([f[2] for f in found])
        order = np.argsort(hashes, kind="stable")
        if len(hashes) != len(terms) or (np.diff(hashes[order]) == 0).any():
            raise ValueError("two terms of the items share a 64-bit hash")
        return cls(hashes[order], order, np.concatenate([f[1] for f in found]), np.cumsum(sizes) - sizes, sizes)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of those words that are terms, and their terms; equal hashes are compared as bytes."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        places = np.flatnonzero(self.hashes[at] == hashes)
        terms = self.order[at[places]]
        sizes = self.sizes[terms]
        same = sizes == ends[places] - starts[places]
        places, terms, sizes = places[same], terms[same], sizes[same]
        if len(places):
            heads = np.cumsum(sizes) - sizes
            step = np.arange(int(sizes.sum())) - np.repeat(heads, sizes)
            equal = data[step + np.repeat(starts[places], sizes)] == self.data[step + np.repeat(self.starts[terms], sizes)]
            good = np.logical_and.reduceat(equal, heads)
            places, terms = places[good], terms[good]
        return places, terms


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def counted(docs: DataFrame, terms: list[str], kind: str) -> DataFrame:
    """(doc_id, mark, n, terms, tfs) of each row of docs (doc_id, text) with a word: n words, and the given terms' counts in it."""
    held = docs.sparkSession.sparkContext.broadcast(Dictionary.of(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in slices(batch.column(2), ALNUM, True):
                n = np.diff(w.bounds)
                places, found = held.value.find(w.data, w.starts, w.ends, w.hashes())
                rows = np.searchsorted(w.bounds, places, "right") - 1
                pairs, tfs = np.unique(rows.astype(np.int64) * len(terms) + found, return_counts=True)
                some = n > 0
                sizes = np.bincount(pairs // len(terms), minlength=len(n))[some]
                ids, marks = (batch.column(i).slice(w.first, len(w)).filter(pa.array(some)) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, marks, pa.array(n[some].astype(np.int64)), _lists((pairs % len(terms)).astype(np.int32), sizes, pa.int32()), _lists(tfs.astype(np.int32), sizes, pa.int32())], ["doc_id", "mark", "n", "terms", "tfs"])

    marked = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("mark"), "text")
    return written(marked.mapInArrow(run, f"doc_id {kind}, mark long, n long, terms array<int>, tfs array<int>"), 1000)


def postings(rows: DataFrame, blocks: int, total: int, count: int, owner: np.ndarray, kind: str) -> DataFrame:
    """(owner, block, term, docs, parts): lists of each term in each block of documents; owner -1 has the block's ids instead.

    A document is known by its place in its block, in the order of its id (null last) and mark. Parts are what a term
    gives a document but for the term's weight.
    """
    held = rows.sparkSession.sparkContext.broadcast(owner)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("doc_id", "ascending"), ("mark", "ascending")])
        block = table.column("block")[0].as_py()
        sizes = pc.list_value_length(table.column("terms")).to_numpy()
        terms, tfs = (pc.list_flatten(table.column(c)).to_numpy().astype(np.int64) for c in ("terms", "tfs"))
        docs = np.repeat(np.arange(len(table)), sizes)
        m = 100 - SHARE + (SHARE * table.column("n").to_numpy() * count) // total
        parts = (SCALE * tfs) // (1000 * tfs + SOFT * m[docs])
        order = np.argsort(terms, kind="stable")
        distinct, each = np.unique(terms, return_counts=True)
        k = len(distinct)
        return pa.table({
            "owner": pa.array(np.concatenate([held.value[distinct], [-1]]), pa.int32()),
            "block": pa.array([block] * (k + 1), pa.int32()),
            "term": pa.array(np.concatenate([distinct, [-1]]), pa.int32()),
            "docs": _lists(docs[order].astype(np.int32), np.concatenate([each, [0]]), pa.int32()),
            "parts": _lists(parts[order], np.concatenate([each, [0]]), pa.int64()),
            "ids": pa.ListArray.from_arrays(pa.array([0] * (k + 1) + [len(table)], pa.int32()), table.column("doc_id").combine_chunks()),
        })

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("mark"), F.lit(blocks)).cast("int"))
    return written(dealt.groupBy("block").applyInArrow(run, f"owner int, block int, term int, docs array<int>, parts array<long>, ids array<{kind}>"))


def _added(k: int):
    """A stage: the accumulators of a block's items meet the lists of an owner's terms in that block."""

    def run(items: pa.Table, lists: pa.Table) -> pa.Table:
        items, lists = items.combine_chunks(), lists.combine_chunks()
        n, docs_of, seen = len(items), lists.column("docs").to_pylist(), pc.list_flatten(items.column("docs")).to_numpy()
        width = 1 + max([int(seen.max()) if len(seen) else -1, *[max(d) for d in docs_of if d]])
        acc = np.zeros((n, width), np.int64)
        acc[np.repeat(np.arange(n), pc.list_value_length(items.column("docs")).to_numpy()), seen] = pc.list_flatten(items.column("scores")).to_numpy()
        wanted = pc.list_flatten(items.column("terms")).to_numpy()
        by = np.repeat(np.arange(n), pc.list_value_length(items.column("terms")).fill_null(0).to_numpy())
        times = pc.list_flatten(items.column("times")).to_numpy()
        order = np.argsort(wanted, kind="stable")
        wanted, by, times = wanted[order], by[order], times[order]
        parts = lists.column("parts")
        for i, term in enumerate(lists.column("term").to_pylist()):
            lo, hi = np.searchsorted(wanted, [term, term + 1])
            if lo < hi:
                acc[np.ix_(by[lo:hi], docs_of[i])] += times[lo:hi, None] * parts[i].values.to_numpy()[None, :]
        rest, least = items.column("rest").to_numpy()[:, None], items.column("least").to_numpy()
        if width >= k:
            least = np.maximum(least, np.partition(acc, width - k, axis=1)[:, width - k])
        kept = (acc > 0) & (acc + rest >= least[:, None])
        top = -np.sort(-np.where(kept, acc, 0), axis=1)[:, :k] if width else acc
        rows, docs = np.nonzero(kept)
        sizes = kept.sum(1)
        return pa.table({"block": items.column("block"), "item": items.column("item"), "docs": _lists(docs.astype(np.int32), sizes, pa.int32()), "scores": _lists(acc[rows, docs], sizes, pa.int64()), "top": _lists(top[top > 0], (top > 0).sum(1), pa.int64())})

    return run


def _selected(k: int):
    """The best of a block by score and place, with their ids."""

    def run(items: pa.Table, places: pa.Table) -> pa.Table:
        items, ids = items.combine_chunks(), places.column("ids").combine_chunks()
        ids = ids[0].values if len(ids) else None
        out_items, out_docs, out_scores = [], [], []
        for item, docs, scores in zip(items.column("item").to_pylist(), items.column("docs"), items.column("scores")):
            docs, scores = docs.values.to_numpy(), scores.values.to_numpy()
            best = np.lexsort((docs, -scores))[:k]
            out_items += [item] * len(best)
            out_docs += docs[best].tolist()
            out_scores += scores[best].tolist()
        kind = places.schema.field("ids").type.value_type
        found = ids.take(pa.array(out_docs, pa.int32())) if ids is not None else pa.array([], kind)
        return pa.table({"item": pa.array(out_items, pa.int64()), "doc_id": found, "score": pa.array(out_scores, pa.int64())})

    return run


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", dictionary: int = DICTIONARY, cells: int = CELLS) -> DataFrame:
    """(item_id, rank, doc_id, score, n_terms): the k best documents of each item, best first, equal scores by doc_id.

    Documents are dealt into blocks, so that a block's accumulators are bounded whatever the table; terms have owners,
    rarest first. An item's bundle visits each block with its terms and its accumulators and goes from owner to owner:
    a stage is a cogroup of the bundles with the owner's lists, block by block, which adds whole numbers. Between
    stages the k-th best score so far of each item over all blocks is known, and the most that later owners can add:
    an accumulator that can't reach that score any more is dropped. That loses nothing, since scores only grow.

    Only the items' own terms are counted in the documents, from a dictionary of bounded size; items with more terms
    than that take several scans and more owners. The corpus's counts (documents, terms, documents of a term) cover all
    documents. A null or empty text has no terms; such documents aren't counted and such items have no rows. Repeated
    rows of documents and items count each; null ids come last among equal scores. Other columns aren't read; an empty
    table gives no rows. n_terms is the number of the item's terms, with repeats.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{doc_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"item_id {item_kind}, rank int, doc_id {kind}, score long, n_terms long"
    found = F.regexp_extract_all(F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))
    asked = written(items.select(F.col(f"`{item_col}`").alias("item_id"), found.alias("all")).where(F.size("all") > 0).withColumn("item", F.monotonically_increasing_id()))
    n_items = asked.count()
    if n_items == 0:
        return spark.createDataFrame([], schema)
    needed = written(asked.select("item", F.explode("all").alias("text_term")).groupBy("item", "text_term").agg(F.count("*").alias("times")))
    vocabulary = written(needed.select("text_term").distinct())
    parts = max(1, -(-vocabulary.count() // dictionary))
    facts, lists, blocks = [], [], 0
    for part in range(parts):
        terms = [r[0] for r in vocabulary.where(F.pmod(F.xxhash64("text_term"), F.lit(parts)) == part).collect()]
        if not terms:
            continue
        rows = counted(docs, terms, kind)
        count, total = rows.agg(F.count("*"), F.sum("n")).first()
        if not count:
            return spark.createDataFrame([], schema)
        blocks = -(-count // min(MOST_DOCS, max(LEAST_DOCS, cells // n_items)))
        df = np.zeros(len(terms), np.int64)
        for term, n in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most a dictionary
            df[term] = n
        weight = np.floor(1000 * np.log((2 * count + 2) / (2 * df + 1))).astype(np.int64)
        owner = np.searchsorted(np.array(OWNERS), df / count).astype(np.int32)
        found_lists = postings(rows, blocks, total, count, owner, kind)
        peak = np.zeros(len(terms), np.int64)
        for term, p in found_lists.where("owner >= 0").groupBy("term").agg(F.max(F.array_max("parts"))).collect():
            peak[term] = p
        fact = pd.DataFrame({"text_term": terms, "term": np.arange(len(terms), dtype=np.int32), "stage": owner * parts + part, "weight": weight, "bound": weight * peak, "df": df})
        facts.append(written(spark.createDataFrame(fact, "text_term string, term int, stage int, weight long, bound long, df long")))
        lists.append((part, found_lists))
    known = facts[0]
    for f in facts[1:]:
        known = known.unionAll(f)
    known = written(needed.join(known.where("df > 0 AND weight > 0"), "text_term"))
    stages = sorted(r[0] for r in known.select("stage").distinct().collect())
    every = asked.select("item")
    state = every.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "item", F.array().cast("array<int>").alias("docs"), F.array().cast("array<long>").alias("scores"))
    least = None
    for stage in stages:
        here = F.when(F.col("stage") == stage, F.struct("term", (F.col("times") * F.col("weight")).alias("times")))
        load = known.groupBy("item").agg(F.collect_list(here).alias("here"), F.sum(F.when(F.col("stage") > stage, F.col("times") * F.col("bound")).otherwise(0)).alias("rest"))
        load = every.join(load, "item", "left").select("item", F.coalesce(F.col("here.term"), F.array().cast("array<int>")).alias("terms"), F.coalesce(F.col("here.times"), F.array().cast("array<long>")).alias("times"), F.coalesce("rest", F.lit(0)).alias("rest"))
        load = load.withColumn("least", F.lit(0).cast("long")) if least is None else load.join(least, "item", "left").withColumn("least", F.coalesce("least", F.lit(0)))
        owned = next(found_lists for part, found_lists in lists if part == stage % parts).where(F.col("owner") == stage // parts).select("block", "term", "docs", "parts")
        bundles = state.select("block", "item", "docs", "scores").join(written(load), "item")
        state = written(bundles.groupBy("block").cogroup(owned.groupBy("block")).applyInArrow(_added(k), "block int, item long, docs array<int>, scores array<long>, top array<long>"))
        tops = state.select("item", F.explode("top").alias("score")).withColumn("nth", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"))))
        least = tops.where(F.col("nth") <= k).groupBy("item").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    if not stages:
        return spark.createDataFrame([], schema)
    places = lists[0][1].where("owner = -1").select("block", "ids")
    best = state.where(F.size("docs") > 0).groupBy("block").cogroup(places.groupBy("block")).applyInArrow(_selected(k), f"item long, doc_id {kind}, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    best = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(asked.select("item", "item_id", F.size("all").cast("long").alias("n_terms")), "item").select("item_id", "rank", "doc_id", "score", "n_terms")


def _sql(k: int = 10) -> str:
    """DuckDB's SQL of the query."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents
), s AS (
  SELECT count(*) AS docs, sum(len(w))::BIGINT AS words FROM d WHERE len(w) > 0
), i AS (
  SELECT row_number() OVER () AS q, item_id, {words} AS w FROM benchmark
), u AS (
  SELECT q, term, count(*) AS times FROM (SELECT q, unnest(w) AS term FROM i) GROUP BY q, term
), t AS (
  SELECT r, n, term, count(*) AS tf FROM (SELECT r, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM u) GROUP BY r, n, term
), f AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term, docs
), c AS (
  SELECT u.q, t.r, sum(u.times * f.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (25 + (75 * t.n * docs) // words))))::BIGINT AS score FROM u JOIN t USING (term) JOIN f USING (term), s GROUP BY u.q, t.r
), b AS (
  SELECT i.item_id, c.score, d.doc_id, len(i.w) AS n_terms, row_number() OVER (PARTITION BY c.q ORDER BY c.score DESC, d.doc_id NULLS LAST) AS rank FROM c JOIN d USING (r) JOIN i USING (q) WHERE c.score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score, n_terms::BIGINT AS n_terms FROM b WHERE rank <= {k}
"""


SQL = _sql()
