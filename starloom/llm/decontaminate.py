"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.scratch import bitmap, bits_for, in_bitmap, row_key, written
from starloom.llm.spans import ALNUM, Words, grams, rolling_min, slices

#: Words of a shared span that is always found, and of a k-gram.
SPAN, GRAM = 10, 5


def selected(hashes: np.ndarray, of_word: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowing: places and hashes of the grams that are the least of some run of `length` words within a row.

    Of equal grams of a run the last is taken. Runs that overlap mostly share their least gram, so few are selected;
    equal runs select the same gram at the same place, so every shared run is found at one that both have.
    """
    k = min(GRAM, length)
    found = grams(hashes, k)
    least = rolling_min(found, length - k + 1)
    if not len(least):
        return np.zeros(0, np.int64), found[:0]
    at, first = np.zeros(len(least), np.int64), np.arange(len(least))
    for j in range(length - k + 1):
        at = np.where(found[j : j + len(least)] == least, first + j, at)
    places = np.unique(at[of_word[: len(least)] == of_word[length - 1 :]])
    return places, found[places]


def _texts(words: Words, low: int, high: int) -> list[str]:
    return [words.data[s:e].tobytes().decode() for s, e in zip(words.starts[low:high], words.ends[low:high], strict=True)]


def _around(words: Words, at: int, length: int, low: int, high: int) -> tuple[str, list[str], list[str]]:
    """A gram's text, the words before it, nearest first, and those after it, as far as a run with it reaches in its row."""
    k = min(GRAM, length)
    return " ".join(_texts(words, at, at + k)), _texts(words, max(low, at - length + k), at)[::-1], _texts(words, at + k, min(high, at + length))


_STRINGS = pa.list_(pa.string())
_PRINTS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("fingerprint", pa.int64()), ("gram", pa.string()), ("before", _STRINGS), ("after", _STRINGS)]))
_PRINT = "length: long, fingerprint: long, gram: string, before: array<string>, after: array<string>"


def item_prints(span: int) -> Callable:
    """(id, text) to the fingerprints of each text for runs of `span` words; of a shorter text that isn't empty, of its own length."""
    names = ["item", "length", "fingerprint", "gram", "before", "after"]
    schema = pa.schema([("item", pa.string()), ("length", pa.int64()), ("fingerprint", pa.int64()), ("gram", pa.string()), ("before", _STRINGS), ("after", _STRINGS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for words in slices(batch.column("text"), ALNUM, True):
                hashes, out = words.hashes(), {n: [] for n in names}
                for row in range(len(words)):
                    low, high = words.bounds[row : row + 2]
                    if (length := int(min(span, high - low))) == 0:
                        continue
                    places, prints = selected(hashes[low:high], np.zeros(high - low, np.int64), length)
                    for at, value in zip((places + low).tolist(), prints.view(np.int64).tolist(), strict=True):
                        for name, x in zip(names, (ids[words.first + row].as_py(), length, value, *_around(words, at, length, low, high)), strict=True):
                            out[name].append(x)
                yield pa.RecordBatch.from_arrays([pa.array(out[n], schema.field(n).type) for n in names], schema=schema)

    return run


def document_prints(lengths: list[int], held: object, bits: int) -> Callable:
    """(id, key, text) to n_words and the fingerprints that may be among the items'; held is a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found = [], []
            for words in slices(batch.column("text"), ALNUM, True):
                hashes = words.hashes()
                of_word = np.repeat(np.arange(len(words)), np.diff(words.bounds))
                rows: list[list] = [[] for _ in range(len(words))]
                for length in lengths:
                    places, prints = selected(hashes, of_word, length)
                    some = in_bitmap(held.value, prints, bits)
                    for at, value in zip(places[some].tolist(), prints[some].view(np.int64).tolist(), strict=True):
                        row = of_word[at]
                        low, high = words.bounds[row : row + 2]
                        gram, before, after = _around(words, at, length, low, high)
                        rows[row].append({"start": at - low, "length": length, "fingerprint": value, "gram": gram, "before": before, "after": after})
                counts.append(np.diff(words.bounds))
                found += rows
            n_words = pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), n_words, pa.array(found, _PRINTS)], ["id", "key", "n_words", "prints"])

    return run


def _alike(a: str, b: str) -> Column:
    """How many first entries two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN) -> DataFrame:
    """One row for each document: doc_id, key (see `row_key`), n_words, n_hit, n_items, items_sha256, contaminated.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z is lower-cased. A window is `span` consecutive words of an
    item; an item of fewer words, but not none, is one window. Words inside any occurrence of a window are hit. n_items
    counts the items with occurring windows; items_sha256 is over their ids, sorted as strings, comma-joined. Null and
    empty texts have no words and no windows. Rows repeated whole get a row each; items that share an id count once;
    a null item id is not listed.

    Winnowing: each run of `span` words, of an item or a document, selects the least hash of its grams of GRAM words, and
    only those selected are kept, about two in seven. A bitmap of fixed size holds the items' and lets documents drop
    almost all of theirs where they are read. The rest join on hash and gram, and each hit is extended word by word to
    both sides, as far as a run with that gram can reach; it counts if the shared words make up a whole run, which makes
    the result exact. Shorter items are runs of their own length. Items that look alike around a gram meet it as one.
    Texts are taken whole; columns other than the id and the text, whatever their names, aren't looked at.
    """
    prints = written(
        items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text"))
        .mapInArrow(item_prints(span), f"item string, {_PRINT.replace(': ', ' ')}")
        .groupBy("length", "fingerprint", "gram", F.col("before").alias("i_before"), F.col("after").alias("i_after"))
        .agg(F.collect_set("item").alias("items"))
    )
    n, lengths = prints.count(), sorted(x[0] for x in prints.select("length").distinct().collect())
    bits = bits_for(n, 1024)
    held = docs.sparkSession.sparkContext.broadcast(bitmap(prints, "fingerprint", bits))
    found = written(
        docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
        .mapInArrow(document_prints(lengths, held, bits), f"id {docs.schema[id_col].dataType.simpleString()}, key long, n_words long, prints array<struct<start: long, {_PRINT}>>")
        .withColumn("row", F.monotonically_increasing_id())
    )
    met = found.where(F.size("prints") > 0).select("row", F.explode("prints").alias("r")).select("row", "r.*").join(prints, ["length", "fingerprint", "gram"])
    back, on = _alike("before", "i_before"), _alike("after", "i_after")
    gram = F.least(F.lit(GRAM), "length")
    met = met.select("row", "items", "length", (F.col("start") - back).alias("start"), (F.col("start") + gram + on).alias("end"))
    hits = met.where(F.col("end") - F.col("start") >= F.col("length")).groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        F.array_sort("spans"),
        zero,
        lambda a, s: F.struct(F.greatest(a["upto"], s["end"]).alias("upto"), (a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(a["upto"], s["start"]))).alias("n")),
    )["n"]
    hits = hits.select(F.col("row").alias("h_row"), covered.alias("hit"), F.array_sort("items").alias("items"))
    no = F.array().cast("array<string>")
    return found.join(hits, F.col("row") == F.col("h_row"), "left").select(
        F.col("id").alias("doc_id"),
        "key",
        "n_words",
        F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", no)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", no), ","), 256).alias("items_sha256"),
        (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"),
    )
