"""Exact deduplication by Grace hash partitions and open-addressing tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.scratch import written

#: Content bytes that one open-addressing table may hold, in a task before and after the shuffle.
TABLE_BYTES = 64 << 20
#: Bits of the first level of the partitioning, at least, and those by which each further level splits a bucket.
LEVEL_BITS = 10
_SPACE = b" \t\n\x0b\x0c\r"


class ContentTable:
    """An open-addressing table from complete contents to the numbers 0, 1, ...; linear probing, at most half full."""

    def __init__(self, slots: int = 1 << 10):
        self.slots = np.full(slots, -1, np.int64)
        self.contents: list[bytes] = []
        self.hashes: list[int] = []
        self.bytes = 0

    def number(self, content: bytes, hashed: int) -> int:
        """The number of this content, new if no equal content is held. Hashes only choose where to look."""
        if 2 * len(self.contents) >= len(self.slots):
            self._grow()
        at = self._find(content, hashed)
        if self.slots[at] < 0:
            self.slots[at] = len(self.contents)
            self.contents.append(content)
            self.hashes.append(hashed)
            self.bytes += len(content) + 100
        return int(self.slots[at])

    def _find(self, content: bytes | None, hashed: int) -> int:
        mask = len(self.slots) - 1
        at = hashed & mask
        while (held := self.slots[at]) >= 0:
            if content is not None and self.hashes[held] == hashed and self.contents[held] == content:
                return at
            at = (at + 1) & mask
        return at

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        for n, hashed in enumerate(self.hashes):
            self.slots[self._find(None, hashed)] = n


def normalised(text: str | None) -> bytes:
    """UTF-8 without the six characters of [\\x20\\x09-\\x0D]; null counts as empty."""
    return (text or "").encode().translate(None, _SPACE)


def digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, size in code points, digest of the normalised text)."""
    for batch in batches:
        text = batch.column("text").fill_null("")
        digests = [hashlib.sha256(normalised(x.as_py())).digest() for x in text]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pc.utf8_length(text).cast(pa.int64()), pa.array(digests, pa.binary())], ["id", "size", "digest"])


def _order(size: int, key: int | None) -> tuple:
    """The greatest stays: more code points, then the smaller id; a null id comes last."""
    return (size, key is not None, -(key or 0))


#: What a content's row carries: rows with it, and of the one that stays its size, id, how many share these, and their order.
_HELD = ("n", "size", "id", "ties", "tie")


def local_contents(most: int, text_at: int) -> Callable:
    """Before the shuffle: one row for each content of a task, so that a hot content leaves a task at most a few times.

    When the table is full its rows go out and a new one begins, so memory is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, best, schema = ContentTable(), [], None
        for batch in batches:
            ids, rows = batch.column("id"), batch.column("row")
            text = rows.field(text_at).fill_null("")
            hashes, ties = batch.column("hash").to_numpy().view(np.uint64), batch.column("tie").to_pylist()
            schema = pa.schema([*((c, pa.int64()) for c in ("hash", *_HELD)), batch.schema.field("row")])
            for i, size in enumerate(pc.utf8_length(text).to_pylist()):
                n, key = table.number(normalised(text[i].as_py()), int(hashes[i])), ids[i].as_py()
                if n == len(best):
                    best.append([1, size, key, 1, ties[i], rows[i].as_py()])
                    table.bytes += 4 * size
                else:
                    _merge(best[n], 1, size, key, 1, ties[i], rows[i])
            if table.bytes > most:
                yield from _out(table, best, schema)
                table, best = ContentTable(), []
        if best:
            yield from _out(table, best, schema)

    return run


def _merge(held: list, n: int, size: int, key: int | None, ties: int, tie: int, row: pa.Scalar) -> None:
    held[0] += n
    old, new = _order(held[1], held[2]), _order(size, key)
    if new > old:
        held[1:] = [size, key, ties, tie, row.as_py()]
    elif new == old:
        held[3] += ties
        if tie < held[4]:
            held[4:] = [tie, row.as_py()]


def _out(table: ContentTable, best: list[list], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(best), 1000):
        part = best[at : at + 1000]
        hashes = np.array(table.hashes[at : at + 1000], np.uint64).view(np.int64)
        rows = pa.array([x[-1] for x in part], schema.field("row").type)
        yield pa.RecordBatch.from_arrays([pa.array(hashes), *(pa.array([x[k] for x in part], pa.int64()) for k in range(len(_HELD))), rows], schema=schema)


def bucket_contents(text_at: int) -> Callable:
    """After the shuffle, over rows sorted by bucket: one table for each bucket, complete contents compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, best, bucket, schema = ContentTable(), [], None, None
        for batch in batches:
            schema = pa.schema([("digest", pa.binary()), *((c, pa.int64()) for c in _HELD), batch.schema.field("row")])
            rows, hashes = batch.column("row"), batch.column("hash").to_numpy().view(np.uint64)
            depths, buckets, n, size, ids, ties, tie = (batch.column(c).to_pylist() for c in ("depth", "bucket", *_HELD))
            for i, content in enumerate(rows.field(text_at)):
                if (depths[i], buckets[i]) != bucket:
                    if best:
                        yield from _groups(table, best, schema)
                    table, best, bucket = ContentTable(), [], (depths[i], buckets[i])
                at = table.number(normalised(content.as_py()), int(hashes[i]))
                if at == len(best):
                    best.append([n[i], size[i], ids[i], ties[i], tie[i], rows[i].as_py()])
                else:
                    _merge(best[at], n[i], size[i], ids[i], ties[i], tie[i], rows[i])
        if best:
            yield from _groups(table, best, schema)

    return run


def _groups(table: ContentTable, best: list[list], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(best), 1000):
        part = best[at : at + 1000]
        digests = pa.array([hashlib.sha256(x).digest() for x in table.contents[at : at + 1000]], pa.binary())
        yield pa.RecordBatch.from_arrays([digests, *(pa.array([x[k] for x in part], pa.int64()) for k in range(len(_HELD))), pa.array([x[-1] for x in part], schema.field("row").type)], schema=schema)


def content_hash(text: Column) -> Column:
    """A 64-bit hash of the normalised text."""
    return F.xxhash64(F.translate(F.coalesce(text, F.lit("")), _SPACE.decode(), ""))


def deeper_buckets(sizes: DataFrame, first: int, table_bytes: int) -> list[tuple[int, DataFrame]]:
    """(depth, buckets) level by level: the buckets of `depth` bits that hold more than a table and more than one hash.

    sizes has (hash, bytes). A bucket that holds a single hash can't be split and needs no room, since its contents are
    copies. The list ends with the first level where every bucket fits.
    """
    found, inside = [], sizes
    for depth in range(first, 64, LEVEL_BITS):
        of = inside.withColumn("bucket", F.shiftrightunsigned("hash", 64 - depth))
        full = of.groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.min("hash").alias("low"), F.max("hash").alias("high")).where((F.col("bytes") > table_bytes) & (F.col("low") < F.col("high")))
        full = written(full.select("bucket"))
        if full.isEmpty():
            break
        found.append((depth, full))
        inside = of.join(full, "bucket", "left_semi").drop("bucket")
    return found


def content_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES, rows: bool = True) -> DataFrame:
    """One row for each distinct normalised text: digest, n, size and id of the row that stays, ties, and that row.

    1. A narrow pass over hashes and sizes plans the buckets: by so many bits of the hash that they hold a sixteenth
       of `table_bytes` on average; a bucket of more than `table_bytes` is split by the next bits, level by level,
       until every bucket fits.
    2. Each task drops the copies among its own rows, comparing complete contents.
    3. Spark writes the rest to its shuffle files by bucket, once, and one open-addressing table resolves each bucket.

    rows=False leaves out the other columns, for callers that need the groups alone. Null text is empty. `ties` counts
    the rows that share size and id with the one that stays; of those the one with the least hash of text and row stays.
    Ids are whole numbers.
    """
    fields = list(df.schema) if rows else [df.schema[text_col]]
    columns = [F.col(f"`{f.name}`") for f in fields]
    names = [f"c{i}" for i in range(len(fields))]
    text, hashable = F.col(text_col), [c for c, f in zip(columns, fields, strict=True) if "map<" not in f.dataType.simpleString()]
    packed = df.select(F.col(id_col).cast("long").alias("id"), content_hash(text).alias("hash"), F.xxhash64(text, *hashable).alias("tie"), F.struct(*[c.alias(n) for c, n in zip(columns, names, strict=True)]).alias("row"))
    kind = packed.schema["row"].dataType.simpleString()
    text_at = [f.name for f in fields].index(text_col)
    sizes = written(df.select(content_hash(text).alias("hash"), (F.coalesce(F.octet_length(text), F.lit(0)) + 100).cast("long").alias("bytes")).groupBy("hash").agg(F.max("bytes").alias("bytes")))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    first = min(60, max(LEVEL_BITS, (16 * total // table_bytes).bit_length()))
    longs = ", ".join(f"{c} long" for c in _HELD)
    local = packed.mapInArrow(local_contents(table_bytes, text_at), f"hash long, {longs}, row {kind}")
    local = local.withColumn("bucket", F.shiftrightunsigned("hash", 64 - first)).withColumn("depth", F.lit(first))
    for depth, full in deeper_buckets(sizes, first, table_bytes):
        deeper = min(64, depth + LEVEL_BITS)
        split = (F.col("depth") == depth) & F.col("full_bucket").isNotNull()
        local = local.join(full.withColumnRenamed("bucket", "full_bucket"), (F.col("bucket") == F.col("full_bucket")) & (F.col("depth") == depth), "left")
        local = local.withColumn("bucket", F.when(split, F.shiftrightunsigned("hash", 64 - deeper)).otherwise(F.col("bucket"))).withColumn("depth", F.when(split, F.lit(deeper)).otherwise(F.col("depth"))).drop("full_bucket")
    sent = local.repartition("depth", "bucket").sortWithinPartitions("depth", "bucket")
    groups = sent.mapInArrow(bucket_contents(text_at), f"digest binary, {longs}, row {kind}")
    back = [F.col(f"row.{n}").alias(f.name) for n, f in zip(names, fields, strict=True)] if rows else []
    kept = ["digest", "n", "size", "id", "ties"]
    return groups.select(*kept, F.struct(*back).alias("row")) if rows else groups.select(*kept)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row that stays of each group of equal texts, with all its columns.

    Equal: identical without white space [\\x20\\x09-\\x0D]. The row with the most code points in the original text
    stays, then the one with the smallest id (null last), then the one with the least hash of its row; of rows repeated
    whole, one. Null texts count as empty; texts are compared whole; other columns may have any name. An empty df stays empty.
    """
    return content_groups(df, id_col, text_col).select("row.*")


def dedup_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows repeated with id and text, one is kept. The groups come from `content_groups`; rows meet them by digest,
    in a join that Spark can split where one content is hot.
    """
    groups = written(content_groups(df, id_col, text_col, rows=False))
    keyed = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(digest_rows, "id long, size long, digest binary")
    repeated = groups.where("ties > 1").limit(1).count() > 0
    if repeated:  # number the rows that share id, size and content, so that one of them stays
        spread = keyed.groupBy("id", "size", "digest").count()
        keyed = spread.select("id", "size", "digest", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("copy"))
    else:
        keyed = keyed.withColumn("copy", F.lit(1))
    groups = groups.select(F.col("digest").alias("g_digest"), F.col("id").alias("keep_id"), F.col("n").alias("group_size"), F.col("size").alias("keep_size"))
    return keyed.join(groups, F.col("digest") == F.col("g_digest")).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("size") == F.col("keep_size")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
