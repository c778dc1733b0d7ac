"""Scores of slot distributions by tiles: sums over slots at the same place and at any, and matrices applied to vectors.

A tile is a block of items against a block of items. What leaves a tile is either its rows or what a caller makes of
them there; no task holds more than a tile, and a tile's size changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators.linear import BLOCK, STREAM, TILE, beside, blocks, dealt, met, numbers
from starloom.operators.similarity import FLOOR
from starloom.sources.shared import stored

#: Scores of a tile, a matrix for each mode, from the distributions of its rows and of its columns (items x slots x codes).
Scorer = Callable[[np.ndarray, np.ndarray], list[np.ndarray]]


def logs(products: Iterable[np.ndarray]) -> np.ndarray:
    """The sum of the logs of some floored overlaps: one log of their product, which is a normal number for up to 8 of them."""
    total: np.ndarray | float = 0.0
    held, count = None, 0
    for p in products:
        p = np.maximum(p, FLOOR)
        held, count = (p, 1) if held is None else (np.multiply(held, p, out=held), count + 1)
        if count == 8:
            total, held, count = total + np.log(held), None, 0
    return total if held is None else total + np.log(held)


def same_place(modes: dict[str, tuple[int, int]]) -> Scorer:
    """The sum over a mode's slots of the log overlap with the same slot."""

    def score(left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
        return [logs(left[:, s] @ right[:, s].T for s in range(first, first + width)) for first, width in modes.values()]

    return score


def three_ways(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one mode's slots: sums of log overlaps at the same place, at the best column slot of each row slot, and at the
    best row slot of each column slot."""
    n, slots, _ = left.shape
    each = np.stack([np.stack([left[:, a] @ right[:, b].T for b in range(slots)]) for a in range(slots)])  # row slot, column slot, n, m
    return logs(each[s, s] for s in range(slots)), logs(each.max(1)), logs(each.max(0))


def opened(rows: pa.StructArray, slots: int, *more: str) -> tuple[np.ndarray, ...]:
    """items, distributions (items x slots x codes) and further lists of a tile's rows, by rising item."""
    items = rows.field("item").to_numpy(zero_copy_only=False)
    order = np.argsort(items, kind="stable")
    flat = rows.field("dist").flatten().to_numpy(zero_copy_only=False).reshape(len(items), slots, -1)
    return items[order], flat[order], *(rows.field(c).flatten().to_numpy(zero_copy_only=False).reshape(len(items), -1)[order] for c in more)


def tiles(rows: DataFrame, block: int, *columns: str) -> tuple[DataFrame, int]:
    """(block, rows) of rows (item, columns...) and the number of blocks: at most about `block` rows in each, by a hash of the item."""
    n = max(1, -(-rows.count() // block))
    return rows.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n)).cast("int")).groupBy("block").agg(F.collect_list(F.struct("item", *columns)).alias("rows")), n


def symmetric(rows: DataFrame, modes: dict[str, tuple[int, int]], made: Callable[..., Iterator[pa.RecordBatch]], schema: str, block: int = 1024) -> DataFrame:
    """All pairs of rows (item, dist) in pairs of tiles, each once; `made` gets each half of a tile, so every ordered pair once.

    made(mode, left items, right items, same, forward, backward): scores of the left items' slots (see three_ways) with the
    right items. Of a tile off the diagonal the other half is the transposed one, where best row slots are best column slots.
    """
    slots = sum(width for _, width in modes.values())
    held, n = tiles(rows, block, "dist")
    held = stored(held)
    # tile i meets tiles i to i + n / 2, round the circle: each two meet once, and all tiles meet as many
    last = F.when((F.lit(n) % 2 == 0) & (F.col("block") >= n // 2), n // 2 - 1).otherwise(n // 2)
    ahead = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), last)))
    sent = held.select(F.col("block").alias("i"), F.col("rows").alias("a"), ahead.alias("k")).withColumn("j", (F.col("i") + F.col("k")) % n)
    # merged, as a small table of tiles would be sent whole to the driver
    pairs = sent.hint("merge").join(held.select(F.col("block").alias("j"), F.col("rows").alias("b")), "j").select("i", "a", "j", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (ours, left), (theirs, right) = (opened(batch.column(c)[k].values, slots) for c in (1, 3))
                for mode, (first, width) in modes.items():
                    same, forward, backward = three_ways(left[:, first : first + width], right[:, first : first + width])
                    yield from made(mode, ours, theirs, same, forward, backward)
                    if batch.column(0)[k] != batch.column(2)[k]:
                        yield from made(mode, theirs, ours, same.T, backward.T, forward.T)

    return pairs.mapInArrow(run, schema)


def gram(rows: DataFrame, modes: dict[str, tuple[int, int]], block: int = 1024) -> DataFrame:
    """(item, mode, others, same, forward, backward): the matrices, each row in pieces of a tile's width."""
    schema = "item long, mode string, others array<long>, same array<double>, forward array<double>, backward array<double>"

    def made(mode: str, ours: np.ndarray, theirs: np.ndarray, *three: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = pa.array(np.arange(len(ours) + 1) * len(theirs), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.tile(theirs, len(ours)))), *(pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(m).ravel())) for m in three)]
        yield pa.RecordBatch.from_arrays([pa.array(ours), pa.array([mode] * len(ours)), *lists], [x.split()[0] for x in schema.split(", ")])

    return symmetric(rows, modes, made, schema, block)


#: Rows and columns of the piece of a tile whose overlaps are held at a time, and rows of a block at most.
PIECE, HELD = (64, 256), 65536


class Sums:
    """Sums of logs over rows or columns of pieces of a tile: factors are multiplied up, with one log for as many as stay normal numbers."""

    def __init__(self, shape: tuple[int, int], most: int) -> None:
        self.total, self.held, self.count, self.most = np.zeros(shape), np.ones(shape), 0, most

    def add(self, factors: np.ndarray) -> None:
        np.multiply(self.held, factors, out=self.held)
        self.count += 1
        if self.count == self.most:
            self.close()

    def close(self) -> np.ndarray:
        if self.count:
            self.total += np.log(self.held)
            self.held.fill(1.0)
            self.count = 0
        return self.total


def tile_sums(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one mode's slots (items x slots x codes): the sums of three_ways() over each left item's row of the tile (3 x left), and over each
    right item's column with the parts of left and right exchanged (3 x right)."""
    width = left.shape[1]
    # an overlap is at least the one's least share times the other's sum
    least = max(float(left.min()) * float(right.sum(2).min()), FLOOR) if left.size and right.size else FLOOR
    floored = least <= FLOOR
    most = max(1, int(300 / max(1e-9, -np.log10(least))) // width)
    a, b = np.ascontiguousarray(left.transpose(1, 0, 2)), np.ascontiguousarray(right.transpose(1, 2, 0))
    rows, columns = np.zeros((3, len(left))), np.zeros((3, len(right)))
    high, wide = PIECE
    for i in range(0, len(left), high):
        n = min(high, len(left) - i)
        across = [Sums((n, wide), most) for _ in range(3)]
        for j in range(0, len(right), wide):
            m = min(wide, len(right) - j)
            each = np.matmul(a[:, None, i : i + n], b[None, :, :, j : j + m])  # row slot, column slot, n, m
            if floored:
                np.maximum(each, FLOOR, out=each)
            for kind in range(3):
                found = each[0, 0] if kind == 0 else (each[0] if kind == 1 else each[:, 0]).max(0)
                for s in range(1, width):
                    found = found * (each[s, s] if kind == 0 else (each[s] if kind == 1 else each[:, s]).max(0))
                if m == wide:
                    across[kind].add(found)
                else:
                    rows[kind, i : i + n] += np.log(found).sum(1)
                # of the transposed half, best row slots are best column slots
                columns[(0, 2, 1)[kind], j : j + m] += sum(np.log(np.multiply.reduce(found[k : k + most])) for k in range(0, n, most))
        for kind in range(3):
            rows[kind, i : i + n] += across[kind].close().sum(1)
    return rows, columns


def gram_means(rows: DataFrame, modes: dict[str, tuple[int, int]], block: int = HELD) -> DataFrame:
    """(item, mode, same, forward, backward): the mean of each row of the matrices, summed up within the tiles.

    Blocks are held, packs of a block's rows stream to half of the blocks, round the circle: each two items meet in one tile. A task keeps the
    sums of its block; a pack leaves its own once for each block that it meets. No tiles are joined.
    """
    slots = sum(width for _, width in modes.values())
    n = blocks(rows, block)
    cut = rows.select(F.pmod(F.xxhash64("item"), F.lit(n)).cast("int").alias("block"), F.col("item").cast("long").alias("item"), "dist")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for first, last in zip(edges, edges[1:]):
                for i in range(first, last, STREAM):
                    part, out = batch.slice(i, min(STREAM, last - i)), pa.BufferOutputStream()
                    with pa.ipc.new_stream(out, batch.schema) as writer:
                        writer.write_batch(part)
                    yield pa.RecordBatch.from_arrays([pa.array([int(number[i])], pa.int32()), part.column(1).slice(0, 1), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["own", "first", "data"])

    packs = dealt(cut, n).sortWithinPartitions("block", "item").mapInArrow(packed, "own int, first long, data binary")
    last = F.when((F.lit(n) % 2 == 0) & (F.col("own") >= n // 2), n // 2 - 1).otherwise(n // 2)
    sent = packs.withColumn("ahead", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), last))))
    one = F.struct("item", "dist")
    none = F.lit(None).cast(cut.select(one.alias("x")).schema["x"].dataType)
    sent = sent.select(((F.col("own") + F.col("ahead")) % n).alias("block"), F.lit(0).alias("time"), "first", "data", none.alias("b"))
    held = cut.select("block", F.lit(-1).alias("time"), F.col("item").alias("first"), F.lit(None).cast("binary").alias("data"), one.alias("b"))

    def leave(items: np.ndarray, sums: np.ndarray, count: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(items), pa.array([count] * len(items), pa.int64()), pa.array(list(np.ascontiguousarray(sums.reshape(-1, len(items)).T)))], ["item", "n", "sums"])

    def made(ours: pa.StructArray, theirs: pa.StructArray, state: tuple | None) -> Iterator[pa.RecordBatch]:
        mine, left = opened(ours, slots)
        other, right, sums, count = (*opened(theirs, slots), 0.0, 0) if state is None else state
        found = [tile_sums(left[:, first : first + width], right[:, first : first + width]) for first, width in modes.values()]
        yield leave(mine, np.stack([x for x, _ in found]), len(other))
        if not np.isin(mine[0], other):  # else the block is the pack's own, whose pairs come in both orders
            sums, count = sums + np.stack([x for _, x in found]), count + len(mine)
        return other, right, sums, count

    def ended(state: tuple, theirs: pa.StructArray) -> Iterator[pa.RecordBatch]:
        if state is not None and state[3]:
            yield leave(state[0], state[2], state[3])

    parts = beside(held.unionAll(sent), n, made, "item long, n long, sums array<double>", ended).groupBy("item").agg(F.sum("n").alias("n"), F.collect_list("sums").alias("sums"))
    # sorted: the same sum in any order of tiles
    mean = lambda m, k: F.aggregate(F.sort_array(F.transform("sums", lambda v: v[m * 3 + k])), F.lit(0.0), lambda a, y: a + y) / F.col("n")
    each = F.array(*[F.struct(F.lit(mode).alias("mode"), *[mean(m, k).alias(name) for k, name in enumerate(("same", "forward", "backward"))]) for m, mode in enumerate(modes)])
    return parts.select("item", F.explode(each).alias("x")).select("item", "x.*")


def applied(left: DataFrame, right: DataFrame, score: Scorer, slots: int, width: int, block: int = BLOCK, turned: bool = False, least: int | None = None) -> DataFrame:
    """(item, y): for each row of left (item, dist), the sum over right (item, dist, x) of its scores times x, mode by mode.

    x and y hold `width` numbers for each mode. With turned=True the rows of right are the scores' rows. Where left has
    the blocks, a block's sums leave it once; where it is sent to right's, they are added up by item. The blocks have `block` rows at most and
    are `least` if there are rows enough (see linear.blocks); the other side is sent to each.
    """
    def sums(ours: pa.StructArray, theirs: pa.StructArray) -> np.ndarray:
        mine, other, x = numbers(ours, "dist").reshape(len(ours), slots, -1), numbers(theirs, "dist").reshape(len(theirs), slots, -1), numbers(theirs, "x")
        out = np.zeros((len(mine), x.shape[1]))
        for i in range(0, len(mine), TILE):
            for j in range(0, len(other), TILE):
                matrices = [m.T for m in score(other[j : j + TILE], mine[i : i + TILE])] if turned else score(mine[i : i + TILE], other[j : j + TILE])
                for k, m in enumerate(matrices):
                    here = slice(k * width, (k + 1) * width)
                    out[i : i + TILE, here] += m @ x[j : j + TILE, here]
        return out

    def rows(ours: pa.StructArray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32())
        yield pa.RecordBatch.from_arrays([ours.field("item"), pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], ["item", "y"])

    ours, theirs, schema = left.select("item", "dist"), right.select("item", "dist", "x"), "item long, y array<double>"
    if theirs.count() <= ours.count():  # the side of fewer rows is sent to the other's blocks, here those of left, which are done with a block
        return met(theirs, ours, lambda sent, held, y: sums(held, sent) + (0.0 if y is None else y), schema, ended=lambda y, held: rows(held, y), count=blocks(ours, block, least))
    parts = met(ours, theirs, lambda sent, held: rows(sent, sums(sent, held)), schema, count=blocks(theirs, block, least))
    total = lambda v: F.aggregate(F.sort_array(v), F.lit(0.0), lambda a, y: a + y)  # noqa: E731  (sorted: the same sum in any order of tiles)
    wide = len(score(np.ones((1, slots, 1)), np.ones((1, slots, 1)))) * width
    return parts.groupBy("item").agg(F.collect_list("y").alias("_y")).select("item", F.transform(F.sequence(F.lit(0), F.lit(wide - 1)), lambda k: total(F.transform("_y", lambda v: v[k]))).alias("y"))


def moments(rows: DataFrame, column: str, modes: int, width: int) -> tuple[int, np.ndarray, list[np.ndarray]]:
    """Count, means (modes * width) and for each mode the sums of products of its own numbers less their means.

    A task sends a mode's sums as one row of width * (width + 1) numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros((modes, width)), np.zeros((modes, width, width))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, modes, width)
            n, total, products = n + len(x), total + x.sum(0), products + np.einsum("nmi,nmj->mij", x, x, optimize=True)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(modes), pa.int32()), pa.array([n] * modes), pa.array(list(np.concatenate([total[:, None], products], axis=1).reshape(modes, -1)))], ["mode", "n", "sums"])

    def summed(table: pa.Table) -> pa.Table:
        sums = np.sort(np.stack([v.values.to_numpy() for v in table.column("sums")]), axis=0).sum(0)
        return pa.table({"mode": table.column("mode").slice(0, 1), "n": pa.array([sum(table.column("n").to_pylist())]), "sums": pa.array([sums])})

    kind = "mode int, n long, sums array<double>"
    found = sorted(rows.select(column).mapInArrow(run, kind).groupBy("mode").applyInArrow(summed, kind).collect())
    if not found:
        return 0, np.zeros(modes * width), [np.zeros((width, width))] * modes
    n, sums = found[0]["n"], np.array([r["sums"] for r in found]).reshape(modes, width + 1, width)
    mean = sums[:, 0] / n
    return n, mean.ravel(), [sums[m, 1:] - n * np.outer(mean[m], mean[m]) for m in range(modes)]
