"""Words of whole Arrow batches of text, found and hashed on the UTF-8 bytes with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is a slice of its own.
SLICE = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes of the two word rules: not white space; ASCII letters and digits (after lower-casing) and all beyond ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = True
ALNUM[128:] = True

_random = np.random.default_rng(20240229)
_NEAR = _random.integers(1, 1 << 63, 1024, dtype=np.uint64) | np.uint64(1)
_FAR = _random.integers(1, 1 << 63, 1024, dtype=np.uint64) | np.uint64(1)
_GRAM = _random.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of rows first, first + 1, ...: word i is data[starts[i]:ends[i]]; those of row r are bounds[r]:bounds[r + 1]."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        sizes = self.ends - self.starts
        heads = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(heads, sizes)
        held = self.data[place + np.repeat(self.starts, sizes)].astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            held *= _NEAR[place & 1023]
            if int(sizes.max()) > 1024:
                far = place >> 10
                held = np.where(far > 0, held * _FAR[far & 1023], held)
            return mixed(np.add.reduceat(held, heads) + sizes.astype(np.uint64))


def slices(column: pa.Array, table: np.ndarray, lower: bool, most: int = SLICE) -> Iterator[Words]:
    """The words of a string column, at most about `most` bytes at a time; null has none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    raw = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, len(column))
        yield words(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], table, lower, first)
        first = last
    pa.default_memory_pool().release_unused()  # a worker outlives its tasks


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool, first: int = 0) -> Words:
    """Words never reach over the end of a row."""
    if lower:
        data = LOWER[data]
    inside = table[data]
    starts, ends = inside.copy(), inside.copy()
    if len(data):
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        heads, tails = offsets[:-1], offsets[1:]
        some = heads < tails
        starts[heads[some]] = inside[heads[some]]
        ends[tails[some] - 1] = inside[tails[some] - 1]
    at = np.flatnonzero(starts)
    return Words(first, data, at, np.flatnonzero(ends) + 1, np.searchsorted(at, offsets), offsets)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, by its first word; it has n - 1 entries fewer than hashes."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    last = len(hashes) - n + 1
    with np.errstate(over="ignore"):
        total = np.full(last, np.uint64(n))
        for i in range(n):
            total += hashes[i : i + last] * _GRAM[i]
    return mixed(total)


def rolling_min(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours."""
    out = values[: max(0, len(values) - n + 1)].copy()
    for i in range(1, n):
        np.minimum(out, values[i : i + len(out)], out=out)
    return out
