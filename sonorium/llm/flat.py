"""Vectorised work on whole Arrow string columns.

Every text operator here sees a column as one byte buffer with offsets, so that
a batch costs a few numpy passes and no Python loop over words.  Batches are cut
into slices of bounded bytes first: what a task holds at once does not depend on
the table, only on the longest single text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

#: The characters that end a word: space and the controls 9 to 13.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: ASCII lower-casing of single bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Mixers of the splitmix64 finaliser and the base of the polynomial word hash.
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64 values."""
    x = x + _GOLD
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if len(_powers.get("up", ())) < n:
        n = max(n, SLICE_BYTES + (1 << 16))
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many bytes of text, or one row.

    What Spark sends is bounded by its own batch size in rows; this bounds the
    temporary arrays, which are many times the text.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = batch[column.split(".")[0]]
        for name in column.split(".")[1:]:
            whole = whole.field(name)
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(whole), 0), np.int64))
        at = 0
        while at < len(ends):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to
    trim()


def trim() -> None:
    """Gives free memory back: a worker stays after its task, beside whatever runs next on its node."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a column, or runs of other bytes for which `solid` is true.

    start, end: byte range of each word in data; first: index of each row's first
    word, with the total at the end; row: the row of each word.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, solid: np.ndarray = ~_SPACE):
        self.data, self.off = data, off
        n = len(data)
        solid = solid[data]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        opens = solid.copy()
        if n:
            opens[1:] &= ~solid[:-1] | edge[1:n]
        closes = solid.copy()
        if n:
            closes[:-1] &= ~solid[1:] | edge[1:n]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(off) - 1), self.count)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same in every batch and process."""
        return span_hash(LOWER[self.data] if lower else self.data, self.start, self.end)


def prefix(data: np.ndarray) -> np.ndarray:
    """Sums from which prefix_hash tells the hash of any byte range."""
    up, _ = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return sums


def prefix_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, from the sums of prefix()."""
    _, down = _power(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    return prefix_hash(prefix(data), start, end)


def runs(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in a row, and the index at which each begins."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
    total = np.zeros(len(at), np.uint64)
    for k in range(n):
        total = total * np.uint64(_BASE) + hashes[at + k]
    return mix(total), at


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Byte ranges of data as a binary column."""
    size = end - start
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    index = np.arange(off[-1]) + np.repeat(start - off[:-1], size)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data[index].tobytes())])


class Lookup:
    """Values by 64-bit hash in two sorted arrays: compact, picklable, vectorised."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], tuple(v[order] for v in values)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it is absent."""
        if not len(self.keys):
            return np.full(len(hashes), -1, np.int64)
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == hashes, at, -1)


def group_sum(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their counts summed."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[head], (np.add.reduceat(counts, head) if len(head) else counts)


class Tally:
    """Counts by 64-bit key over a task's batches, merged now and then.

    full() says that it holds so many distinct keys that it should be sent on:
    what a task holds stays bounded, and one key leaves a task a few times only.
    """

    def __init__(self, most: int = 1 << 21):
        self.most, self.parts, self.held, self.merged = most, [], 0, 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        k, c = group_sum(keys, counts)
        self.parts.append((k, c.astype(np.int64)))
        self.held += len(k)
        if self.held > 2 * self.merged + (1 << 20):
            self._merge()

    def _merge(self) -> None:
        if len(self.parts) > 1:
            self.parts = [group_sum(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
        self.held = self.merged = sum(len(k) for k, _ in self.parts)

    def full(self) -> bool:
        return self.held > self.most

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        out = self.parts[0] if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.parts, self.held, self.merged = [], 0, 0
        return out


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as the int64 of the same bits, which is what Spark's long holds."""
    return x.view(np.int64)
