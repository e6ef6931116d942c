"""Text columns as numpy arrays: bytes, words, line and window hashes, blocks of bounded size.

Every helper works on many documents at once: `data` is their concatenated UTF-8, `offsets` (n + 1) cuts it into
documents, and a null text is an empty one. Hashes are 64-bit and depend on content alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step holds; a longer document is a block of its own.
BLOCK_BYTES = 2 << 20
#: Items that a chain of array steps takes at once, so that what it works on stays in a core's cache.
TILE = 1 << 15

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))


@lru_cache(maxsize=4)
def _powers(size: int, base: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _power_table(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; tables grow by doubling so that few are kept."""
    return _powers(1 << max(12, int(n).bit_length()), base)


class SpanHasher:
    """Hash of any span of a sequence of 64-bit values in constant time, by prefix sums of a polynomial. With a
    `table` the sequence has places in it instead of values."""

    def __init__(self, values: np.ndarray, table: np.ndarray | None = None):
        n = len(values)
        self._sums = np.zeros(n + 1, np.uint64)
        powers = _power_table(n + 1, _MULTIPLIER)
        for a in range(0, n, TILE):
            b = min(n, a + TILE)
            part = values[a:b] if table is None else table.take(values[a:b])
            np.cumsum(part * powers[a:b], out=self._sums[a + 1 : b + 1])
            self._sums[a + 1 : b + 1] += self._sums[a]

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        part = self._sums[ends] - self._sums[starts]
        part *= _power_table(len(self._sums), _INVERSE)[starts]
        return mix(part + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, width: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """The hash of every span of `width` values, by its start, from the `first` start to before the `last`."""
        n = len(self._sums) - width
        n = n if last is None else min(n, last)
        if n <= first:
            return np.zeros(0, np.uint64)
        part = self._sums[first + width : n + width] - self._sums[first:n]
        part *= _power_table(len(self._sums), _INVERSE)[first:n]
        return mix(part + np.uint64(width * 0xD6E8FEB86659FD93 % (1 << 64)))


def byte_hasher(data: np.ndarray) -> SpanHasher:
    return SpanHasher(data, _BYTE_VALUES)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    _, starts, data = column.buffers()
    if len(column) == 0 or starts is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces whose texts have `limit` bytes at most, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


class Words:
    """The words of many documents: byte starts and ends, and the cuts between documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE):
        self.data, self.offsets = data, offsets
        self.inside = ~separators[data]
        first, last = self.inside.copy(), self.inside.copy()
        if len(data):
            first[1:] &= ~self.inside[:-1]
            last[:-1] &= ~self.inside[1:]
            cuts = offsets[(offsets > 0) & (offsets < len(data))]
            first[cuts] = self.inside[cuts]
            last[cuts - 1] = self.inside[cuts - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.cuts = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def per_document(self) -> np.ndarray:
        return np.diff(self.cuts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return byte_hasher(LOWER[self.data] if lower else self.data).spans(self.starts, self.ends)

    def documents(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.per_document)


def spans_inside(cuts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the spans of `width` items that lie in one piece, and the piece of each; `cuts` bounds the pieces."""
    count = np.maximum(np.diff(cuts) - width + 1, 0)
    owner = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    return np.arange(count.sum()) - first[owner] + cuts[:-1][owner], owner


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of range(start, start + length)."""
    first = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) - np.repeat(first - starts, lengths)


def take_spans(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, step: int = 1 << 21) -> np.ndarray:
    """The concatenation of the spans of `values`, gathered in steps so that positions never fill the memory."""
    out = np.empty(int(lengths.sum()), values.dtype)
    ends = np.cumsum(lengths)
    a = 0
    while a < len(starts):
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + step, side="right")))
        out[done : ends[b - 1]] = values[ranges(starts[a:b], lengths[a:b])]
        a = b
    return out


def sums_by_cut(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sum of the values between each two cuts."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[cuts[1:]] - total[cuts[:-1]]


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Flags of the positions that lie in at least one span."""
    step = np.bincount(starts, minlength=size + 1).astype(np.int64)
    step -= np.bincount(ends, minlength=size + 1)
    return np.cumsum(step[:size]) > 0
