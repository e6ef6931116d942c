"""Substring dedup with a compressed FM-index per shard: backward search over a wavelet structure.

A shard's segments are indexed once: suffix order, Burrows-Wheeler transform, and the transform's symbols as one packed
bit vector for each bit of the alphabet, with counts for ranks. Segments are then streamed against the index. Backward
search from a right end gives the matching statistic there: how far to the left the text still occurs in a smaller
document (the smallest document of a suffix range comes from a table of range minima). Matches at least as long as the
threshold are reported; what a failed search proves about the windows around it isn't searched again.

`repeats.mark_repeats` brings the texts that can share a window together; this module is what runs over them.

Defined cases: a null or empty text has no words and an empty rest; a null id counts as the largest; repeated rows
don't remove each other's words; an empty table gives no rows; the result replaces input columns of the same name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrays import covered, sums_by_cut
from .repeats import Symbols, Unit, mark_repeats

WORDS = Unit("word", width=50, gram=8, longest=127)
#: Suffixes are ordered by so many symbols: more than any searched pattern has.
DEPTH = 128


def suffix_order(text: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Suffixes by their first `depth` symbols, by doubling; only suffixes still tied are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    active = np.arange(n)
    key = text[order].astype(np.int64)
    group = np.zeros(n, np.int64)
    reach = 0
    while True:
        new = np.ones(len(active), bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        rank[order[active]] = active[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]
        active = active[~new | np.append(~new[1:], False)]
        reach = max(1, 2 * reach)
        if not len(active) or reach >= depth:
            return order
        after = order[active] + reach
        key = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        group = rank[order[active]]
        sub = np.lexsort((key, group))
        order[active], key, group = order[active][sub], key[sub], group[sub]


class PackedBits:
    """A bit vector with ranks: 64 bits to a word, and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Occurrences of patterns in a text of integers 0 .. symbols - 1."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.text, self.order = text, suffix_order(text)
        last = text[self.order - 1]  # the transform; before the first symbol stands the last
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.levels: list[tuple[int, PackedBits, int]] = []
        values = last
        for bit in reversed(range(max(1, int(symbols - 1).bit_length()))):
            on = (values >> bit) & 1
            self.levels.append((bit, PackedBits(on.astype(np.uint8)), int(len(on) - on.sum())))
            values = np.concatenate([values[on == 0], values[on == 1]])
        self.base = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            ones = bits.ones(place)
            place = np.where((symbol >> bit) & 1, zeros + ones, place - ones)
        return place

    def extend_left(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges of `symbol` + pattern from those of the patterns."""
        both = self._down(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        shift = self.starts[symbol] - self.base[symbol]
        return both[: len(symbol)] + shift, both[len(symbol) :] + shift


class RangeMinima:
    """Smallest value of any range, from a table of the minima of all power-of-two ranges."""

    def __init__(self, values: np.ndarray):
        sizes = [len(values) - (1 << k) + 1 for k in range(max(1, len(values)).bit_length())]
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        self.flat = np.empty(int(self.begin[-1]), np.int32)
        self.flat[: len(values)] = values
        for k in range(1, len(sizes)):
            below, half = self.flat[self.begin[k - 1] : self.begin[k]], 1 << (k - 1)
            np.minimum(below[:-half], below[half:], out=self.flat[self.begin[k] : self.begin[k + 1]])

    def smallest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        at = self.begin[k]
        return np.minimum(self.flat[at + low], self.flat[at + high - (1 << k)])


class ShardIndex:
    """The FM-index of a shard's segments, and the smallest document of any suffix range."""

    def __init__(self, values: np.ndarray, cuts: np.ndarray, documents: np.ndarray):
        alphabet, ids = np.unique(values, return_inverse=True)
        pieces = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        self.begin = cuts[:-1] + np.arange(len(cuts) - 1)  # one separator after each piece
        text = np.zeros(len(values) + len(cuts) - 1, np.int32)
        text[np.arange(len(values)) + pieces] = ids + 1
        piece_of = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts) + 1)
        self.ranks = np.unique(documents, return_inverse=True)[1]
        self.fm = FMIndex(text, len(alphabet) + 1)
        self.minima = RangeMinima(self.ranks[piece_of[self.fm.order]])

    def first_failure(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Backward search of text[low:high) among documents of a smaller rank: the position at which it fails, low - 1
        if it doesn't. high - result - 1 is the matching statistic at high."""
        out = low - 1
        todo = np.arange(len(low))
        at = high.copy()
        a, b = np.zeros(len(low), np.int64), np.full(len(low), len(self.fm.text), np.int64)
        while len(todo):
            at = at - 1
            a, b = self.fm.extend_left(self.fm.text[at], a, b)
            good = b > a
            good[good] = self.minima.smallest(a[good], b[good]) < rank[todo][good]
            out[todo[~good]] = at[~good]
            go = good & (at > low[todo])
            todo, at, a, b = todo[go], at[go], a[go], b[go]
        return out


def matched_windows(index: ShardIndex, cuts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) window starts, in text positions, of runs of windows that occur in a smaller document.

    Each open range of windows is decided by one search at a time; `hint` says which right end to try: of the first
    window (0), the last (1), or the middle one (2). A success settles all windows it covers; a failure at j settles
    the windows that hold what failed, and those to the right of j that the match covers.
    """
    count = np.diff(cuts) - width + 1
    piece = np.flatnonzero(count > 0)
    a = index.begin[piece]
    b = a + count[piece] - 1
    hint = np.zeros(len(piece), np.int64)
    firsts, lasts = [], []
    while len(piece):
        m = np.where(hint == 0, a, np.where(hint == 1, b, (a + b) // 2))
        j = index.first_failure(a, m + width, index.ranks[piece])
        done = j < a
        above = j >= m  # only when it failed
        firsts += [a[done], j[~done & ~above] + 1]
        lasts += [m[done], m[~done & ~above]]
        right = np.where(done | ~above, m + 1, np.minimum(j, b) + 1)
        right_hint = np.where(done & (hint != 1), 1, 0)
        left_end = np.where(above, m - 1, j)
        has_left, has_right = ~done & (left_end >= a), right <= b
        piece, a, b, hint = (
            np.concatenate([piece[has_left], piece[has_right]]),
            np.concatenate([a[has_left], right[has_right]]),
            np.concatenate([left_end[has_left], b[has_right]]),
            np.concatenate([np.full(has_left.sum(), 2), right_hint[has_right]]),
        )
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(firsts or empty), np.concatenate(lasts or empty)


def earlier_words(values: np.ndarray, cuts: np.ndarray, documents: np.ndarray, width: int) -> np.ndarray:
    """Flags of the symbols in a window that also occurs in a smaller document."""
    if not len(values):
        return np.zeros(0, bool)
    index = ShardIndex(values, cuts, documents)
    first, last = matched_windows(index, cuts, width)
    flags = covered(first, last + width, len(index.fm.text))
    return flags[index.fm.text > 0]


def _kept_words(symbols: Symbols, flags: np.ndarray) -> list[bytes]:
    """The words that stay, joined by single spaces."""
    words = symbols.words
    pairs = zip(words.cuts[:-1].tolist(), words.cuts[1:].tolist())
    return [_join(symbols.data, words, a + np.flatnonzero(~flags[a:b])) for a, b in pairs]


def _join(data: np.ndarray, words, stay: np.ndarray) -> bytes:
    if not len(stay):
        return b""
    raw, base = data[words.starts[stay[0]] : words.ends[stay[-1]]].tobytes(), int(words.starts[stay[0]])
    return b" ".join([raw[s:e] for s, e in zip((words.starts[stay] - base).tolist(), (words.ends[stay] - base).tolist())])


def word_repeat_digest(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""

    def finish(batch, symbols, flags):
        rest = _kept_words(symbols, flags)
        return pa.RecordBatch.from_pydict(
            {
                key: batch[key],
                "n_words": pa.array(np.diff(symbols.cuts), pa.int64()),
                "n_removed": pa.array(sums_by_cut(flags, symbols.cuts), pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(r).hexdigest() for r in rest], pa.string()),
            }
        )

    narrow = docs.select(key, text)
    schema = T.StructType([narrow.schema[key]]).add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    return mark_repeats(narrow, WORDS, earlier_words, finish, schema, key, text, **({} if hot is None else {"hot": hot}))


def cut_repeated_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with repeated words cut out; what stays is joined by single spaces. A null text stays null."""

    def finish(batch, symbols, flags):
        texts = [r.decode() if ok else None for r, ok in zip(_kept_words(symbols, flags), batch[text].is_valid().to_pylist())]
        columns = {f.name: batch[f.name] for f in batch.schema} | {text: pa.array(texts, batch.schema.field(text).type)}
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return mark_repeats(docs, WORDS, earlier_words, finish, docs.schema, key, text)


WORD_REPEAT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
s AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS s FROM places),
o AS (SELECT s, min(doc_id) AS first FROM s GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM s JOIN o USING (s) WHERE first < doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id),
kept AS (SELECT b.doc_id, string_agg(b.word, ' ' ORDER BY b.pos) AS t
         FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d) b ANTI JOIN hit USING (doc_id, pos) GROUP BY b.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(removed.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
