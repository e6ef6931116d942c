"""Windows that occur in more than one document, found without moving all windows.

Every window of `width` symbols is named by the smallest hash of its k-grams (its anchor), so equal windows have equal
anchors, and a run of windows with one anchor is a segment. What moves between machines is small:

1. Documents are packed into chunks, written once to the shared folder. Nothing downstream reads the source again.
2. Each chunk sends the sorted list of its anchors, cut into shards; a shard answers which of them other documents have
   as well. A few bytes go for each anchor, combined within the chunk first.
3. Only segments of shared anchors go to the shard of their anchor, equal ones once per chunk. There an engine (suffix
   array or FM-index) finds which of their symbols lie in a window that an earlier document has, too.
4. An anchor that very many documents have (part of a common passage) would fill one shard with its segments. Its
   windows are named by their whole content instead: they take step 2 once more, and those that are shared go, equal
   ones once per chunk, to a shard of their own each.
5. The answers go back to the chunks, where every occurrence is marked.

The number of shards is the session's number of shuffle partitions, so that a shard holds a bounded share of the text.
Ids order the documents; null ids come after all others and, like equal ids, before nobody.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.core import checkpointed

from .arrays import BLOCK_BYTES, TILE, SpanHasher, Words, blocks, byte_hasher, covered, mix, ranges, take_spans, text_bytes
from .tables import shard_count

#: Documents with an anchor from which on its windows are told apart one by one.
HOT_DOCUMENTS = 1000
KEY_BITS = 40
NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Unit:
    """What a text is a sequence of ("byte" or "word"), the width of a window, of the k-grams that name it, and the
    longest segment."""

    kind: str
    width: int = 50
    gram: int = 26
    longest: int = 96


class Symbols:
    """A batch of texts as symbols: 64-bit values, the cuts between documents, and their bytes."""

    def __init__(self, unit: Unit, data: np.ndarray, offsets: np.ndarray):
        self.unit, self.data = unit, data
        if unit.kind == "byte":
            self.hasher, self.cuts, self.size = byte_hasher(data), offsets, len(data)
        else:
            self.words = Words(data, offsets)
            self.values = self.words.hashes()
            self.hasher, self.cuts, self.size = SpanHasher(self.values), self.words.cuts, len(self.words)

    def byte_spans(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.unit.kind == "byte":
            return starts, ends
        return self.words.starts[starts], self.words.ends[ends - 1]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every `width` consecutive values."""
    reach, out = 1, values
    while 2 * reach <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    if reach < width:
        out = np.minimum(out[: len(out) - (width - reach)], out[width - reach :])
    return out


def window_names(symbols: Symbols) -> np.ndarray:
    """The smallest hash of the k-grams of each window, by its start."""
    unit, size = symbols.unit, symbols.size
    grams = unit.width - unit.gram + 1
    out = np.empty(max(0, size - unit.width + 1), np.uint64)
    for a in range(0, len(out), TILE):
        b = min(len(out), a + TILE)
        out[a:b] = sliding_min(symbols.hasher.windows(unit.gram, a, b + grams - 1), grams)
    return out


class Segments:
    """The segments of a batch: first window, number of windows, document, key of the anchor."""

    def __init__(self, symbols: Symbols):
        unit, cuts = symbols.unit, symbols.cuts
        windows = np.maximum(np.diff(cuts) - unit.width + 1, 0)
        if not windows.any():
            self.first = self.count = self.owner = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        names = window_names(symbols)
        fresh = np.ones(len(names), bool)
        fresh[1:] = names[1:] != names[:-1]
        fresh[cuts[:-1][windows > 0]] = True
        at = np.flatnonzero(fresh)
        owner = np.searchsorted(cuts, at, side="right") - 1
        end = (cuts[:-1] + windows)[owner]
        inside = at < end
        at, owner, end = at[inside], owner[inside], end[inside]
        count = np.minimum(np.append(at[1:], len(names)), end) - at
        most = unit.longest - unit.width + 1
        if count.max() > most:  # periodic text: cut long runs
            pieces = -(-count // most)
            inner = ranges(np.zeros(len(at), np.int64), pieces)
            whole = np.repeat(np.arange(len(at)), pieces)
            names, at, owner = names[at][whole], at[whole] + inner * most, owner[whole]
            count = np.minimum(count[whole] - inner * most, most)
        else:
            names = names[at]
        self.first, self.count, self.owner = at, count, owner
        self.key = mix(names) >> np.uint64(64 - KEY_BITS)


def squeeze(array: np.ndarray) -> bytes:
    """An array's bytes, plane by plane, compressed."""
    raw = np.ascontiguousarray(array)
    planes = raw.view(np.uint8).reshape(-1, raw.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def expand(packed: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def squeeze_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.zeros(1, keys.dtype)))


def expand_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(expand(packed, np.uint64), dtype=np.uint64)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards follow the order of the keys."""
    return (keys * np.uint64(shards) >> np.uint64(KEY_BITS)).astype(np.int64)


def pack_chunks(docs: DataFrame, text: str) -> DataFrame:
    """(chunk, blob): the rows as compressed Arrow batches of bounded size, written to the shared folder."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for number, block in enumerate(blocks(_joined(batches, text), text)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, block.schema, options=options) as out:
                out.write_batch(block)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([base + number], pa.int64()), "blob": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return checkpointed(docs.mapInArrow(pack, "chunk long, blob binary"))


def _joined(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Small batches put together, so that chunks are filled."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= 2 * BLOCK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def unpack(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def id_values(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def first_of_run(values: np.ndarray) -> np.ndarray:
    """Flags of the values that differ from the one before."""
    out = np.ones(len(values), bool)
    out[1:] = values[1:] != values[:-1]
    return out


def key_lists(chunk: int, keys: np.ndarray, owner: np.ndarray, shards: int, kind: int) -> Iterator[tuple]:
    """(shard, chunk, kind, blob) rows with the distinct keys and, up to 255, in how many documents each is. Owners
    ascend; the few of a chunk that have a key are numbered, so that key and number are one value."""
    number = np.zeros(len(owner), np.uint64)
    number[1:] = np.cumsum(owner[1:] != owner[:-1])
    pairs = np.sort(keys << np.uint64(64 - KEY_BITS) | number)
    sorted_keys = pairs[first_of_run(pairs)] >> np.uint64(64 - KEY_BITS)
    at = np.flatnonzero(first_of_run(sorted_keys))
    distinct, docs = sorted_keys[at], np.diff(np.append(at, len(sorted_keys)))
    cut = np.searchsorted(shard_of(distinct, shards), np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cut)):
        part = slice(cut[s], cut[s + 1])
        yield int(s), chunk, kind, join_parts([squeeze_sorted(distinct[part]), squeeze(np.minimum(docs[part], 255).astype(np.uint8))])


def join_parts(parts: list[bytes]) -> bytes:
    return np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def split_parts(blob: bytes) -> list[bytes]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes = np.frombuffer(blob, np.int64, n, 8)
    ends = 8 * (n + 1) + np.cumsum(sizes)
    return [blob[e - s : e] for s, e in zip(sizes, ends)]


def shared_levels(blobs: list[bytes], hot: int) -> list[bytes]:
    """For the key lists of one shard: 0 for a key of one document, 1 for a shared one, 2 for a hot one."""
    lists = [split_parts(b) for b in blobs]
    keys = [expand_sorted(x[0]) for x in lists]
    docs = np.concatenate([expand(x[1], np.uint8) for x in lists]).astype(np.int64)
    _, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(where, docs)
    level = ((total > 1).astype(np.uint8) + (total > hot))[where]
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    return [squeeze(part.astype(np.uint8)) for part in np.split(level, cuts)]


class Shipment:
    """The distinct segments of one chunk that go to the shards, in the order of (shard, content), and for every
    occurrence the place of its segment in that order."""

    def __init__(self, symbols: Symbols, first: np.ndarray, count: np.ndarray, owner: np.ndarray, key: np.ndarray, ids: np.ndarray, shards: int):
        self.first, self.end = first, first + count - 1 + symbols.unit.width
        content = symbols.hasher.spans(self.first, self.end)
        shard = shard_of(key, shards)
        document = ids[owner] if len(owner) else np.zeros(0, np.int64)
        order = np.lexsort((document, content, shard))
        new = np.ones(len(order), bool)
        new[1:] = (content[order][1:] != content[order][:-1]) | (shard[order][1:] != shard[order][:-1])
        self.pick = order[new]  # the occurrence in the smallest document stands for all
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.document = document
        self.cut = np.searchsorted(shard[self.pick], np.arange(shards + 1))
        self.symbols = symbols

    def rows(self, chunk: int, kind: int) -> Iterator[tuple]:
        for s in np.flatnonzero(np.diff(self.cut)):
            pick = self.pick[self.cut[s] : self.cut[s + 1]]
            a, b = self.symbols.byte_spans(self.first[pick], self.end[pick])
            payload = take_spans(self.symbols.data, a, b - a)
            yield int(s), chunk, kind, join_parts(
                [squeeze(self.document[pick]), squeeze((b - a).astype(np.int32)), squeeze(payload)]
            )

    def marked(self, replies: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the symbols to mark, over all occurrences."""
        if not len(self.pick):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        parts = [split_parts(blob) for _, blob in sorted(replies)]
        first_owner = np.concatenate([expand(p[0], np.int64) for p in parts])[self.place]
        later = self.document > first_owner
        length = (self.end - self.first)[self.pick]
        flags = np.concatenate([np.unpackbits(np.frombuffer(p[1], np.uint8))[: int(n)] for p, n in zip(parts, self._symbols_by_shard(length))])
        begin = np.cumsum(length) - length
        # the earliest document of a segment: only what still earlier documents have
        own = np.flatnonzero(~later & (sums(flags, begin, length)[self.place] > 0))
        at = ranges(begin[self.place[own]], length[self.place[own]])
        on = flags[at] > 0
        where = ranges(self.first[own], length[self.place[own]])[on]
        return np.concatenate([self.first[later], where]), np.concatenate([self.end[later], where + 1])

    def _symbols_by_shard(self, length: np.ndarray) -> list[int]:
        return [int(length[a:b].sum()) for a, b in zip(self.cut, self.cut[1:]) if b > a]


def sums(flags: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[begin + length] - total[begin]


#: (values, cuts, documents, width) -> flags of the symbols in a window that a segment of a smaller document has.
Engine = Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


def answer_segments(blobs: list[bytes], unit: Unit, engine: Engine) -> list[bytes]:
    """For the segments that chunks sent to one shard: the smallest document with each, and its marked symbols."""
    lists = [split_parts(b) for b in blobs]
    documents = [expand(x[0], np.int64) for x in lists]
    document = np.concatenate(documents)
    values, lengths, contents = [], [], []
    for x in lists:  # one chunk's list at a time: its hashes take a multiple of its text
        size = expand(x[1], np.int32).astype(np.int64)
        symbols = Symbols(unit, expand(x[2], np.uint8), np.concatenate([[0], np.cumsum(size)]))
        values.append(symbols.data if unit.kind == "byte" else symbols.values)
        lengths.append(np.diff(symbols.cuts))
        contents.append(symbols.hasher.spans(symbols.cuts[:-1], symbols.cuts[1:]))
    length, content = np.concatenate(lengths), np.concatenate(contents)
    begin, values = np.cumsum(length) - length, np.concatenate(values)
    order = np.lexsort((document, content))
    new = np.ones(len(order), bool)
    new[1:] = content[order][1:] != content[order][:-1]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    pick = order[new]
    values = take_spans(values, begin[pick], length[pick])
    cuts = np.concatenate([[0], np.cumsum(length[pick])])
    flags = engine(values, cuts, document[pick], unit.width)
    out = []
    for own in np.split(place, np.cumsum([len(d) for d in documents])[:-1]):
        bits = flags[ranges(cuts[own], length[pick][own])]
        out.append(join_parts([squeeze(document[pick][own]), np.packbits(bits).tobytes()]))
    return out


_ROWS = "shard int, chunk long, kind int, blob binary"
#: Kinds of rows: key lists of anchors, of single windows; segments, single windows.
ANCHORS, WINDOWS, SEGMENTS, SINGLES = range(4)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=["shard", "chunk", "kind", "blob"]
    )


class ChunkView:
    """A chunk's segments and, with the answers so far, what it sends next."""

    def __init__(self, unit: Unit, blob: bytes, key: str, text: str, shards: int):
        self.batch = unpack(blob)
        self.symbols = Symbols(unit, *text_bytes(self.batch[text]))
        self.segments = Segments(self.symbols)
        self.ids = id_values(self.batch[key])
        self.shards = shards

    def levels(self, answers: list[dict]) -> np.ndarray:
        """The level of each segment's anchor."""
        got = [(a["shard"], a["blob"]) for a in answers if a["kind"] == ANCHORS]
        if not got:
            return np.zeros(len(self.segments.key), np.uint8)
        level = np.concatenate([expand(b, np.uint8) for _, b in sorted(got)])
        return level[np.unique(self.segments.key, return_inverse=True)[1]]

    def common(self, level: np.ndarray) -> Shipment:
        s, on = self.segments, level == 1
        return Shipment(self.symbols, s.first[on], s.count[on], s.owner[on], s.key[on], self.ids, self.shards)

    def single_windows(self, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, document, key) of every window of a hot anchor."""
        s, on = self.segments, level == 2
        start = ranges(s.first[on], s.count[on])
        owner = np.repeat(s.owner[on], s.count[on])
        key = mix(self.symbols.hasher.spans(start, start + self.symbols.unit.width)) >> np.uint64(64 - KEY_BITS)
        return start, owner, key

    def singles(self, level: np.ndarray, answers: list[dict]) -> Shipment:
        start, owner, key = self.single_windows(level)
        got = [(a["shard"], a["blob"]) for a in answers if a["kind"] == WINDOWS]
        if got:
            shared = np.concatenate([expand(b, np.uint8) for _, b in sorted(got)])[np.unique(key, return_inverse=True)[1]] > 0
            start, owner, key = start[shared], owner[shared], key[shared]
        else:
            start, owner, key = start[:0], owner[:0], key[:0]
        return Shipment(self.symbols, start, np.ones(len(start), np.int64), owner, key, self.ids, self.shards)


def mark_repeats(
    docs: DataFrame,
    unit: Unit,
    engine: Engine,
    finish: Callable[[pa.RecordBatch, Symbols, np.ndarray], pa.RecordBatch],
    schema,
    key: str = "doc_id",
    text: str = "text",
    hot: int = HOT_DOCUMENTS,
) -> DataFrame:
    """Every row of docs through `finish`, with flags of the symbols covered by a window of an earlier document."""
    shards = shard_count(docs.sparkSession)
    chunks = pack_chunks(docs, text)

    def listed(batches):
        for batch in batches:
            for chunk, blob in zip(batch["chunk"].to_pylist(), batch["blob"]):
                view = ChunkView(unit, blob.as_buffer(), key, text, shards)
                yield _table(list(key_lists(chunk, view.segments.key, view.segments.owner, shards, ANCHORS)))

    def answered(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rows = sorted(zip(table["kind"].to_pylist(), table["chunk"].to_pylist(), table["shard"].to_pylist(), table["blob"].to_pylist()))
        out = []
        for kind in sorted({r[0] for r in rows}):
            own = [r for r in rows if r[0] == kind]
            blobs = [r[3] for r in own]
            made = shared_levels(blobs, hot) if kind in (ANCHORS, WINDOWS) else answer_segments(blobs, unit, engine)
            out += [(r[2], r[1], kind, b) for r, b in zip(own, made)]
        return pa.Table.from_batches([_table(out)])

    def shipped(batches):
        for batch in batches:
            for chunk, blob, answers in zip(batch["chunk"].to_pylist(), batch["blob"], batch["answers"].to_pylist()):
                view = ChunkView(unit, blob.as_buffer(), key, text, shards)
                level = view.levels(answers or [])
                for row in view.common(level).rows(chunk, SEGMENTS):
                    yield _table([row])
                _, owner, keys = view.single_windows(level)
                yield _table(list(key_lists(chunk, keys, owner, shards, WINDOWS)))

    def shipped_singles(batches):
        for batch in batches:
            for chunk, blob, answers in zip(batch["chunk"].to_pylist(), batch["blob"], batch["answers"].to_pylist()):
                view = ChunkView(unit, blob.as_buffer(), key, text, shards)
                for row in view.singles(view.levels(answers), answers).rows(chunk, SINGLES):
                    yield _table([row])

    def finished(batches):
        for batch in batches:
            for blob, answers in zip(batch["blob"], batch["answers"].to_pylist()):
                view = ChunkView(unit, blob.as_buffer(), key, text, shards)
                answers = answers or []
                level = view.levels(answers)
                spans = [
                    ship.marked([(a["shard"], a["blob"]) for a in answers if a["kind"] == kind])
                    for ship, kind in ((view.common(level), SEGMENTS), (view.singles(level, answers), SINGLES))
                ]
                flags = covered(np.concatenate([s[0] for s in spans]), np.concatenate([s[1] for s in spans]), view.symbols.size)
                yield finish(view.batch, view.symbols, flags)

    def by_shard(rows: DataFrame) -> DataFrame:
        return checkpointed(rows.groupBy("shard").applyInArrow(answered, _ROWS))

    def with_answers(*answers: DataFrame, how: str = "left") -> DataFrame:
        every = answers[0]
        for more in answers[1:]:
            every = every.unionByName(more)
        per_chunk = every.groupBy("chunk").agg(F.collect_list(F.struct("shard", "kind", "blob")).alias("answers"))
        return chunks.join(per_chunk, "chunk", how).select("chunk", "blob", "answers")

    levels = by_shard(chunks.mapInArrow(listed, _ROWS))
    first = by_shard(with_answers(levels).mapInArrow(shipped, _ROWS))
    # only chunks with hot anchors take part again
    hot_chunks = first.filter(F.col("kind") == WINDOWS)
    its_levels = levels.join(hot_chunks.select("chunk").distinct(), "chunk", "left_semi").select("shard", "chunk", "kind", "blob")
    second = by_shard(with_answers(its_levels, hot_chunks, how="inner").mapInArrow(shipped_singles, _ROWS))
    return with_answers(levels, first, second).mapInArrow(finished, schema)
