"""Document fingerprints: context-triggered piecewise hashing.

A rolling hash of the last eight bytes cuts a text wherever its first `level` bits are zero, so cuts follow the content
and an edit moves only the cuts beside it; the block size is 2 ** level bytes on average. A chunk's signature is 12 bits
of the sum of its rolling hashes, written as two letters. A fingerprint is `level:finest:next:coarsest`: the signatures
at the finest level with at most 64 chunks and at the two above it, whose cuts are among the finer ones. Two
fingerprints are compared at the finest level they share, by one minus the edit distance of the signatures over the
longer one's length; without a shared level they are unlike (0).

All bytes of all texts are hashed in numpy, long texts strip by strip. Edit distances of many pairs advance together.
Neighbours in the order of ids meet by one range shuffle of the texts; a document whose successor lies in the next range
is settled afterwards, by a join of at most one text for each range.

Defined cases: a null or empty text has the fingerprint `0:::` and is like empty ones only (1); equal texts have equal
fingerprints, so repeated rows do; null ids come last, rows of one id follow by a hash of the text; an empty table gives
no rows; other columns are kept by `add_fingerprints` (one named like the new column is replaced) and not read otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.operators.core import checkpointed

from .arrays import blocks, mix, take_spans, text_bytes
from .tables import shard_count

WINDOW = 8
#: Chunks of the finest level at most, levels of a fingerprint.
MOST, LEVELS = 64, 3
SYMBOL_BITS = 12
#: Bytes hashed at once.
STRIP = 4 << 20
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_PLACE = np.full(256, 0, np.int16)
_PLACE[LETTERS] = np.arange(64)
_BYTES = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_STEP = 0x9E3779B1


def rolling_hashes(data: np.ndarray, starts: np.ndarray, low: int, high: int) -> np.ndarray:
    """The hash of the last WINDOW bytes of its document, for each byte in [low, high)."""
    base = max(0, low - WINDOW + 1)
    h = _BYTES[data[base:high]]
    step, reach = _STEP, 1
    while reach < WINDOW:
        h[reach:] += h[:-reach] * np.uint32(step)  # the right side is made before anything is added
        step, reach = step * step % (1 << 32), 2 * reach
    h = h[low - base :]
    # the first bytes of a document have nothing before them
    near = starts[(starts > low - WINDOW) & (starts < high)]
    value = np.zeros(len(near), np.uint32)
    ends = np.append(starts[1:], len(data))[(starts > low - WINDOW) & (starts < high)]
    for j in range(WINDOW - 1):
        at = near + j
        on = (at < ends) & (at < high)
        near, ends, value, at = near[on], ends[on], value[on], at[on]
        value = value * np.uint32(_STEP) + _BYTES[data[at]]
        inside = at >= low
        h[at[inside] - low] = value[inside]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return h


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The fingerprint of each document."""
    size = np.diff(offsets)
    n = len(size)
    if n == 0:
        return []
    full = np.flatnonzero(size)
    starts = offsets[:-1][full]
    # the level from which on cuts are sought: four to eight times as many as may stay
    floor = np.maximum(np.ceil(np.log2(np.maximum(size, 1) / MOST)).astype(np.int64) - 2, 0)
    cut, cut_sum, cut_level, end_sum = [], [], [], np.zeros(n, np.uint64)
    before = np.uint64(0)
    for low in range(0, len(data), STRIP):
        high = min(low + STRIP, len(data))
        h = rolling_hashes(data, starts, low, high)
        first = np.searchsorted(offsets, low, side="right") - 1
        last = np.searchsorted(offsets, high, side="left")
        here = np.clip(offsets[first : last + 1], low, high)
        limit = np.repeat(((1 << (32 - floor[first:last])) - 1).astype(np.uint32), np.diff(here))
        at = np.flatnonzero(h <= limit)
        sums = np.cumsum(h, dtype=np.uint64)
        sums += before
        cut.append(at + low + 1)
        cut_sum.append(sums[at])
        cut_level.append(32 - np.frexp(h[at].astype(np.float64))[1])
        done = np.arange(first, last)[(offsets[first + 1 : last + 1] <= high)]
        inside = offsets[done + 1] - low
        end_sum[done] = np.where(inside > 0, sums[np.maximum(inside, 1) - 1], before)
        before = sums[-1]
    end_sum = np.maximum.accumulate(end_sum) if n > 1 else end_sum  # empty documents end where the one before does
    cut, cut_sum, cut_level = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (cut, cut_sum, cut_level))
    owner = np.searchsorted(offsets, cut, side="left") - 1
    inner = cut < offsets[owner + 1] if len(cut) else np.zeros(0, bool)  # the end of a document is a cut at every level
    cut, cut_sum, cut_level, owner = cut[inner], cut_sum[inner].astype(np.uint64), cut_level[inner], owner[inner]
    level = floor.copy()
    while True:
        many = np.bincount(owner[cut_level >= level[owner]], minlength=n) > MOST - 1
        if not many.any():
            break
        level[many] += 1
    begin_sum = np.concatenate([np.zeros(1, np.uint64), end_sum[:-1]])
    signatures = []
    for j in range(LEVELS):
        on = cut_level >= level[owner] + j
        ends = np.concatenate([cut[on], offsets[1:][full]])
        sums = np.concatenate([cut_sum[on], end_sum[full]])
        own = np.concatenate([owner[on], full])
        order = np.argsort(ends, kind="stable")
        own, sums = own[order], sums[order]
        fresh = np.ones(len(own), bool)
        fresh[1:] = own[1:] != own[:-1]
        prior = np.empty_like(sums)
        prior[1:] = sums[:-1]
        prior[fresh] = begin_sum[own[fresh]]
        symbol = (mix(sums - prior) >> np.uint64(64 - SYMBOL_BITS)).astype(np.int64)
        letters = LETTERS[np.stack([symbol >> 6, symbol & 63], axis=1)].tobytes().decode("ascii")
        stops = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))]) * 2
        signatures.append([letters[a:b] for a, b in zip(stops.tolist(), stops[1:].tolist())])
    return [f"{k}:{a}:{b}:{c}" for k, a, b, c in zip(level.tolist(), *signatures)]


def edit_distances(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Edit distance of each pair of padded rows, all pairs in step."""
    width = int(nb.max(initial=0))
    steps = np.arange(width + 1, dtype=np.int16)
    row = np.repeat(steps[None], len(a), axis=0)
    out = nb.astype(np.int16)
    every = np.arange(len(a))
    for i in range(int(na.max(initial=0))):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        np.minimum(row[:, :-1] + (a[:, i, None] != b[:, :width]), row[:, 1:] + 1, out=new[:, 1:])
        new -= steps  # an insertion costs one more for each place to the right
        np.minimum.accumulate(new, axis=1, out=new)
        new += steps
        row = new
        now = na == i + 1
        out[now] = row[every[now], nb[now]]
    return out


def likeness_of(left: list[str], right: list[str], step: int = 4096) -> np.ndarray:
    """The likeness, 0 to 1, of each pair of fingerprints."""
    out = np.array([x == y for x, y in zip(left, right)], np.float64)
    pairs = []
    for k in np.flatnonzero(out == 0):
        x, y = left[k].split(":"), right[k].split(":")
        level = max(int(x[0]), int(y[0]))
        i, j = level - int(x[0]) + 1, level - int(y[0]) + 1
        if i <= LEVELS and j <= LEVELS and x[i] and y[j]:
            pairs.append((k, x[i], y[j]))
    for at in range(0, len(pairs), step):
        part = pairs[at : at + step]
        (a, na), (b, nb) = (_symbols([p[c] for p in part], pad) for c, pad in ((1, -1), (2, -2)))
        out[[p[0] for p in part]] = 1 - edit_distances(a, na, b, nb) / np.maximum(na, nb)
    return out


def _symbols(signatures: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(s) // 2 for s in signatures])
    letters = _PLACE[np.frombuffer("".join(signatures).encode(), np.uint8)].reshape(-1, 2)
    out = np.full((len(size), int(size.max())), pad, np.int16)
    out[np.arange(out.shape[1]) < size[:, None]] = letters[:, 0] * 64 + letters[:, 1]
    return out, size


def add_fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """The rows with the fingerprint of their text."""
    kept = docs.drop(name) if name in docs.columns else docs
    place = kept.columns.index(text)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            found = pa.array(fingerprints(*text_bytes(block.column(place))), pa.string())
            yield pa.RecordBatch.from_arrays([*block.columns, found], names=[*block.schema.names, name])

    return kept.mapInArrow(made, T.StructType([*kept.schema.fields, T.StructField(name, T.StringType())]))


def likeness(a: Column | str, b: Column | str) -> Column:
    """The likeness of two fingerprint columns; null where one is null."""

    @F.pandas_udf("double")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=x.index)
        on = x.notna() & y.notna()
        out[on] = likeness_of(x[on].tolist(), y[on].tolist())
        return out.astype(object).where(on, None)

    return alike(a, b)


_COLUMNS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_ARROW = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
_SCHEMA = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_rows(data: np.ndarray, offsets: np.ndarray, own: np.ndarray, after: np.ndarray, prints: list[str]) -> list[pa.Array]:
    """The digest columns of the documents `own`, each edited with the beginning of the document `after`."""
    points = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(points, offsets)
    points = np.append(points, len(data))
    chars = np.diff(first)
    half = chars[own] // 2
    stop = np.where(half > 0, points[np.minimum(first[own] + chars[own] - half, len(points) - 1)], offsets[own + 1])
    taken = np.minimum(half, chars[after])
    end = np.where(taken < chars[after], points[np.minimum(first[after] + taken, len(points) - 1)], offsets[after + 1])
    starts = np.stack([offsets[own], offsets[after]], axis=1).ravel()
    lengths = np.stack([stop - offsets[own], end - offsets[after]], axis=1).ravel()
    edited = take_spans(data, starts, lengths)
    cuts = np.concatenate([[0], np.cumsum(lengths.reshape(-1, 2).sum(axis=1))])
    view = memoryview(edited)
    digests = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
    changed = fingerprints(edited, cuts)
    mine = [prints[k] for k in own]
    found = chars[own], digests, mine, changed, likeness_of(mine, changed), likeness_of(mine, [prints[k] for k in after])
    return [pa.array(x, t) for x, t in zip(found, _ARROW)]


DONE, HEAD, OPEN = range(3)


def edited_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): each text against itself
    with its second half replaced by the beginning of the next document's, and against the next document."""
    kind = docs.schema[key].dataType
    shards = shard_count(docs.sparkSession)
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("salt", F.monotonically_increasing_id())
    order = [F.col("id").asc_nulls_last(), F.col("h"), F.col("salt")]
    rows = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("id", "text")

    def emit(ids: pa.Array, columns: list[pa.Array], state: int, texts: pa.Array) -> pa.RecordBatch:
        n = len(ids)
        part = pa.array([TaskContext.get().partitionId()] * n, pa.int32())
        return pa.RecordBatch.from_arrays([part, pa.array([state] * n, pa.int32()), ids, *columns, texts], names=["part", "state", "id", *_COLUMNS, "text"])

    def loose(ids: pa.Array, state: int, texts: pa.Array) -> pa.RecordBatch:
        return emit(ids, [pa.nulls(len(ids), t) for t in _ARROW], state, texts)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last document so far, whose successor is yet to come
        known: list[str] = []
        for block in blocks(batches, "text"):
            if held is None:
                yield loose(block["id"].slice(0, 1), HEAD, block["text"].slice(0, 1))
            else:
                block = pa.Table.from_batches([held, block]).combine_chunks().to_batches()[0]
            data, offsets = text_bytes(block["text"])
            skip = len(known)
            prints = known + fingerprints(data[offsets[skip] :], offsets[skip:] - offsets[skip])
            n = block.num_rows - 1
            if n:
                columns = edited_rows(data, offsets, np.arange(n), np.arange(1, n + 1), prints)
                yield emit(block["id"].slice(0, n), columns, DONE, pa.nulls(n, pa.string()))
            held, known = block.slice(n, 1), prints[-1:]
        if held is not None:
            yield loose(held["id"], OPEN, held["text"])

    found = checkpointed(rows.mapInArrow(scan, f"part int, state int, id {kind.simpleString()}, {_SCHEMA}, text string"))
    heads = found.filter(F.col("state") == HEAD).select(F.col("part").alias("next"), F.col("text").alias("next_text"))
    parts = sorted(r.next for r in heads.select("next").collect())  # a number for each range that has rows
    follow = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    pairs = found.filter(F.col("state") == OPEN).select("part", "id", "text").join(follow, "part").join(heads, "next").select("id", "text", "next_text")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a pair at a time: both texts may be long
                both = pa.concat_arrays([batch[c].slice(k, 1) for c in ("text", "next_text")])
                data, offsets = text_bytes(both)
                columns = edited_rows(data, offsets, np.array([0]), np.array([1]), fingerprints(data, offsets))
                yield pa.RecordBatch.from_arrays([batch["id"].slice(k, 1), *columns], names=["id", *_COLUMNS])

    closed = pairs.mapInArrow(close, f"id {kind.simpleString()}, {_SCHEMA}")
    done = found.filter(F.col("state") == DONE).select("id", *_COLUMNS)
    return done.unionByName(closed).withColumnRenamed("id", key)
