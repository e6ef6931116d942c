"""Phrase collocation mining by Toivonen's method: a sample proposes, full passes count and close.

Phrases are contiguous words inside a piece of text; a frequent phrase has only frequent parts. One pass counts every
word of every language exactly and, on a sample of documents drawn by a hash of the id, phrases short of the longest;
those that reach a lowered threshold are the proposals. A full pass counts all occurrences of every phrase whose two
parts (without its last, without its first word) are proposed or frequent words: that is the proposals with their
negative border. A counted phrase that is frequent but wasn't proposed is a border failure: it joins the proposals, and
a further full pass counts the phrases that this lets in, until no pass brings a failure. At most `longest` - 1 passes
are needed, as each closes one length. The sample decides the number of passes only, never the result.

Tasks test membership in a bitmap of hashed phrases of fixed size (2 ** FILTER_BITS bits, 16 MB), the only thing that is
broadcast: a bit set by chance lets a phrase be counted in vain, and no frequent phrase is missed. Counting runs on
64-bit keys, combined within a block of text, then within a task, before one shuffle. The last pass counts the phrases
with frequent keys once more by their words, so the figures are exact whatever the keys.

Defined cases: a null or empty text has no words; a null language is `und`; a null id is sampled like any other value;
repeated rows count each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators.core import checkpointed

from .arrays import LOWER, SpanHasher, Words, blocks, byte_hasher, mix, take_spans, text_bytes
from .tables import shard_count

#: A phrase counts from so many occurrences on and has so many words at most.
LEAST, LONGEST = 30, 4
#: One document of so many is in the sample.
SHARE = 16
#: Size of the broadcast bitmap: 2 ** 27 bits are 16 MB.
FILTER_BITS = 27
#: Bytes of text worked on at once, counts that are put together before they leave Python, rows of a batch.
BLOCK, ENTRIES, ROWS = 2 << 20, 1 << 19, 1 << 17
TOP = 2000
_SIZE_BITS = 3
_SLICE_BITS = 8

BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
SEPARATORS = BREAKS.copy()
SEPARATORS[[0x20, 0x09]] = True


class Pieces:
    """The lower-cased words of a block of documents, their pieces, and keys of phrases."""

    def __init__(self, block: pa.RecordBatch):
        raw, offsets = text_bytes(block["text"])
        self.data = LOWER[raw]
        self.words = Words(self.data, offsets, SEPARATORS)
        w = self.words
        breaks = np.cumsum(BREAKS[self.data], dtype=np.int32)
        self.owner = w.documents()
        fresh = np.zeros(len(w), np.int64)
        if len(w):
            fresh[1:] = (breaks[w.starts[1:]] != breaks[w.starts[:-1]]) | (self.owner[1:] != self.owner[:-1])
        self.piece = np.cumsum(fresh)
        self.lang = mix(block["lang_key"].to_numpy(zero_copy_only=False).view(np.uint64))
        self.values = byte_hasher(self.data).spans(w.starts, w.ends)
        self.hasher = SpanHasher(self.values)

    def starts(self, size: int) -> np.ndarray:
        """First words of all phrases of `size` words."""
        n = len(self.words) - size + 1
        return np.flatnonzero(self.piece[size - 1 :] == self.piece[:n]) if n > 0 else np.zeros(0, np.int64)

    def keys(self, size: int, where: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(first word, key) of every phrase of `size` words, or of those that start at `where`."""
        if where is None:
            where = self.starts(size)
        key = mix(self.hasher.spans(where, where + size) + self.lang[self.owner[where]])
        return where, (key & ~np.uint64((1 << _SIZE_BITS) - 1)) | np.uint64(size)

    def phrases(self, first: np.ndarray, size: int) -> pa.Array:
        """The phrases that start at these words, joined by single spaces."""
        w = self.words
        lengths = w.ends - w.starts
        each = (first[:, None] + np.arange(size)).ravel()
        out = np.full(int(lengths[each].sum()) + len(each), 0x20, np.uint8)
        ends = np.cumsum(lengths[each] + 1)
        on = np.ones(len(out), bool)
        on[ends - 1] = False
        out[on] = take_spans(self.data, w.starts[each], lengths[each])
        # the space behind the last word of a phrase is no part of it
        last = ends[size - 1 :: size] - 1
        kept = np.ones(len(out), bool)
        kept[last] = False
        stops = np.concatenate([[0], last + 1 - np.arange(1, len(first) + 1)])
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(stops.astype(np.int64)), pa.py_buffer(out[kept])).cast(pa.string())


def bit_set(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each key is set; keys are places among as many bits as the bitmap has, a power of two."""
    place = keys >> np.uint64(64 - (len(bitmap).bit_length() + 2))
    return (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bitmap_of(keys: DataFrame, filter_bits: int) -> np.ndarray | None:
    """The bits of a column `key`, made slice by slice; None if there is no row."""
    width = 1 << (filter_bits - _SLICE_BITS - 3)

    def build(table: pa.Table) -> pa.Table:
        key = table["key"].to_numpy().view(np.uint64)
        place = (key >> np.uint64(64 - filter_bits)) & np.uint64(8 * width - 1)
        bits = np.zeros(8 * width, np.uint8)
        bits[place] = 1
        part = np.packbits(bits, bitorder="little").tobytes()
        return pa.table({"slice": pa.array([table["slice"][0].as_py()], pa.int32()), "bits": pa.array([part], pa.binary())})

    slices = keys.select(F.shiftrightunsigned("key", 64 - _SLICE_BITS).cast("int").alias("slice"), "key")
    rows = slices.groupBy("slice").applyInArrow(build, "slice int, bits binary").collect()  # 2 ** filter_bits bits at most
    if not rows:
        return None
    out = np.zeros(width << _SLICE_BITS, np.uint8)
    for r in rows:
        out[r.slice * width : (r.slice + 1) * width] = np.frombuffer(r.bits, np.uint8)
    return out


def _texts(docs: DataFrame, key: str, text: str, lang: str, share: int) -> DataFrame:
    name = F.coalesce(F.col(lang).cast("string"), F.lit("und"))
    chosen = F.pmod(F.xxhash64(F.lit("sample"), F.col(key).cast("string")), F.lit(share)) == 0
    return docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), name.alias("lang"), F.xxhash64(name).alias("lang_key"), chosen.alias("chosen"))


#: Takes the blocks of a task and yields result columns; it may combine counts over several blocks.
Emitter = Callable[[Iterator[tuple[Pieces, pa.RecordBatch]]], Iterator[list[pa.Array]]]


def _mapped(texts: DataFrame, emit: Emitter, names: list[str], schema: str) -> DataFrame:
    limit = BLOCK

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Pieces, pa.RecordBatch]]:
        for block in blocks(_gathered(batches, limit), "text", limit):
            pieces = Pieces(block)
            if len(pieces.words):
                yield pieces, block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in emit(cut(batches)):
            made = pa.RecordBatch.from_arrays(columns, names=names)
            for at in range(0, made.num_rows, ROWS):
                yield made.slice(at, ROWS)

    return texts.mapInArrow(run, schema)


def _gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Small batches put together, so that counts are combined over whole blocks."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class KeyCounts:
    """Counts by key, put together over the blocks of a task until they are many."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        distinct, n = np.unique(keys, return_counts=True)
        self.keys.append(distinct)
        self.counts.append(n)
        self.size += len(n)

    def taken(self, least: int = 0) -> list[tuple[pa.Array, pa.Array]]:
        """One pair of columns (key, n) if there are `least` entries, none else."""
        if not self.size or self.size < least:
            return []
        distinct, where = np.unique(np.concatenate(self.keys), return_inverse=True)
        n = np.bincount(where, np.concatenate(self.counts)).astype(np.int64)
        self.__init__()
        return [(pa.array(distinct.view(np.int64)), pa.array(n))]


def words_and_sample(texts: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, key, n): words with their counts; without a phrase, sampled phrases; without a key, all words."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]

    def emit(parts):
        sample = KeyCounts()
        for p, block in parts:
            _, key = p.keys(1, np.arange(len(p.words)))
            distinct, first, n = np.unique(key, return_index=True, return_counts=True)
            langs = block["lang"]
            yield [langs.take(pa.array(p.owner[first])), p.phrases(first, 1), pa.array(distinct.view(np.int64)), pa.array(n, kinds[3])]
            per_document = p.words.per_document
            said = np.flatnonzero(per_document)
            yield [langs.take(pa.array(said)), pa.nulls(len(said), kinds[1]), pa.nulls(len(said), kinds[2]), pa.array(per_document[said], kinds[3])]
            chosen = block["chosen"].to_numpy(zero_copy_only=False)
            for size in range(2, longest):
                where = p.starts(size)
                sample.add(p.keys(size, where[chosen[p.owner[where]]])[1])
            for key, n in sample.taken(ENTRIES):
                yield [pa.nulls(len(n), kinds[0]), pa.nulls(len(n), kinds[1]), key, n]
        for key, n in sample.taken():
            yield [pa.nulls(len(n), kinds[0]), pa.nulls(len(n), kinds[1]), key, n]

    rows = _mapped(texts, emit, ["lang", "phrase", "key", "n"], "lang string, phrase string, key long, n long")
    return rows.groupBy("lang", "phrase", "key").agg(F.sum("n").alias("n"))


def _parts_known(p: Pieces, bitmap: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, first words, keys) of the phrases whose parts have their bits set, by growing size."""
    part = bit_set(bitmap, p.keys(1, np.arange(len(p.words)))[1])
    for size in range(2, longest + 1):
        where = p.starts(size)
        where = where[part[where] & part[where + 1]]
        where, key = p.keys(size, where)
        yield size, where, key
        part = np.zeros(len(p.words) + 1, bool)
        part[where] = bit_set(bitmap, key)


def count_keys(texts: DataFrame, known: Broadcast, before: Broadcast | None, longest: int, least: int) -> DataFrame:
    """(key, n) of the frequent phrases among those let in by `known`, but not by `before`, which are counted already."""

    def emit(parts):
        counts = KeyCounts()
        for p, _ in parts:
            counted = {size: where for size, where, _ in _parts_known(p, before.value, longest)} if before is not None else {}
            for size, where, key in _parts_known(p, known.value, longest):
                if size in counted:
                    key = key[~np.isin(where, counted[size], assume_unique=True)]
                counts.add(key)
            yield from map(list, counts.taken(ENTRIES))
        yield from map(list, counts.taken())

    rows = _mapped(texts, emit, ["key", "n"], "key long, n long")
    return rows.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def not_proposed(keys: DataFrame, known: Broadcast, longest: int) -> DataFrame:
    """The border failures: keys of extensible phrases without a bit."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch["key"].to_numpy().view(np.uint64)
            short = key & np.uint64((1 << _SIZE_BITS) - 1) < np.uint64(longest)
            yield batch.filter(pa.array(short & ~bit_set(known.value, key)))

    return keys.select("key").mapInArrow(test, "key long")


def spell(texts: DataFrame, chosen: Broadcast, longest: int, least: int) -> DataFrame:
    """(lang, phrase, size, n): exact counts by words of the phrases with the keys' bits."""

    def emit(parts):
        for p, block in parts:
            for size in range(2, longest + 1):
                where, key = p.keys(size)
                on = bit_set(chosen.value, key)
                where, key = where[on], key[on]
                _, at, n = np.unique(key, return_index=True, return_counts=True)
                first = where[at]
                langs = block["lang"].take(pa.array(p.owner[first]))
                yield [langs, p.phrases(first, size), pa.array(np.full(len(n), size, np.int32)), pa.array(n.astype(np.int64))]

    rows = _mapped(texts, emit, ["lang", "phrase", "size", "n"], "lang string, phrase string, size int, n long")
    return rows.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def mine_phrases(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    longest: int = LONGEST,
    share: int = SHARE,
    filter_bits: int = FILTER_BITS,
    passes: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, n) of all frequent phrases of one word or more, (lang, n) with all words).

    `passes` collects the names of the passes over the texts, for tests and reports."""
    if not 2 <= longest < 1 << _SIZE_BITS or not _SLICE_BITS + 3 <= filter_bits < 40:
        raise ValueError("phrases have 2 to 7 words, bitmaps 11 to 39 bits of address")
    context = docs.sparkSession.sparkContext
    passes = [] if passes is None else passes
    texts = _texts(docs, key, text, lang, share)
    passes.append("words and sample")
    lowered = max(2, least // (2 * share))
    first = words_and_sample(texts, longest)
    first = checkpointed(first.filter(F.col("key").isNull() | (F.col("n") >= F.when(F.col("phrase").isNull(), lowered).otherwise(least))))
    totals = first.filter(F.col("key").isNull()).select("lang", "n")
    words = first.filter(F.col("phrase").isNotNull()).select("lang", "phrase", F.lit(1).alias("size"), "n")
    schema = "lang string, phrase string, size int, n long"
    bits = bitmap_of(first.filter(F.col("key").isNotNull()).select("key"), filter_bits)
    if bits is None:
        return words, totals
    known, before, counted = context.broadcast(bits), None, []
    while True:
        passes.append("count")
        counted.append(checkpointed(count_keys(texts, known, before, longest, least)))
        fresh = bitmap_of(not_proposed(counted[-1], known, longest), filter_bits)
        if fresh is None:
            break
        bits = bits | fresh
        if before is not None:
            before.unpersist()
        before, known = known, context.broadcast(bits)
    frequent = counted[0]
    for more in counted[1:]:
        frequent = frequent.unionByName(more)
    chosen = bitmap_of(frequent.select("key"), filter_bits)
    if chosen is None:
        return words.unionByName(docs.sparkSession.createDataFrame([], schema)), totals
    passes.append("spell")
    return words.unionByName(checkpointed(spell(texts, context.broadcast(chosen), longest, least))), totals


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def collocations(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases that hold together best.

    A phrase of count a, cut into parts of counts l and r, scores floor(2,000,000 a / (l + r)); its weakest cut counts.
    A phrase inside a longer one that occurs 80 % as often or more is dropped."""
    phrases, totals = mine_phrases(docs, key, text, lang, least, longest, share)
    candidates = phrases.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    cut = candidates.withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    part = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    cut = cut.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    for side, count in (("left", "l"), ("right", "r")):
        counts = phrases.select("lang", F.col("phrase").alias(side), F.col("n").alias(count))
        cut = cut.join(counts, ["lang", side])
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cut.groupBy("lang", "phrase", "a").agg(weakest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # spans of longer candidates, the most frequent of each
    inner = candidates.filter("size > 2").withColumn("span", F.explode(F.expr("sequence(2, size - 1)")))
    inner = inner.withColumn("start", F.explode(F.expr("sequence(1, size - span + 1)")))
    inner = inner.select("lang", part(F.col("start"), F.col("span")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (_exact("longer") * 100 < _exact("a") * 80))
    # the best of parts of a language first, so that no task sorts a whole language
    shards = shard_count(docs.sparkSession)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(shards)))
    for parts in (shards, max(1, round(shards**0.5)), 1):
        best = best.withColumn("part", F.col("part") % parts)
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


COLLOCATION_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
spans AS (SELECT lang, w, i, unnest(range(1, least(4, len(w) - i + 1) + 1)) AS size FROM starts),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
counts AS (SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, count(*) AS f FROM spans GROUP BY ALL HAVING count(*) >= 30),
candidates AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1),
cuts AS (SELECT lang, phrase, size, a, w, unnest(range(1, size)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1 :], ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(w[s : s + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, m, unnest(range(1, size - m + 2)) AS s FROM (SELECT lang, w, a, size, unnest(range(2, size)) AS m FROM candidates) p) q
  GROUP BY ALL),
kept AS (SELECT s.* FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase WHERE longer IS NULL OR 100 * longer < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT x.lang, rank, phrase, a, l, r, n, score FROM ranked x JOIN totals t ON t.lang = x.lang WHERE rank <= 2000
"""
