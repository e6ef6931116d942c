"""LM scoring: a log-bilinear model trained in numpy by noise-contrastive estimation.

Two preceding symbols predict the next: their vectors pass through a matrix for each position, and the sum's product
with a symbol's output vector, plus a bias, is its score. Symbols are the most frequent words, classes of all other
words by their endings, and the end of a text. A word of a class has the class's probability times its add-one share
within it, with one place for unknown words, so the model is normalised over an open vocabulary.

Counts of all words over all training documents come from one exchange of sorted key lists (see `repeats`); only the
most frequent words and a sum for each class reach the driver. Documents are dealt to as many shards as the session has
shuffle partitions by a hash of id and text and ordered by it, so that the model follows from the rows alone, however
they were partitioned before. Every round of training runs over all training text: each shard takes gradient steps on
its own chunks from the common parameters, and the results are averaged, by slices of the parameters. Normalisers are batched matrix products over all pairs of context symbols, made once.

Defined cases: a null or empty text has the end as its only token; a null id is learnt from, like any id whose
remainder isn't the held-out one; repeated rows count each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.core import checkpointed

from .arrays import LOWER, Words, byte_hasher, mix, text_bytes
from .repeats import _ROWS, _table, expand, expand_sorted, join_parts, pack_chunks, split_parts, squeeze, squeeze_sorted, unpack
from .tables import id_remainder, shard_count

FOLDS, HELD_OUT = 7, 2
#: Words with a symbol of their own, classes of the others; the end of a text is the last symbol.
FREQUENT, CLASSES = 256, 255
SYMBOLS = FREQUENT + CLASSES + 1
END = SYMBOLS - 1
CONTEXT, SIZE = 2, 24
#: Noise words drawn for a step, and how many of them count for one observed word.
DRAWN, NOISE = 32, 16
ROUNDS, STEPS, RATE = 2, 6, 0.08
ENDING = 3
COUNTS, TOTALS, TOP = range(3)


def chunk_words(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, hash of each, class of each by its last bytes), A-Z lowered."""
    words = Words(data, offsets)
    hasher = byte_hasher(LOWER[data])
    ending = hasher.spans(np.maximum(words.ends - ENDING, words.starts), words.ends)
    return words, hasher.spans(words.starts, words.ends), (ending % np.uint64(CLASSES)).astype(np.uint8)


def count_words(chunks: DataFrame, shards: int) -> DataFrame:
    """Rows of three kinds: a chunk's words' counts in all training text, class totals, most frequent words."""

    def listed(batches):
        for batch in batches:
            for chunk, blob in zip(batch["chunk"].to_pylist(), batch["blob"]):
                docs = unpack(blob.as_buffer())
                words, hashes, kind = chunk_words(*text_bytes(docs["text"]))
                known, first, where = np.unique(hashes, return_index=True, return_inverse=True)
                learnt = np.repeat(docs["train"].to_numpy(zero_copy_only=False), words.per_document)
                n = np.bincount(where, learnt, minlength=len(known)).astype(np.int32)
                shard = (known >> np.uint64(40)).astype(np.int64) * shards >> 24
                cut = np.searchsorted(shard, np.arange(shards + 1))
                yield _table(
                    [
                        (int(s), chunk, COUNTS, join_parts([squeeze_sorted(known[p]), squeeze(n[p]), squeeze(kind[first][p])]))
                        for s in np.flatnonzero(np.diff(cut))
                        for p in [slice(cut[s], cut[s + 1])]
                    ]
                )

    def summed(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists = [split_parts(b) for b in table["blob"].to_pylist()]
        keys = [expand_sorted(x[0]) for x in lists]
        known, first, where = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        total = np.bincount(where, np.concatenate([expand(x[1], np.int32) for x in lists])).astype(np.int64)
        kind = np.concatenate([expand(x[2], np.uint8) for x in lists])[first].astype(np.int64)
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        shard = table["shard"][0].as_py()
        rows = [(shard, c, COUNTS, squeeze(part)) for c, part in zip(table["chunk"].to_pylist(), np.split(total[where], cuts))]
        seen = total > 0
        sums = np.stack([np.bincount(kind[seen], total[seen], minlength=CLASSES), np.bincount(kind[seen], minlength=CLASSES)]).astype(np.int64)
        rows.append((shard, -1, TOTALS, sums.tobytes()))
        top = np.lexsort((known, -total))[:FREQUENT]
        top = top[total[top] > 0]
        rows.append((shard, -1, TOP, np.stack([known[top].view(np.int64), total[top], kind[top]]).astype(np.int64).tobytes()))
        return pa.Table.from_batches([_table(rows)])

    return checkpointed(chunks.mapInArrow(listed, _ROWS).groupBy("shard").applyInArrow(summed, _ROWS))


@dataclass
class Vocabulary:
    """What the corpus counts say: training tokens, distinct ones, frequent words, class totals, symbol counts."""

    tokens: int
    distinct: int
    ends: int
    frequent: np.ndarray  # sorted hashes; the place is the symbol
    class_tokens: np.ndarray
    class_words: np.ndarray
    symbol_counts: np.ndarray

    def symbols(self, hashes: np.ndarray, kind: np.ndarray) -> np.ndarray:
        out = FREQUENT + kind.astype(np.int64)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, hashes), len(self.frequent) - 1)
            hit = self.frequent[at] == hashes
            out[hit] = at[hit]
        return out


def vocabulary(counts: DataFrame, training_documents: int) -> Vocabulary:
    def numbers(width: int, names: str):
        def read(batches):
            for batch in batches:
                for blob in batch["blob"]:
                    rows = np.frombuffer(blob.as_buffer(), np.int64).reshape(width, -1)
                    place = [] if width == 3 else [pa.array(np.arange(rows.shape[1]), pa.int64())]
                    yield pa.RecordBatch.from_arrays(place + [pa.array(r) for r in rows], names=names.replace(" long", "").split(", "))

        return read

    totals, tops = "class long, n long, words long", "word long, n long, class long"
    of_class = counts.filter(F.col("kind") == TOTALS).mapInArrow(numbers(2, totals), totals)
    of_class = of_class.groupBy("class").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).toPandas()
    top = counts.filter(F.col("kind") == TOP).mapInArrow(numbers(3, tops), tops).orderBy(F.desc("n"), "word").limit(FREQUENT).toPandas()
    class_tokens, class_words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    class_tokens[of_class["class"].to_numpy(int)] = of_class["n"]
    class_words[of_class["class"].to_numpy(int)] = of_class["words"]
    tokens, distinct = int(class_tokens.sum()) + training_documents, int(class_words.sum()) + (training_documents > 0)
    np.subtract.at(class_tokens, top["class"].to_numpy(int), top["n"].to_numpy(np.int64))
    np.subtract.at(class_words, top["class"].to_numpy(int), 1)
    words = top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    symbol_counts = np.zeros(SYMBOLS, np.int64)
    symbol_counts[: len(words)] = top["n"].to_numpy(np.int64)[order]
    symbol_counts[FREQUENT:END] = class_tokens
    symbol_counts[END] = training_documents
    return Vocabulary(tokens, distinct, training_documents, words[order], class_tokens, class_words, symbol_counts)


def with_ends(symbols: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols with END after each document, cuts of the longer sequence)."""
    owner = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    out = np.full(len(symbols) + len(cuts) - 1, END, np.int64)
    out[np.arange(len(symbols)) + owner] = symbols
    return out, cuts + np.arange(len(cuts))


def contexts(symbols: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A number for the two symbols before each; before a document's start stands END."""
    one, two = np.full(len(symbols), END, np.int64), np.full(len(symbols), END, np.int64)
    one[1:], two[2:] = symbols[:-1], symbols[:-2]
    one[cuts[:-1]] = END
    second = cuts[:-1] + 1
    second = second[second < cuts[1:]]
    two[cuts[:-1]] = END
    two[second] = END
    return one * SYMBOLS + two


def add_rows(out: np.ndarray, index: np.ndarray, rows: np.ndarray) -> None:
    """out[index] += rows, where an index may repeat."""
    if not len(index):
        return
    if (index[1:] < index[:-1]).any():
        narrow = index.astype(np.uint16) if len(out) <= 1 << 16 else index  # sorted by radix
        order = np.argsort(narrow, kind="stable")
        index, rows = index[order], rows.take(order, axis=0)
    first = np.flatnonzero(np.append(True, index[1:] != index[:-1]))
    out[index[first]] += np.add.reduceat(rows, first, axis=0, dtype=np.float64)


class LogBilinear:
    """Parameters of the model in one array, seen as vectors, position matrices, output vectors and biases."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat
        a, b = SYMBOLS * SIZE, CONTEXT * SIZE * SIZE
        self.inputs = flat[:a].reshape(SYMBOLS, SIZE)
        self.matrices = flat[a : a + b].reshape(CONTEXT, SIZE, SIZE)
        self.outputs = flat[a + b : 2 * a + b].reshape(SYMBOLS, SIZE)
        self.biases = flat[2 * a + b :]

    @classmethod
    def initial(cls, counts: np.ndarray, seed: int = 11) -> LogBilinear:
        """Small random vectors, and biases that make it the model of single symbols."""
        rng = np.random.default_rng(seed)
        model = cls(np.zeros(2 * SYMBOLS * SIZE + CONTEXT * SIZE * SIZE + SYMBOLS, np.float32))
        model.inputs[:] = rng.normal(0, 0.3, model.inputs.shape)
        model.outputs[:] = rng.normal(0, 0.1, model.outputs.shape)
        model.matrices[:] = np.eye(SIZE) * 0.5
        model.biases[:] = np.log((counts + 1) / (counts.sum() + SYMBOLS))
        return model

    def predicted(self, context: np.ndarray) -> np.ndarray:
        first, second = self.inputs @ self.matrices[0], self.inputs @ self.matrices[1]
        return first.take(context // SYMBOLS, axis=0) + second.take(context % SYMBOLS, axis=0)

    def normalisers(self) -> np.ndarray:
        """log of the sum of exp(score) over all symbols, for every pair of context symbols."""
        first, second = self.inputs @ self.matrices[0], self.inputs @ self.matrices[1]
        out = np.empty((SYMBOLS, SYMBOLS), np.float32)
        for s in range(SYMBOLS):
            scores = (first[s] + second) @ self.outputs.T + self.biases
            top = scores.max(axis=1)
            out[s] = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
        return out.ravel()

    def learn(self, context: np.ndarray, target: np.ndarray, noise: np.ndarray, seen: np.ndarray, rng: np.random.Generator, rate: float = RATE) -> None:
        """One AdaGrad step of noise-contrastive estimation on observed (context, target) pairs; `seen` holds the sums
        of squared gradients. Pairs and contexts count as often as they occur; noise is shared by the step."""
        pairs, times = np.unique(context * SYMBOLS + target, return_counts=True)
        used, place = np.unique(pairs // SYMBOLS, return_inverse=True)
        target, weight = pairs % SYMBOLS, (times / len(context)).astype(np.float32)
        of_context = np.bincount(place, weight).astype(np.float32)
        h = self.predicted(used)
        drawn = rng.choice(SYMBOLS, DRAWN, p=noise)
        log_noise = np.log(NOISE * noise).astype(np.float32)
        of_pair, wanted = h.take(place, axis=0), self.outputs.take(target, axis=0)
        score = np.einsum("ij,ij->i", of_pair, wanted) + self.biases[target] - log_noise[target]
        up = weight / (1 + np.exp(np.clip(score, -30, 30)))
        score = h @ self.outputs[drawn].T + (self.biases[drawn] - log_noise[drawn])
        down = np.float32(-NOISE / DRAWN) * of_context[:, None] / (1 + np.exp(-np.clip(score, -30, 30)))
        step = LogBilinear(np.zeros_like(self.flat))
        back = down @ self.outputs[drawn]
        add_rows(back, place, up[:, None] * wanted)
        add_rows(step.outputs, target, up[:, None] * of_pair)
        add_rows(step.outputs, drawn, down.T @ h)
        step.biases += np.bincount(target, up, minlength=SYMBOLS) + np.bincount(drawn, down.sum(axis=0), minlength=SYMBOLS)
        for j, symbol in enumerate((used // SYMBOLS, used % SYMBOLS)):
            step.matrices[j] = self.inputs.take(symbol, axis=0).T @ back
            add_rows(step.inputs, symbol, back @ self.matrices[j].T)
        seen += step.flat**2
        self.flat += rate * step.flat / np.sqrt(seen + 1e-10)


def fit_model(chunks: DataFrame, words: Vocabulary, rounds: int = ROUNDS, steps: int = STEPS, seed: int = 11, slices: int = 16) -> LogBilinear:
    """Rounds of local training over all chunks, averaged by the number of steps."""
    model = LogBilinear.initial(words.symbol_counts, seed)
    noise = (words.symbol_counts + 1) / (words.symbol_counts.sum() + SYMBOLS)
    sc = chunks.sparkSession.sparkContext
    for number in range(rounds):
        shared = sc.broadcast((model.flat, words, noise))

        def learnt(batches, number=number, shared=shared):
            start, words, noise = shared.value
            local, seen, weight = LogBilinear(start.copy()), np.zeros_like(start), 0
            for batch in batches:
                for chunk, blob in zip(batch["chunk"].to_pylist(), batch["blob"]):
                    docs = unpack(blob.as_buffer())
                    docs = docs.filter(docs["train"])
                    if docs.num_rows == 0:
                        continue
                    own, hashes, kind = chunk_words(*text_bytes(docs["text"]))
                    symbols, cuts = with_ends(words.symbols(hashes, kind), own.cuts)
                    context = contexts(symbols, cuts)
                    rng = np.random.default_rng([chunk, number, seed])
                    order = rng.permutation(len(symbols))
                    for part in np.array_split(order, min(steps, len(order))):
                        local.learn(context[part], symbols[part], noise, seen, rng)
                    weight += len(symbols)
            if weight:
                for s, part in enumerate(np.array_split(local.flat.astype(np.float64) * weight, slices)):
                    yield _table([(s, weight, 0, part.tobytes())])

        def averaged(table: pa.Table) -> pa.Table:
            parts = sorted(table["blob"].to_pylist())  # sums in one order wherever the rows come from
            mean = sum(np.frombuffer(p, np.float64) for p in parts) / sum(table["chunk"].to_pylist())
            return pa.Table.from_batches([_table([(table["shard"][0].as_py(), 0, 0, mean.tobytes())])])

        rows = chunks.mapInArrow(learnt, _ROWS).groupBy("shard").applyInArrow(averaged, _ROWS).select("shard", "blob").collect()
        if rows:
            model = LogBilinear(np.concatenate([np.frombuffer(r.blob, np.float64) for r in sorted(rows, key=lambda r: r.shard)]).astype(np.float32))
    return model


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = FOLDS, held: int = HELD_OUT) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    out = F.coalesce(id_remainder(key, folds) == held, F.lit(False))
    narrow = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"), (~out).alias("train"))
    # what a task learns from, and in which order, follows from the rows alone, not from the files they lie in
    shards = shard_count(spark)
    dealt = narrow.withColumn("h", F.xxhash64("doc", "text")).repartition(shards, "h").sortWithinPartitions("h", "doc").drop("h")
    chunks = pack_chunks(dealt, "text")
    counts = count_words(chunks, shards)
    words = vocabulary(counts, narrow.filter("train").count())
    model = fit_model(chunks, words)
    shared = spark.sparkContext.broadcast((words, model.flat, model.normalisers()))

    def scored(batches) -> Iterator[pa.RecordBatch]:
        words, flat, normalisers = shared.value
        model = LogBilinear(flat)
        for batch in batches:
            for blob, answers in zip(batch["blob"], batch["answers"].to_pylist()):
                docs = unpack(blob.as_buffer())
                own, hashes, kind = chunk_words(*text_bytes(docs["text"]))
                known, where = np.unique(hashes, return_inverse=True)
                got = sorted((a["shard"], a["blob"]) for a in answers or [])
                count = (np.concatenate([expand(b, np.int64) for _, b in got]) if got else np.zeros(0, np.int64))[where]
                symbol = words.symbols(hashes, kind)
                share = (count + 1) / (words.class_tokens[kind] + words.class_words[kind] + 1)
                within = np.where(symbol < FREQUENT, 0.0, np.log10(share))
                symbols, cuts = with_ends(symbol, own.cuts)
                context = contexts(symbols, cuts)
                used, place = np.unique(context, return_inverse=True)
                h = model.predicted(used)
                logit = np.einsum("ij,ij->i", h[place], model.outputs[symbols]) + model.biases[symbols] - normalisers[context]
                base = np.log10((count + 1) / (words.tokens + words.distinct + 1))
                by_document = lambda v, c: np.add.reduceat(np.append(v, 0.0), c[:-1]) * (np.diff(c) > 0)
                score = by_document(logit.astype(np.float64) / np.log(10), cuts) + by_document(within, own.cuts)
                of_end = np.log10((words.ends + 1) / (words.tokens + words.distinct + 1))
                yield pa.RecordBatch.from_pydict(
                    {
                        key: docs["doc"],
                        "held_out": pa.array(~docs["train"].to_numpy(zero_copy_only=False)),
                        "n_tokens": pa.array(own.per_document + 1, pa.int64()),
                        "n_known": pa.array((by_document((count > 0).astype(float), own.cuts) + (words.ends > 0)).astype(np.int64)),
                        "train_tokens": pa.array(np.full(docs.num_rows, words.tokens), pa.int64()),
                        "base_score": pa.array(by_document(base, own.cuts) + of_end),
                        "score": pa.array(score),
                    }
                )

    per_chunk = counts.filter(F.col("kind") == COUNTS).groupBy("chunk").agg(F.collect_list(F.struct("shard", "blob")).alias("answers"))
    both = chunks.join(per_chunk, "chunk", "left").select("chunk", "blob", "answers")
    kind = docs.schema[key].dataType.simpleString()
    return both.mapInArrow(scored, f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
