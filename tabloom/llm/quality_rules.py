"""Quality rules: document statistics, base rules, and gradient-boosted trees with monotonic constraints.

The trees are trained in numpy on a bounded labelled sample, flattened into node arrays and applied to whole
batches of documents. Scoring reads each text once and never looks past its own row.

Defined cases: a null or empty text has no words and fails the base rules; a null id is scored and never trained
on; repeated rows are scored alike; an empty table gives no rows; columns of the input other than the id and the
text are neither read nor kept, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, SpanHasher, Words, blocks, byte_hasher, covered, mix, spans_inside, sums_by_cut, text_bytes
from .tables import TRAINING_ROWS, labelled_sample

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Statistic and its constraint: -1, more of it never raises the verdict; 0, free.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "shout_share": -1,
    "digit_share": 0,
    "pipe_share": -1,
    "stop_share": 0,
    "line_words": 0,
    "one_char_words": 0,
}


def duplicate_flags(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value occurs earlier in the array, value occurs elsewhere in it) for each position."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    earlier, anywhere = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    earlier[order[1:]] = same
    anywhere[order[1:]] |= same
    anywhere[order[:-1]] |= same
    return earlier, anywhere


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Base counts and model features of each document."""
    words = Words(data, offsets)
    n_words = words.per_document
    points = (data & 0xC0) != 0x80
    word_chars = sums_by_cut(points & words.inside, offsets)
    n_symbols = sums_by_cut(SYMBOLS[data], offsets)

    # lines: every document starts one, and so does every byte after a newline
    after = np.flatnonzero(data == 10) + 1
    starts = np.concatenate([offsets[:-1], after])
    owner = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, after - 1, side="right") - 1])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    ends = np.where(last, offsets[1:][owner] if len(owner) else 0, np.append(starts[1:], 0) - 1)
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(words.inside, out=filled[1:])
    spoken = filled[ends] > filled[starts]
    starts, ends, owner = starts[spoken], ends[spoken], owner[spoken]
    earlier, _ = duplicate_flags(mix(byte_hasher(data).spans(starts, ends) + owner.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
    n_lines = np.bincount(owner, minlength=len(n_words))
    n_dup_lines = np.bincount(owner[earlier], minlength=len(n_words))

    hashes = words.hashes()
    begin, piece = spans_inside(words.cuts, REPEAT_WINDOW)
    windows = SpanHasher(hashes).spans(begin, begin + REPEAT_WINDOW)
    _, twice = duplicate_flags(mix(windows + piece.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
    n_repeat = sums_by_cut(covered(begin[twice], begin[twice] + REPEAT_WINDOW, len(words)), words.cuts)

    chars = np.maximum(word_chars, 1)
    some = np.maximum(n_words, 1)
    upper = sums_by_cut((data >= 65) & (data <= 90), offsets)
    shout = sums_by_cut(data == ord("!"), offsets)
    digits = sums_by_cut((data >= 48) & (data <= 57), offsets)
    pipes = sums_by_cut(data == ord("|"), offsets)
    lengths = words.ends - words.starts
    features = {
        "log_words": np.log1p(n_words),
        "word_length": word_chars / some,
        "symbol_share": n_symbols / chars,
        "dup_line_share": n_dup_lines / np.maximum(n_lines, 1),
        "repeat_share": n_repeat / some,
        "upper_share": upper / chars,
        "shout_share": shout / some,
        "digit_share": digits / chars,
        "pipe_share": pipes / some,
        "stop_share": sums_by_cut(lengths <= 3, words.cuts) / some,
        "line_words": n_words / np.maximum(n_lines, 1),
        "one_char_words": sums_by_cut(lengths == 1, words.cuts) / some,
    }
    base = {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": n_symbols,
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat,
    }
    return base | {k: v.astype(np.float64) for k, v in features.items()}


@dataclass
class Trees:
    """Boosted trees as flat node arrays: a node's children are rows of the same arrays, a leaf is its own child."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def margins(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of each row; all trees step down together, one level at a time."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.bias + self.value[node].sum(axis=1)


def train_trees(
    x: np.ndarray, y: np.ndarray, signs: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, smooth: float = 1.0
) -> Trees:
    """Logistic boosting on histograms. A feature of sign s only gets splits whose values rise with s, and each side
    of such a split is held beyond the middle value, so the whole model is monotonic in it."""
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T)], axis=1)
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(prior / (1 - prior)))
    margin = np.full(len(y), bias)
    nodes: list[list[float]] = []
    roots = []

    def grow(rows: np.ndarray, level: int, low: float, high: float, g: np.ndarray, h: np.ndarray) -> int:
        me = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        nodes.append([0, np.inf, me, me, float(np.clip(gs / (hs + smooth), low, high)) * rate])
        if level == depth or len(rows) < 20:
            return me
        best = None
        for f, edge in enumerate(edges):
            if len(edge) == 0:
                continue
            gl = np.cumsum(np.bincount(binned[rows, f], g[rows], minlength=len(edge) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, f], h[rows], minlength=len(edge) + 1))[:-1]
            nl = np.cumsum(np.bincount(binned[rows, f], minlength=len(edge) + 1))[:-1]
            vl, vr = np.clip(gl / (hl + smooth), low, high), np.clip((gs - gl) / (hs - hl + smooth), low, high)
            gain = gl**2 / (hl + smooth) + (gs - gl) ** 2 / (hs - hl + smooth) - gs**2 / (hs + smooth)
            fine = (nl >= 5) & (len(rows) - nl >= 5)
            if signs[f]:
                fine &= signs[f] * (vr - vl) >= 0
            gain = np.where(fine, gain, -1)
            k = int(np.argmax(gain))
            if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                best = (gain[k], f, k, vl[k], vr[k])
        if best is None:
            return me
        _, f, k, vl, vr = best
        middle = (vl + vr) / 2
        bounds = [(low, high), (low, high)]
        if signs[f] > 0:
            bounds = [(low, middle), (middle, high)]
        elif signs[f] < 0:
            bounds = [(middle, high), (low, middle)]
        go = binned[rows, f] <= k
        nodes[me][0], nodes[me][1] = f, float(edges[f][k])
        nodes[me][2] = grow(rows[go], level + 1, *bounds[0], g, h)
        nodes[me][3] = grow(rows[~go], level + 1, *bounds[1], g, h)
        return me

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        start = len(nodes)
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf, y - p, p * (1 - p)))
        part = _arrays(nodes[start:], [0], 0.0, depth, start)
        margin += part.margins(x)
    return _arrays(nodes, roots, bias, depth, 0)


def _arrays(nodes: list[list[float]], roots: list[int], bias: float, depth: int, first: int) -> Trees:
    table = np.array(nodes)
    whole = lambda c: table[:, c].astype(np.int64)
    return Trees(np.array(roots), whole(0), table[:, 1], whole(2) - first, whole(3) - first, table[:, 4], bias, depth)


def feature_rows(docs: DataFrame, key: str, text: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """The id, the base counts, the features and `extra` columns of each document."""
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *extra)
    kinds = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long"}
    fields = ["doc_id long", *[f"{c} {t}" for c, t in kinds.items()], *[f"{c} double" for c in FEATURES], *[f"{c} int" for c in extra]]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            made = statistics(*text_bytes(block["text"]))
            columns = {"doc_id": block["doc_id"], **{c: pa.array(v) for c, v in made.items()}}
            yield pa.RecordBatch.from_pydict(columns | {c: block[c].cast(pa.int32()) for c in extra})

    return source.mapInArrow(read, ", ".join(fields))


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAINING_ROWS) -> Trees:
    """Trees from at most `rows` labelled documents, chosen in hash order; with a single class, a constant."""
    sample = labelled_sample(labels, label, rows, key).withColumnRenamed(key, "_key")
    chosen = docs.select(F.col(key), F.col(text)).join(F.broadcast(sample), F.col(key) == F.col("_key"))
    got = feature_rows(chosen, key, text, ("label",)).select("doc_id", *FEATURES, "label").toPandas().sort_values(["doc_id", *FEATURES])
    signs = np.array(list(FEATURES.values()))
    y = got["label"].to_numpy(float)
    if len(set(y)) < 2:
        return Trees(np.zeros(1, int), np.zeros(1, int), np.full(1, np.inf), np.zeros(1, int), np.zeros(1, int), np.zeros(1), -4.0 if len(y) and y[0] == 0 else 4.0, 1)
    return train_trees(got[list(FEATURES)].to_numpy(float), y, signs)


def quality_verdicts(docs: DataFrame, trees: Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Base counts, base verdict, the trees' probability of good quality and the final verdict of each document."""
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            made = statistics(*text_bytes(block["text"]))
            margin = trees.margins(np.stack([made[c] for c in FEATURES], axis=1))
            failed = (made["n_words"] < MIN_WORDS) | (100 * made["n_repeat_words"] > MAX_REPEAT_PERCENT * made["n_words"])
            columns = {c: pa.array(made[c]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
            yield pa.RecordBatch.from_pydict(
                {"doc_id": block["doc_id"]}
                | columns
                | {"base_failed": pa.array(failed), "good_probability": pa.array(1 / (1 + np.exp(-margin))), "kept": pa.array(~failed & (margin >= 0))}
            )

    return source.mapInArrow(
        score,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, good_probability double, kept boolean",
    )
