"""Boosted trees by gradient histograms: second-order gains, a learnt side for nulls, early stopping.

Features are cut once at quantiles; rows are packed into blocks of one byte a feature and written to the shared
folder with their margins. Every level of a round is one job: each task sums gradients by (model, node, feature, bin)
over its blocks, and one aggregate adds the tasks up, so what moves depends on the model's size, not on the rows. Models
for all folds grow side by side in the same jobs, each on the rows of the other folds, and stop on their own fold.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .core import checkpointed
from .trees import Tree, Trees, matrix, scored_by

BLOCK_ROWS = 1 << 16
#: Rounds after which margins are written anew; until then later trees are added to them on the fly.
REWRITE = 16
#: Gains that differ by less count as equal, so that the order in which tasks add up makes no difference.
TIE = 1e-9


@dataclass(frozen=True)
class Settings:
    objective: str = "logistic"  # or "squared"
    rounds: int = 200
    depth: int = 3
    rate: float = 0.1
    bins: int = 64
    l2: float = 1.0
    min_gain: float = 0.0
    min_rows: int = 1
    patience: int = 10


@dataclass
class Boosted:
    """A fitted model: its trees up to the best round, gain by feature, validation loss by round."""

    model: Trees
    objective: str
    gains: dict[str, float]
    losses: list[float]

    @property
    def rounds(self) -> int:
        return len(self.model.trees)

    def scored(self, df: DataFrame) -> DataFrame:
        """Adds `score` (probability or value) and `prediction`."""
        out = scored_by(df, self.model)
        if self.objective == "logistic":
            out = out.withColumn("score", 1.0 / (1.0 + F.exp(-F.col("score"))))
            return out.withColumn("prediction", (F.col("score") >= 0.5).cast("double"))
        return out.withColumn("prediction", F.col("score"))

    def importances(self) -> list[tuple[str, float]]:
        """(feature, share of the total gain)."""
        total = sum(self.gains.values())
        return [(f, g / total if total else 0.0) for f, g in self.gains.items()]


@dataclass
class _Growing:
    """A tree over bins: rows (feature, bin, left, right, null left, value); the frontier holds nodes still to be split."""

    nodes: list[list] = field(default_factory=lambda: [[-1, 0, -1, -1, False, 0.0]])
    frontier: list[int] = field(default_factory=lambda: [0])

    def arrays(self) -> tuple[np.ndarray, ...]:
        columns = list(zip(*self.nodes))
        return tuple(np.array(c, k) for c, k in zip(columns, (np.int32, np.int32, np.int32, np.int32, bool, np.float64)))


def _nodes_of(arrays: tuple[np.ndarray, ...], bins: np.ndarray, missing: int) -> np.ndarray:
    """The node that each row of bins ends in."""
    feature, cut, left, right, null_left, _ = arrays
    at = np.zeros(len(bins), np.int32)
    rows = np.arange(len(bins))
    while len(rows):
        node = at[rows]
        inner = feature[node] >= 0
        rows, node = rows[inner], node[inner]
        b = bins[rows, feature[node]]
        go = np.where(b == missing, null_left[node], b <= cut[node])
        at[rows] = np.where(go, left[node], right[node])
    return at


def bin_edges(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Distinct values of each feature near its quantiles, from one aggregate of mergeable sketches over all features; a
    bin is (edge before, edge]. The rank of an edge is off by a fiftieth of a bin at most."""
    shares = [i / bins for i in range(1, bins)]
    x = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features]
    row = df.agg(*[F.percentile_approx(c, shares, 50 * bins).alias(f"e{i}") for i, c in enumerate(x)]).first()
    return [np.unique(np.array(row[i] or [], float)) for i in range(len(features))]


def _pack(df: DataFrame, features: Sequence[str], label: str, weight: str | None, part: str | None, edges: list[np.ndarray], bias: list[float], missing: int) -> DataFrame:
    """Blocks of binned rows with label, weight, part and one margin for each model."""
    columns = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    columns += [F.col(label).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")]
    rows = df.where(F.col(label).isNotNull()).select(*columns, (F.col(part).cast("int") if part else F.lit(0)).alias("part"))
    names = [f"x{i}" for i in range(len(features))]

    def blob(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        x = matrix(table, names)
        bins = np.empty(x.shape, np.uint8)
        for f, cut in enumerate(edges):
            bins[:, f] = np.where(np.isnan(x[:, f]), missing, np.searchsorted(cut, x[:, f], side="left"))
        y, w, p = (table[c].to_numpy(zero_copy_only=False) for c in ("y", "w", "part"))
        margin = np.repeat(np.array(bias)[:, None], len(y), axis=1)
        return pa.RecordBatch.from_pydict({"block": pa.array([pickle.dumps((bins, y, w, p, margin))], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK_ROWS:
                yield blob(held)
                held, size = [], 0
        if size:
            yield blob(held)

    return checkpointed(rows.mapInArrow(run, "block binary"))


def _gradients(objective: str, margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if objective == "logistic":
        p = 1 / (1 + np.exp(-margin))
        return w * (p - y), w * np.maximum(p * (1 - p), 1e-16)
    return w * (margin - y), w.copy()


def _losses(objective: str, margin: np.ndarray, y: np.ndarray) -> np.ndarray:
    if objective == "logistic":
        return np.logaddexp(0, margin) - y * margin
    return (margin - y) ** 2


def _best_split(hist: np.ndarray, n_edges: np.ndarray, s: Settings) -> tuple | None:
    """(gain, feature, bin, null left, left sums, right sums) of a node's histogram (feature, bin, [g, h, n]); the last
    bin holds nulls. A cut behind the last edge parts nulls from values."""
    total = hist[0].sum(axis=0)
    missing = hist[:, -1]
    below = np.cumsum(hist[:, :-1], axis=1)
    best = None

    def worth(x: np.ndarray) -> np.ndarray:
        return x[..., 0] ** 2 / (x[..., 1] + s.l2)

    for null_left in (False, True):
        left = below + missing[:, None] if null_left else below
        right = total - left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = 0.5 * (worth(left) + worth(right) - worth(total)) - s.min_gain
        bins = np.arange(gain.shape[1])
        allowed = (left[..., 2] >= s.min_rows) & (right[..., 2] >= s.min_rows) & (bins <= n_edges[:, None])
        gain = np.where(allowed & np.isfinite(gain), gain, -np.inf)
        top = gain.max(initial=-np.inf)
        if top <= TIE or best is not None and top <= best[0] * (1 + TIE):
            continue
        f, b = np.unravel_index(int(np.argmax((gain >= top * (1 - TIE)).ravel())), gain.shape)
        # with no nulls in the node either side would do: they go with the more rows
        side = null_left if missing[f, 2] > 0 else bool(left[f, b, 2] >= right[f, b, 2])
        best = float(gain[f, b]), int(f), int(b), side, left[f, b], right[f, b]
    return best


class _Trainer:
    def __init__(self, blocks: DataFrame, parts: list[int | None], n_edges: np.ndarray, s: Settings):
        self.blocks, self.parts, self.n_edges, self.s = blocks, parts, n_edges, s
        self.features, self.width = len(n_edges), s.bins + 1
        self.fresh: dict[int, list[tuple]] = {k: [] for k in range(len(parts))}  # trees since margins were written

    def measure(self, trees: dict[int, _Growing], with_loss: bool) -> tuple[np.ndarray, dict[int, float]]:
        """Histograms (model, slot, feature, bin, [g, h, n]) of the frontiers' nodes, and mean validation losses."""
        s, parts, features, width, missing = self.s, self.parts, self.features, self.width, self.s.bins
        fresh = {k: list(self.fresh[k]) for k in trees}
        grown = {k: (t.arrays(), list(t.frontier)) for k, t in trees.items()}
        order = sorted(trees)
        slots = max((len(t.frontier) for t in trees.values()), default=0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(order), slots, features, width, 3))
            loss = np.zeros((len(order), 2))
            for batch in batches:
                for blob in batch["block"]:
                    bins, y, w, part, margins = pickle.loads(blob.as_buffer())
                    for i, k in enumerate(order):
                        margin = margins[k].copy()
                        for arrays in fresh[k]:
                            margin += arrays[5][_nodes_of(arrays, bins, missing)]
                        out = part == parts[k] if parts[k] is not None else np.zeros(len(y), bool)
                        if with_loss:
                            loss[i] += (w[out] * _losses(s.objective, margin[out], y[out])).sum(), w[out].sum()
                        arrays, frontier = grown[k]
                        if not frontier:
                            continue
                        g, h = _gradients(s.objective, margin, y, w)
                        slot_of = np.full(len(arrays[0]), -1, np.int64)
                        slot_of[frontier] = np.arange(len(frontier))
                        slot = slot_of[_nodes_of(arrays, bins, missing)]
                        on = np.flatnonzero(~out & (slot >= 0))
                        g, h, place = g[on], h[on], slot[on] * width
                        for f in range(features):
                            code = place + bins[on, f]
                            for j, values in enumerate((g, h, None)):
                                total[i, :, f, :, j] += np.bincount(code, values, slots * width).reshape(slots, width)
            flat = total.reshape(-1, 3)
            cell = np.flatnonzero(flat[:, 2])
            columns = [np.concatenate([cell, -1 - np.arange(len(order))])]
            columns += [np.concatenate([flat[cell, j], x]) for j, x in enumerate((loss[:, 0], loss[:, 1], np.zeros(len(order))))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell", "g", "h", "n"])

        sums = self.blocks.mapInArrow(run, "cell long, g double, h double, n double").groupBy("cell").agg(*[F.sum(c).alias(c) for c in "ghn"])
        found = sums.toPandas()  # models x nodes x features x bins at most
        cell, values = found["cell"].to_numpy(), found[["g", "h", "n"]].to_numpy()
        hist = np.zeros((len(order) * slots * features * width, 3))
        hist[cell[cell >= 0]] = values[cell >= 0]
        lost = {order[-1 - c]: v[0] / v[1] for c, v in zip(cell, values) if c < 0 and v[1] > 0}
        return hist.reshape(len(order), slots, features, width, 3), lost

    def rewrite(self) -> None:
        """Margins with all trees so far, written anew."""
        fresh, missing = {k: list(t) for k, t in self.fresh.items()}, self.s.bins

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob in batch["block"]:
                    bins, y, w, part, margins = pickle.loads(blob.as_buffer())
                    margins = margins.copy()
                    for k, trees in fresh.items():
                        for arrays in trees:
                            margins[k] += arrays[5][_nodes_of(arrays, bins, missing)]
                    yield pa.RecordBatch.from_pydict({"block": pa.array([pickle.dumps((bins, y, w, part, margins))], pa.binary())})

        self.blocks = checkpointed(self.blocks.mapInArrow(run, "block binary"))
        self.fresh = {k: [] for k in self.fresh}

    def split(self, tree: _Growing, hist: np.ndarray, gains: np.ndarray, last: bool) -> None:
        """One level more; nodes without a gain stay leaves."""
        frontier, tree.frontier = tree.frontier, []
        for slot, node in enumerate(frontier):
            found = _best_split(hist[slot], self.n_edges, self.s)
            if found is None:
                if node == 0:
                    total = hist[slot][0].sum(axis=0)
                    tree.nodes[0][5] = self._leaf(total)
                continue
            gain, f, b, null_left, left, right = found
            gains[f] += gain
            at = len(tree.nodes)
            tree.nodes += [[-1, 0, -1, -1, False, self._leaf(x)] for x in (left, right)]
            tree.nodes[node][:5] = [f, b, at, at + 1, null_left]
            if not last:
                tree.frontier += [at, at + 1]

    def _leaf(self, sums: np.ndarray) -> float:
        return -self.s.rate * float(sums[0]) / (float(sums[1]) + self.s.l2) if sums[1] + self.s.l2 > 0 else 0.0


def boost(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    settings: Settings = Settings(),
    fold: str | None = None,
    valid: str | None = None,
    weight: str | None = None,
) -> list[Boosted]:
    """Boosted models: one per value of the column `fold`, trained on the other folds and stopped on its own; or one,
    stopped on the rows where `valid` holds; or one that runs all its rounds. Null features are learnt from; rows
    without a label are left out."""
    s = settings
    if not 2 <= s.bins <= 255 or s.objective not in ("logistic", "squared"):
        raise ValueError("bins are 2 to 255, the objective logistic or squared")
    part = fold
    if valid is not None:
        df, part = df.withColumn("_part", F.coalesce(F.col(valid), F.lit(False)).cast("int")), "_part"
    y, w = F.col(label).cast("double"), F.col(weight).cast("double") if weight else F.lit(1.0)
    sums = df.where(y.isNotNull()).groupBy((F.col(part).cast("int") if part else F.lit(0)).alias("part")).agg(F.sum(w * y).alias("y"), F.sum(w).alias("w")).collect()
    parts: list[int | None] = sorted(r["part"] for r in sums) if fold else [1 if valid else None]
    bias = []
    for p in parts:
        mean = sum(r["y"] for r in sums if r["part"] != p) / max(sum(r["w"] for r in sums if r["part"] != p), 1e-300)
        bias.append(mean if s.objective == "squared" else math.log(max(mean, 1e-9) / max(1 - mean, 1e-9)))
    edges = bin_edges(df, features, s.bins)
    trainer = _Trainer(_pack(df, features, label, weight, part, edges, bias, s.bins), parts, np.array([len(e) for e in edges]), s)
    grown: list[list[tuple]] = [[] for _ in parts]
    gains: list[list[np.ndarray]] = [[] for _ in parts]
    losses: list[list[float]] = [[] for _ in parts]
    active = set(range(len(parts)))

    def note(lost: dict[int, float]) -> None:
        for k in list(active):
            if k in lost:
                losses[k].append(lost[k])
                if len(losses[k]) - 1 - int(np.argmin(losses[k])) >= s.patience:
                    active.discard(k)

    for round_ in range(s.rounds):
        trees = {k: _Growing() for k in active}
        gained = {k: np.zeros(len(features)) for k in active}
        for level in range(s.depth):
            hist, lost = trainer.measure(trees, level == 0)
            if level == 0:
                note(lost)
                order = sorted(trees)
                trees = {k: t for k, t in trees.items() if k in active}
                hist = hist[[i for i, k in enumerate(order) if k in active]]
            for i, k in enumerate(sorted(trees)):
                trainer.split(trees[k], hist[i], gained[k], level == s.depth - 1)
            if not any(t.frontier for t in trees.values()):
                break
        for k, tree in trees.items():
            arrays = tree.arrays()
            grown[k].append(arrays)
            gains[k].append(gained[k])
            trainer.fresh[k].append(arrays)
            if len(tree.nodes) == 1:  # nothing left to gain
                active.discard(k)
        if not active:
            break
        if (round_ + 1) % REWRITE == 0:
            trainer.rewrite()
    if any(p is not None for p in parts):
        late = [k for k in range(len(parts)) if len(losses[k]) == len(grown[k])]
        if late:  # the loss after the last round
            _, lost = trainer.measure({k: _Growing(frontier=[]) for k in late}, True)
            for k in late:
                losses[k] += [lost[k]] if k in lost else []
    out = []
    for k in range(len(parts)):
        n = int(np.argmin(losses[k])) if losses[k] else len(grown[k])
        trees = tuple(_thresholds(a, edges) for a in grown[k][:n])
        total = sum(gains[k][:n], np.zeros(len(features)))
        out.append(Boosted(Trees(tuple(features), trees, (1.0,) * n, bias[k]), s.objective, dict(zip(features, total.tolist())), losses[k]))
    return out


def _thresholds(arrays: tuple[np.ndarray, ...], edges: list[np.ndarray]) -> Tree:
    feature, cut, left, right, null_left, value = arrays
    at = [math.nan if f < 0 else edges[f][b] if b < len(edges[f]) else math.inf for f, b in zip(feature, cut)]
    return Tree(feature.astype(np.int64), np.array(at, float), left.astype(np.int64), right.astype(np.int64), null_left, value)


def fold_scores(df: DataFrame, models: Sequence[Boosted], fold: str, folds: Sequence[int]) -> DataFrame:
    """Adds `score`: each row by the model that was stopped on its fold, in one pass; the mean of all models for rows
    without a fold."""
    kept = df.drop("score")
    place = {f: k for k, f in enumerate(folds)}
    features, logistic = models[0].model.features, models[0].objective == "logistic"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, features)
            own = np.array([place.get(f, -1) for f in batch.column(batch.schema.get_field_index(fold)).to_pylist()], np.int64)
            score = np.zeros(len(x))
            for k, boosted in enumerate(models):
                rows = np.flatnonzero((own == k) | (own < 0))
                value = boosted.model.predict(x[rows])
                value = 1 / (1 + np.exp(-value)) if logistic else value
                score[rows] += np.where(own[rows] < 0, value / len(models), value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())]))


def out_of_fold(
    df: DataFrame, given: DataFrame | None, features: Sequence[str], label: str, key: str, settings: Settings = Settings(), fold: str = "fold"
) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Out-of-fold scores of the labelled rows, mean score of the given ones over the fold models, and the
    (feature, importance, fold) table; all fold models grow in the same passes."""
    folds = sorted(r[0] for r in df.where(F.col(label).isNotNull()).select(F.col(fold).cast("int")).distinct().collect())
    models = boost(df, features, label, settings, fold=fold)
    oof = fold_scores(df, models, fold, folds).select(key, label, fold, "score")
    mean = None
    if given is not None:
        mean = fold_scores(given.select(key, *features).withColumn(fold, F.lit(None).cast("int")), models, fold, folds).select(key, "score")
    rows = [(f, float(v), int(k)) for k, boosted in zip(folds, models) for f, v in boosted.importances()]
    return oof, mean, df.sparkSession.createDataFrame(rows, "feature string, importance double, fold int")
