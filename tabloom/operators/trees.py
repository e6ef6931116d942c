"""Tree ensembles as node arrays: scores with nulls, and exact Shapley values against a whole background."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.base import Model
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .core import shared_dir

#: Values of a matrix of rows by leaves that one step holds.
CELLS = 1 << 21
#: Leaves times patterns of path features: what the background is counted into, and all that reaches the driver.
MOST_PATTERNS = 1 << 24


@dataclass(frozen=True)
class Tree:
    """Nodes by number, 0 the root. `feature` is -1 at a leaf; a row goes left if its value is at most `threshold`,
    and where it is null, if `null_left`."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    null_left: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(nodes: Sequence[tuple]) -> Tree:
        """From rows (feature, threshold, left, right, null_left, value)."""
        columns = list(zip(*nodes))
        kinds = (np.int64, np.float64, np.int64, np.int64, bool, np.float64)
        return Tree(*[np.array(c, k) for c, k in zip(columns, kinds)])

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x; NaN is null."""
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while len(rows):
            node = at[rows]
            inner = self.feature[node] >= 0
            rows, node = rows[inner], node[inner]
            v = x[rows, self.feature[node]]
            left = np.where(np.isnan(v), self.null_left[node], v <= self.threshold[node])
            at[rows] = np.where(left, self.left[node], self.right[node])
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaves_of(x)]


@dataclass(frozen=True)
class Trees:
    """A weighted sum of trees over named features, plus a constant."""

    features: tuple[str, ...]
    trees: tuple[Tree, ...]
    weights: tuple[float, ...]
    bias: float = 0.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for tree, w in zip(self.trees, self.weights):
            out += w * tree.predict(x)
        return out


def matrix(batch: pa.RecordBatch, features: Sequence[str]) -> np.ndarray:
    """The columns as doubles, nulls as NaN."""
    columns = [batch.column(batch.schema.get_field_index(c)).cast(pa.float64()) for c in features]
    return np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1) if columns else np.zeros((batch.num_rows, 0))


def trees_of(model: Model, features: Sequence[str]) -> Trees:
    """A fitted Spark ML tree, forest or boosted model: the mean probability of class 1 of a classifier's trees, the
    margin of a boosted classifier, the prediction of a regressor. Splits on categories are refused."""
    spark = SparkSession.getActiveSession()
    path = f"{shared_dir(spark)}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        data = data.select("treeID", "nodeData.*")
    else:
        data = data.withColumn("treeID", F.lit(0))
    boosted = hasattr(model, "treeWeights") and "GBT" in type(model).__name__
    probabilities = hasattr(model, "numClasses") and not boosted
    by_tree: dict[int, list] = {}
    for r in data.collect():  # the model's nodes
        by_tree.setdefault(r["treeID"], []).append(r)
    trees = []
    for number in sorted(by_tree):
        rows = sorted(by_tree[number], key=lambda r: r["id"])
        nodes = []
        for r in rows:
            split = r["split"]
            if split["numCategories"] >= 0 and split["featureIndex"] >= 0:
                raise ValueError("splits on categories have no threshold")
            leaf = r["leftChild"] < 0
            stats = r["impurityStats"]
            value = stats[1] / sum(stats) if probabilities else r["prediction"]
            nodes.append((-1 if leaf else split["featureIndex"], math.nan if leaf else split["leftCategoriesOrThreshold"][0], r["leftChild"], r["rightChild"], False, value))
        trees.append(Tree.of(nodes))
    weights = tuple(model.treeWeights) if boosted else (1.0 / len(trees),) * len(trees)
    return Trees(tuple(features), tuple(trees), weights)


def scored_by(df: DataFrame, model: Trees, name: str = "score") -> DataFrame:
    """Adds the model's value; null features take the side that each node keeps for them."""
    kept = df.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.predict(matrix(batch, model.features)))], names=[*batch.schema.names, name])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())]))


# ---------------------------------------------------------------- Shapley values


class LeafBoxes:
    """Every leaf of every tree as a box: for each feature on its path the values that lead to it."""

    def __init__(self, model: Trees):
        boxes = [(value * w, path) for tree, w in zip(model.trees, model.weights) for value, path in _paths(tree)]
        self.depth = max((len(path) for _, path in boxes), default=0)
        n = len(boxes)
        self.value = np.array([v for v, _ in boxes])
        # a place without a feature holds for any row, so it never makes a difference
        self.feature = np.zeros((n, self.depth), np.int64)
        self.used = np.zeros((n, self.depth), bool)
        self.low, self.high = np.full((n, self.depth), -np.inf), np.full((n, self.depth), np.inf)
        self.null = np.ones((n, self.depth), bool)
        for i, (_, path) in enumerate(boxes):
            for k, (f, (low, high, null)) in enumerate(sorted(path.items())):
                self.feature[i, k], self.low[i, k], self.high[i, k], self.null[i, k] = f, low, high, null
                self.used[i, k] = True
        if n << self.depth > MOST_PATTERNS:
            raise ValueError("the model has too many leaves for paths of so many features")

    def patterns(self, x: np.ndarray) -> np.ndarray:
        """For each row and leaf, which of the path's features let the row through, as bits."""
        out = np.zeros((len(x), len(self.value)), np.int32)
        for k in range(self.depth):
            v = x[:, self.feature[:, k]]
            inside = ((v > self.low[:, k]) | np.isneginf(self.low[:, k])) & (v <= self.high[:, k])
            out |= (np.where(np.isnan(v), self.null[:, k], inside) | ~self.used[:, k]).astype(np.int32) << k
        return out


def _paths(tree: Tree, node: int = 0, box: dict | None = None) -> Iterator[tuple[float, dict]]:
    """(value, {feature: (low, high, null passes)}) of each leaf."""
    box = box or {}
    f = int(tree.feature[node])
    if f < 0:
        yield float(tree.value[node]), box
        return
    low, high, null = box.get(f, (-math.inf, math.inf, True))
    at, null_left = float(tree.threshold[node]), bool(tree.null_left[node])
    yield from _paths(tree, int(tree.left[node]), box | {f: (low, min(high, at), null and null_left)})
    yield from _paths(tree, int(tree.right[node]), box | {f: (max(low, at), high, null and not null_left)})


def pair_weights(depth: int) -> np.ndarray:
    """W[x, z, k]: the credit of path feature k for a leaf that a row of pattern x and a background row of pattern z
    reach together. Features that only x passes must come from x, those that only z passes from z; over all orders of the
    features the leaf is reached or lost when the last of the first kind comes, or the first of the second."""
    size = 1 << depth
    x, z = np.arange(size)[:, None], np.arange(size)[None, :]
    count = np.array([bin(i).count("1") for i in range(size)])
    own, other = x & ~z, z & ~x
    a, b = count[own], count[other]
    fact = np.array([math.factorial(i) for i in range(depth + 1)], float)
    gain = np.where(a > 0, fact[np.maximum(a - 1, 0)] * fact[b] / fact[a + b], 0.0)
    loss = np.where(b > 0, fact[a] * fact[np.maximum(b - 1, 0)] / fact[a + b], 0.0)
    met = (x | z) == size - 1
    out = np.zeros((size, size, depth))
    for k in range(depth):
        out[:, :, k] = np.where(met & (own >> k & 1 > 0), gain, 0.0) - np.where(met & (other >> k & 1 > 0), loss, 0.0)
    return out


def _chunks(batches: Iterator[pa.RecordBatch], leaves: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, CELLS // max(1, leaves))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def background_counts(background: DataFrame, features: Sequence[str], boxes: LeafBoxes) -> DataFrame:
    """(leaf, pattern, n) over all rows of the background, combined in each task."""
    leaves = len(boxes.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(leaves << boxes.depth, np.int64)
        for batch in _chunks(batches, leaves):
            code = (np.arange(leaves) << boxes.depth) + boxes.patterns(matrix(batch, features))
            total += np.bincount(code.ravel(), minlength=len(total))
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code >> boxes.depth), pa.array(code & ((1 << boxes.depth) - 1)), pa.array(total[code])], names=["leaf", "pattern", "n"])

    return background.select(*features).mapInArrow(run, "leaf long, pattern long, n long").groupBy("leaf", "pattern").agg(F.sum("n").alias("n"))


def tree_shapley(df: DataFrame, model: Trees, key: Sequence[str], background: DataFrame) -> tuple[DataFrame, float]:
    """((key, feature, value, phi), expected value): exact interventional Shapley values of a tree ensemble.

    A background row matters to a leaf only by which of the path's features it passes, so the whole background is counted
    into (leaf, pattern) once; a row's values follow from its own patterns and those counts. Values of a row add up to its
    score less the expected value, the mean score over the background."""
    boxes = LeafBoxes(model)
    leaves, size = len(boxes.value), 1 << boxes.depth
    counts = np.zeros((leaves, size))
    for r in background_counts(background, model.features, boxes).collect():  # at most MOST_PATTERNS, by the model
        counts[r["leaf"], r["pattern"]] = r["n"]
    total = counts[0].sum() if leaves else 0.0
    share = counts / total if total else counts
    expected = model.bias + float(share[:, -1] @ boxes.value)
    weights = pair_weights(boxes.depth)
    # credit[leaf, pattern, k]: what feature k of the path gets from the leaf, over all the background
    credit = np.einsum("lz,xzk->lxk", share, weights, optimize=True) * boxes.value[:, None, None]
    names = list(model.features)
    fields = [f for f in df.select(*key).schema.fields]
    schema = T.StructType([*fields, T.StructField("feature", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("phi", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(leaves)
        for batch in _chunks(batches, leaves * max(1, boxes.depth)):
            x = matrix(batch, names)
            got = credit[every, boxes.patterns(x)]
            phi = np.zeros((len(x), len(names)))
            for f in range(len(names)):
                phi[:, f] = got[:, boxes.used & (boxes.feature == f)].sum(axis=1)
            rows = np.repeat(np.arange(len(x)), len(names))
            value = x.ravel()
            columns = [batch.column(batch.schema.get_field_index(k)).take(pa.array(rows)) for k in key]
            feature = pa.DictionaryArray.from_arrays(pa.array(np.tile(np.arange(len(names), dtype=np.int32), len(x))), names).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, feature, pa.array(value, mask=np.isnan(value)), pa.array(phi.ravel())], names=[*key, "feature", "value", "phi"])

    return df.select(*dict.fromkeys([*key, *names])).mapInArrow(run, schema), expected
