"""Binning on exact (lo, hi] edges."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

from .column_trees import WHOLE, best_depths, counted_values, grow
from .core import checkpointed, numeric_columns, settle
from .ordered import hash_positions, quantiles
from .stages import Fitted, Stage

CHAIN_EDGES = 100


def bin_index(c: Column, edges: Sequence[float], clamp: bool = False) -> Column:
    """0-based bin of (lo, hi] edges, lowest edge included; null outside unless clamped."""
    n = len(edges) - 1
    out = F.when(c < edges[0], F.lit(0) if clamp else F.lit(None).cast("int"))
    for i in range(n):
        out = out.when(c <= edges[i + 1], F.lit(i))
    return out.when(c > edges[-1], F.lit(n - 1) if clamp else F.lit(None).cast("int"))


def add_bins(df: DataFrame, col: str, edges: Sequence[float], out: str, clamp: bool = False) -> DataFrame:
    """Bin index column: a CASE chain for few edges, a binary search for many.

    Spark's bucketizer closes bins on the left, so its splits are moved up by one float.
    """
    if len(edges) <= CHAIN_EDGES:
        return df.withColumn(out, bin_index(F.col(col), edges, clamp))
    splits = [edges[0], *[math.nextafter(e, math.inf) for e in edges[1:-1]], edges[-1]]
    x = F.col(col).cast("double")
    x = F.when(x < edges[0], edges[0]).when(x > edges[-1], edges[-1]).otherwise(x) if clamp else F.when(
        (x >= edges[0]) & (x <= edges[-1]), x
    )
    cut = Bucketizer(splits=splits, inputCol="_x", outputCol="_b")
    return cut.transform(df.withColumn("_x", x)).withColumn(out, F.col("_b").cast("int")).drop("_x", "_b")


def even_edges(lo: float, hi: float, bins: int) -> list[float]:
    width = (hi - lo) / bins
    return [lo + i * width for i in range(bins)] + [hi]


def integer_edges(lo: float, hi: float, bins: int) -> list[float]:
    """Whole-number edges from floor(min) that reach at least ceil(max)."""
    start, stop = math.floor(lo), math.ceil(hi)
    step = max(1, round((stop - start) / bins))
    count = math.ceil((stop + step - start) / step)
    return [float(start + i * step) for i in range(count)]


class FittedBins(Fitted):
    def edges(self) -> dict[str, list[float]]:
        out: dict[str, list[float]] = {v: [] for v in self.variables}
        for r in self.state.orderBy("variable", "position").collect():
            out[r["variable"]].append(r["edge"])
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        suffix, clamp = self.params["suffix"], self.params["clamp"]
        for v, e in self.edges().items():
            df = add_bins(df, v, e, f"{v}{suffix}", clamp)
            names = self.params.get("labels")
            if names:
                df = df.withColumn(
                    f"{v}{suffix}", F.element_at(F.array(*[F.lit(n) for n in names]), F.col(f"{v}{suffix}") + 1)
                )
        return df


def _bins(df: DataFrame, edges: dict[str, list[float]], suffix: str, clamp: bool, labels=None) -> FittedBins:
    rows = [(v, i, float(e)) for v, es in edges.items() for i, e in enumerate(es)]
    state = df.sparkSession.createDataFrame(rows, "variable string, position int, edge double")
    params = {"variables": list(edges), "suffix": suffix, "clamp": clamp, "labels": labels}
    return FittedBins(params, state)


class EqualFrequency(Stage):
    def __init__(
        self,
        q: int = 10,
        variables: Sequence[str] | None = None,
        duplicates: str = "raise",
        clamp: bool = False,
        suffix: str = "_bin",
    ):
        self.q, self.variables, self.duplicates = q, variables, duplicates
        self.clamp, self.suffix = clamp, suffix

    def fit(self, df: DataFrame) -> FittedBins:
        cols = list(self.variables or numeric_columns(df))
        cut = quantiles(df, cols, [i / self.q for i in range(self.q + 1)])
        edges = {}
        for c in cols:
            kept = sorted(set(cut[c]))
            if len(kept) < len(cut[c]) and self.duplicates == "raise":
                raise ValueError(f"bin edges of {c!r} are not unique; use duplicates='drop'")
            edges[c] = kept
        return _bins(df, edges, self.suffix, self.clamp)


class EqualWidth(Stage):
    def __init__(
        self,
        bins: int = 10,
        variables: Sequence[str] | None = None,
        whole: bool = False,
        clamp: bool = False,
        suffix: str = "_bin",
    ):
        self.bins, self.variables, self.whole, self.clamp, self.suffix = bins, variables, whole, clamp, suffix

    def fit(self, df: DataFrame) -> FittedBins:
        cols = list(self.variables or numeric_columns(df))
        row = df.agg(
            *[F.min(c).cast("double").alias(f"{c}__a") for c in cols],
            *[F.max(c).cast("double").alias(f"{c}__b") for c in cols],
        ).first()
        make = integer_edges if self.whole else even_edges
        return _bins(df, {c: make(row[f"{c}__a"], row[f"{c}__b"], self.bins) for c in cols}, self.suffix, self.clamp)


class GivenBuckets(Stage):
    """Domain buckets with labels."""

    def __init__(self, variable: str, edges: Sequence[float], labels: Sequence[str], suffix: str = "_bin"):
        if len(labels) != len(edges) - 1:
            raise ValueError("one label per bucket")
        self.variable, self.edges, self.labels, self.suffix = variable, list(edges), list(labels), suffix

    def fit(self, df: DataFrame) -> FittedBins:
        return _bins(df, {self.variable: self.edges}, self.suffix, False, self.labels)


class FittedTree(Fitted):
    """Value replaced by the leaf prediction of its interval."""

    def transform(self, df: DataFrame) -> DataFrame:
        rows = self.state.orderBy("variable", "position").collect()
        new = {}
        for v in self.variables:
            out = None
            mine = [r for r in rows if r["variable"] == v]
            for r in mine:
                hit = F.col(v).isNotNull() if r["hi"] == math.inf else F.col(v) <= r["hi"]
                out = F.when(hit, r["value"]) if out is None else out.when(hit, r["value"])
            new[f"{v}{self.params['suffix']}"] = out
        return df.withColumns(new)


class TreeBins(Stage):
    """One-column decision tree per variable, grown for all variables at once; depth by cross-validation.

    The tree predicts the target mean, which for a 0/1 target is the probability
    of 1. Its thresholds and leaf values are the state, so scoring needs no model.
    """

    def __init__(
        self,
        target: str,
        variables: Sequence[str] | None = None,
        depths: Sequence[int] = (1, 2, 3, 4),
        folds: int = 3,
        regression: bool = True,
        seed: int = 0,
        suffix: str = "_tree",
        key: Sequence[str] = (),
    ):
        self.target, self.variables, self.depths, self.folds = target, variables, list(depths), folds
        self.key = list(key)
        self.regression, self.seed, self.suffix = regression, seed, suffix

    def fit(self, df: DataFrame) -> FittedTree:
        cols = list(self.variables or numeric_columns(df, [self.target]))
        metric, choose = "mse" if self.regression else "auc", len(self.depths) > 1
        if choose:
            df = self._with_folds(df, cols)
        values = checkpointed(counted_values(df, cols, self.target, "_fold" if choose else None))
        leaves = grow(values, self.depths, self.folds if choose else None)
        whole = leaves.where(F.col("model") == WHOLE)
        if choose:
            whole = whole.join(best_depths(values, leaves, metric), ["variable", "depth"])
        state = settle(whole.select("variable", F.col("position").cast("int").alias("position"), "hi", "value"))
        return FittedTree({"variables": cols, "suffix": self.suffix}, state)

    def _with_folds(self, df: DataFrame, cols: Sequence[str]) -> DataFrame:
        """Folds that follow the key, or the content of the rows, not the partitioning."""
        data = df.where(F.col(self.target).isNotNull())
        if self.key:
            keys = {f"_key{i}": F.col(k) for i, k in enumerate(self.key)}
            ranked = hash_positions(data.select(self.target, *cols, *[c.alias(k) for k, c in keys.items()]), [], list(keys), self.seed, "_pos", "_size")
            return ranked.withColumn("_fold", F.pmod(F.col("_pos") - 1, F.lit(self.folds)).cast("int"))
        return data.withColumn("_fold", F.pmod(F.xxhash64(F.lit(self.seed), self.target, *cols), F.lit(self.folds)).cast("int"))
