"""Cross products of many columns in one scan: correlations, normal equations, and linear models of all folds and alphas.

Each task turns its rows into blocks, takes x'x with the masks of the values that are there, and merges the blocks'
moments pair by pair (count, means, squared deviations, co-deviations), so nothing cancels and one pass is enough. Tasks
are merged in groups until one state is left; only that, a few numbers for each pair of columns, reaches the driver.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .core import checkpointed
from .trees import matrix

BLOCK_ROWS = 8192
#: States that one task merges.
FAN_IN = 32


@dataclass
class PairMoments:
    """For columns i, j over the rows that have both: count, mean and squared deviations of i, co-deviations."""

    n: np.ndarray
    mean: np.ndarray
    m2: np.ndarray
    c: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> PairMoments:
        """Of a block of rows; NaN is a missing value."""
        there = ~np.isnan(x)
        mask = there.astype(float)
        n = mask.T @ mask
        with np.errstate(invalid="ignore", divide="ignore"):
            filled = np.where(there, x, 0.0)
            shift = np.nan_to_num(filled.sum(axis=0) / there.sum(axis=0))
            low, high = np.where(there, x, np.inf).min(axis=0, initial=np.inf), np.where(there, x, -np.inf).max(axis=0, initial=-np.inf)
        shift = np.where(low == high, low, shift)  # a constant column has no deviation at all
        z = np.where(there, x - shift, 0.0)
        total, k = z.T @ mask, np.maximum(n, 1)
        m2 = np.maximum((z * z).T @ mask - total * total / k, 0.0)
        return PairMoments(n, np.where(n > 0, shift[:, None] + total / k, 0.0), m2, z.T @ z - total * total.T / k)

    def merged(self, other: PairMoments) -> PairMoments:
        n = self.n + other.n
        weight = np.where(n > 0, self.n * other.n / np.maximum(n, 1), 0.0)
        gap = np.where(weight > 0, other.mean - self.mean, 0.0)
        mean = np.where(self.n > 0, self.mean + gap * other.n / np.maximum(n, 1), other.mean)
        return PairMoments(n, mean, self.m2 + other.m2 + gap * gap * weight, self.c + other.c + gap * gap.T * weight)

    def correlations(self) -> np.ndarray:
        """Pearson's r of each pair; NaN where a column is constant or there are no common rows."""
        with np.errstate(invalid="ignore", divide="ignore"):
            scale = np.sqrt(self.m2 * self.m2.T)
            return np.where(scale > 0, np.clip(self.c / scale, -1, 1), np.nan)


def _blob(states: dict[int, PairMoments], part: int) -> pa.RecordBatch:
    keys = sorted(states)
    blobs = [pickle.dumps(states[k]) for k in keys]
    return pa.RecordBatch.from_pydict({"fold": pa.array(keys, pa.int32()), "part": pa.array([part] * len(keys), pa.int64()), "state": pa.array(blobs, pa.binary())})


def fold_moments(df: DataFrame, cols: Sequence[str], fold: str | None = None, complete: bool = False) -> dict[int, PairMoments]:
    """The moments of each fold (0 without a fold column) in one scan; `complete` leaves out rows with a null."""
    rows = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)], (F.col(fold).cast("int") if fold else F.lit(0)).alias("fold"))
    names = [f"x{i}" for i in range(len(cols))]
    schema = "fold int, part long, state binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, PairMoments] = {}
        for batch in batches:
            x = matrix(batch, names)
            folds = batch["fold"].to_numpy(zero_copy_only=False)
            if complete:
                kept = ~np.isnan(x).any(axis=1)
                x, folds = x[kept], folds[kept]
            for k in np.unique(folds):
                own = x[folds == k]
                for at in range(0, len(own), BLOCK_ROWS):
                    made = PairMoments.of(own[at : at + BLOCK_ROWS])
                    states[int(k)] = states[int(k)].merged(made) if int(k) in states else made
        if states:
            yield _blob(states, TaskContext.get().partitionId())

    def join(table: pa.Table) -> pa.Table:
        order = np.argsort(table["part"].to_numpy())
        states = [pickle.loads(b) for b in table["state"].take(pa.array(order)).to_pylist()]
        out = states[0]
        for more in states[1:]:
            out = out.merged(more)
        return pa.Table.from_batches([_blob({table["fold"][0].as_py(): out}, table["part"][0].as_py() // FAN_IN)])

    states = checkpointed(rows.mapInArrow(run, schema))
    parts = states.agg(F.max("part")).first()[0]
    while parts is not None and parts >= FAN_IN:
        grouped = states.withColumn("group", F.floor(F.col("part") / FAN_IN)).groupBy("fold", "group")
        states = checkpointed(grouped.applyInArrow(join, schema))
        parts //= FAN_IN
    out: dict[int, PairMoments] = {}
    for r in sorted(states.collect(), key=lambda r: (r["fold"], r["part"])):  # FAN_IN states of each fold at most
        made = pickle.loads(r["state"])
        out[r["fold"]] = out[r["fold"]].merged(made) if r["fold"] in out else made
    return out


def empty_moments(k: int) -> PairMoments:
    return PairMoments(*[np.zeros((k, k)) for _ in range(4)])


def pair_moments(df: DataFrame, cols: Sequence[str], complete: bool = False) -> PairMoments:
    return fold_moments(df, cols, None, complete).get(0, empty_moments(len(cols)))


# ---------------------------------------------------------------- linear models


@dataclass
class Linear:
    """y = intercept + x . slopes"""

    features: list[str]
    intercept: float
    slopes: np.ndarray

    def prediction(self):
        out = F.lit(float(self.intercept))
        for c, b in zip(self.features, self.slopes):
            out = out + F.lit(float(b)) * F.col(c)
        return out


def lasso_slopes(xx: np.ndarray, xy: np.ndarray, alpha: float, start: np.ndarray | None = None, rounds: int = 10_000, tolerance: float = 1e-12) -> np.ndarray:
    """Coordinate descent of 1/2 b'xx b - xy'b + alpha |b|_1 (cross products divided by the number of rows)."""
    b = np.zeros(len(xy)) if start is None else start.copy()
    for _ in range(rounds):
        largest = 0.0
        for j in range(len(b)):
            if xx[j, j] <= 0:
                continue
            rest = xy[j] - xx[j] @ b + xx[j, j] * b[j]
            new = math.copysign(max(abs(rest) - alpha, 0.0), rest) / xx[j, j]
            largest = max(largest, abs(new - b[j]) * math.sqrt(xx[j, j]))
            b[j] = new
        if largest <= tolerance * max(1.0, math.sqrt(float(np.abs(xy).max(initial=0.0)))):
            break
    return b


def linear_of(moments: PairMoments, features: Sequence[str], kind: str, alpha: float, start: np.ndarray | None = None) -> Linear:
    """The model of (features..., target) moments. The lasso minimises sum of squares / 2n + alpha |b|_1, ridge sum of
    squares + alpha |b|^2; no columns are scaled and the intercept is free."""
    k, n = len(features), float(moments.n[0, 0])
    xx, xy = moments.c[:k, :k], moments.c[:k, k]
    if n == 0:
        slopes = np.zeros(k)
    elif kind == "lasso" and alpha > 0:
        slopes = lasso_slopes(xx / n, xy / n, alpha, start)
    elif kind in ("linear", "lasso", "ridge"):
        extra = alpha if kind == "ridge" else 0.0
        slopes = np.linalg.pinv(xx + extra * np.eye(k), hermitian=True) @ xy
    else:
        raise ValueError("a linear model is linear, ridge or lasso")
    means = np.diag(moments.mean)
    return Linear(list(features), float(means[k] - means[:k] @ slopes), slopes)


def mean_squared_error(moments: PairMoments, model: Linear) -> float:
    """Of the rows behind the moments, without a scan."""
    k, n, b = len(model.features), float(moments.n[0, 0]), model.slopes
    means = np.diag(moments.mean)
    spread = moments.c[k, k] - 2 * b @ moments.c[:k, k] + b @ moments.c[:k, :k] @ b
    return float(max(spread, 0.0) / n + (means[k] - model.intercept - means[:k] @ b) ** 2)


def alphas_for(moments: PairMoments, count: int = 100, ratio: float = 1e-3) -> list[float]:
    """A falling geometric series from the least alpha that leaves no slope."""
    k = len(moments.n) - 1
    top = float(np.abs(moments.c[:k, k]).max(initial=0.0) / max(float(moments.n[0, 0]), 1.0))
    return [top * ratio ** (i / max(1, count - 1)) for i in range(count)]


def cross_validated(df: DataFrame, features: Sequence[str], target: str, fold: str, alphas: Sequence[float] | None = None, kind: str = "lasso") -> tuple[list[tuple[float, float, float]], Linear, float]:
    """([(alpha, mean, std of the folds' squared errors)], the model of the best alpha on all rows, that alpha).

    One scan gives the moments of each fold; a fold's training moments are the other folds' merged, and its error follows
    from its own moments, so alphas and folds cost no further pass. Of equally good alphas the largest is taken."""
    parts = fold_moments(df, [*features, target], fold, complete=True)
    whole = empty_moments(len(features) + 1)
    for m in parts.values():
        whole = whole.merged(m)
    chosen = sorted(alphas if alphas is not None else alphas_for(whole), reverse=True)
    errors = np.zeros((len(chosen), len(parts)))
    for f, k in enumerate(sorted(parts)):
        train = empty_moments(len(features) + 1)
        for other in sorted(parts):
            if other != k:
                train = train.merged(parts[other])
        start = None
        for a, alpha in enumerate(chosen):  # each alpha starts from the one before
            model = linear_of(train, features, kind, alpha, start)
            start = model.slopes
            errors[a, f] = mean_squared_error(parts[k], model)
    rows = [(float(a), float(e.mean()), float(e.std(ddof=1)) if len(parts) > 1 else 0.0) for a, e in zip(chosen, errors)]
    best = chosen[int(np.argmin([r[1] for r in rows]))] if rows and parts else 0.0
    return rows, linear_of(whole, features, kind, best), best
