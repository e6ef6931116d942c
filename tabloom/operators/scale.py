"""Scaling, transformations and constructed columns."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.maths import box_cox, inverse_normal, ln_or_null, power, reciprocal
from .core import held, numeric_columns
from .ordered import positions, quantiles
from .stages import Fitted, Stage


class FittedScale(Fitted):
    def transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for v, r in self.by_variable().items():
            moved = F.col(v) - F.lit(r["centre"])
            # a constant column becomes 0
            new[f"{v}{self.params['suffix']}"] = moved / F.lit(r["scale"]) if r["scale"] else moved
        return df.withColumns(new)

    def inverse(self, df: DataFrame) -> DataFrame:
        suffix = self.params["suffix"]
        return df.withColumns(
            {
                f"{v}{suffix}": F.col(f"{v}{suffix}") * F.lit(r["scale"] or 1.0) + F.lit(r["centre"])
                for v, r in self.by_variable().items()
            }
        )


class Scale(Stage):
    """``standard`` (x - mean) / population std, ``minmax`` to [0, 1] or ``robust``
    (x - median) / IQR."""

    def __init__(
        self, method: str = "standard", variables: Sequence[str] | None = None, suffix: str = ""
    ):
        if method not in ("standard", "minmax", "robust"):
            raise ValueError("method is 'standard', 'minmax' or 'robust'")
        self.method, self.variables, self.suffix = method, variables, suffix

    def fit(self, df: DataFrame) -> FittedScale:
        cols = list(self.variables or numeric_columns(df))
        if self.method == "robust":
            cut = quantiles(df, cols, [0.25, 0.5, 0.75])
            rows = [(c, cut[c][1], cut[c][2] - cut[c][0]) for c in cols]
        else:
            first, second = (F.avg, F.stddev_pop) if self.method == "standard" else (F.min, lambda c: F.max(c) - F.min(c))
            row = df.agg(
                *[first(c).cast("double").alias(f"{c}__a") for c in cols],
                *[second(c).cast("double").alias(f"{c}__b") for c in cols],
            ).first()
            rows = [(c, row[f"{c}__a"], row[f"{c}__b"]) for c in cols]
        state = df.sparkSession.createDataFrame(rows, "variable string, centre double, scale double")
        return FittedScale({"variables": cols, "suffix": self.suffix}, state)


def polynomial(df: DataFrame, cols: Sequence[str], degree: int = 2) -> DataFrame:
    """Bias plus all products of up to ``degree`` columns."""
    new: dict[str, Column] = {"poly_1": F.lit(1.0)}
    for d in range(1, degree + 1):
        for combo in combinations_with_replacement(cols, d):
            term = F.col(combo[0]).cast("double")
            for c in combo[1:]:
                term = term * F.col(c)
            new["poly_" + "_".join(combo)] = term
    return df.withColumns(new)


class FittedFormula(Fitted):
    def transform(self, df: DataFrame) -> DataFrame:
        kind, suffix = self.params["kind"], self.params["suffix"]
        formulas: dict[str, Callable[[Column, float], Column]] = {
            "log": lambda c, _: ln_or_null(c),
            "reciprocal": lambda c, _: reciprocal(c),
            "power": lambda c, k: power(c, k),
            "box_cox": lambda c, k: box_cox(c, k),
        }
        return df.withColumns(
            {f"{v}{suffix}": formulas[kind](F.col(v), r["parameter"]) for v, r in self.by_variable().items()}
        )


class Transform(Stage):
    """``log``, ``reciprocal``, ``power`` (exponent required) or ``box_cox`` (lambda
    fitted) over a column list. ``positive_only`` keeps to columns without values <= 0."""

    def __init__(
        self,
        kind: str,
        variables: Sequence[str] | None = None,
        exponent: float | None = None,
        positive_only: bool = False,
        suffix: str = "",
    ):
        if kind == "power" and exponent is None:
            raise ValueError("power needs an exponent")
        self.kind, self.variables, self.exponent = kind, variables, exponent
        self.positive_only, self.suffix = positive_only, suffix

    def fit(self, df: DataFrame) -> FittedFormula:
        cols = list(self.variables or numeric_columns(df))
        if self.positive_only:
            low = df.agg(*[F.min(c).alias(c) for c in cols]).first()
            cols = [c for c in cols if low[c] is not None and low[c] > 0]
        value: dict[str, float | None] = dict.fromkeys(cols, self.exponent)
        if self.kind == "box_cox":
            value = {c: box_cox_lambda(df, c) for c in cols}
        rows = [(c, value[c]) for c in cols]
        state = df.sparkSession.createDataFrame(rows, "variable string, parameter double")
        return FittedFormula({"variables": cols, "kind": self.kind, "suffix": self.suffix}, state)


def box_cox_profile(logs: DataFrame, lambdas: Sequence[float]) -> dict[float, float]:
    """Profile log-likelihood of each lambda from one grouped aggregate of z = ln x.

    Each row meets every lambda inside its task and is combined before the shuffle,
    which then carries one partial sum per lambda and task.
    """
    lam, z = F.col("lam"), F.col("z")
    # the variance of (y^lam - 1) / lam is that of y^lam over lam squared
    moved = F.when(lam == 0, z).otherwise(F.expm1(lam * z))
    sums = (
        logs.select("z", F.explode(F.array(*[F.lit(float(k)) for k in lambdas])).alias("lam"))
        .groupBy("lam")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("s"), F.var_pop(moved).alias("v"))
        .collect()
    )
    out = {}
    for r in sums:
        k, v = r["lam"], r["v"] / (r["lam"] ** 2 or 1.0)
        out[k] = -r["n"] / 2 * math.log(v) + (k - 1) * r["s"] if v > 0 else -math.inf
    return out


def box_cox_lambda(df: DataFrame, col: str, tolerance: float = 1e-6, points: int = 17) -> float:
    """Lambda of the largest likelihood, which has a single peak: a bracket that doubles until the peak lies inside, then
    rounds of grouped aggregates between the neighbours of the best point. 0 if a column has fewer than two
    different positive values, as every lambda is as likely then."""
    with held(df.where(F.col(col) > 0).select(F.ln(col).alias("z"))) as (logs,):
        low, high, mean = logs.agg(F.min("z"), F.max("z"), F.avg("z")).first()
        if low is None or low == high:
            return 0.0
        # a common scale keeps x^lambda in range; it shifts every likelihood equally
        centred = logs.select((F.col("z") - mean).alias("z"))
        most = 300 / max(high - mean, mean - low)  # beyond, a variance is out of the range of doubles
        reach = min(5.0, most)
        while True:
            step = 2 * reach / (points - 1)
            # -inf marks a variance that isn't above zero: no likelihood
            ll = box_cox_profile(centred, [-reach + i * step for i in range(points)])
            best = max(ll, key=lambda k: (ll[k], -abs(k)))
            if abs(best) < reach - step / 2 or reach >= most:
                break
            reach = min(2 * reach, most)
        while step > tolerance:
            start, step = best - step, 2 * step / (points - 1)
            ll = box_cox_profile(centred, [start + i * step for i in range(points)])
            best = max(ll, key=lambda k: (ll[k], -abs(k)))
        return best


def qq_table(df: DataFrame, col: str, key: str) -> DataFrame:
    """Sorted values beside normal quantiles at Filliben's plotting positions."""
    rows = positions(df.where(F.col(col).isNotNull()), [], col, [key])
    n, i = F.col("size"), F.col("pos")
    top = F.pow(F.lit(0.5), F.lit(1.0) / n)
    spot = F.when(i == n, top).when(i == 1, 1 - top).otherwise((i - F.lit(0.3175)) / (n + F.lit(0.365)))
    return rows.select(key, F.col("pos"), F.col(col).alias("sample"), inverse_normal(spot).alias("theoretical"))


def qq_fit(table: DataFrame) -> DataFrame:
    """Line through the Q-Q points and their correlation."""
    return table.agg(
        F.regr_slope("sample", "theoretical").alias("slope"),
        F.regr_intercept("sample", "theoretical").alias("intercept"),
        F.corr("sample", "theoretical").alias("r"),
    )
