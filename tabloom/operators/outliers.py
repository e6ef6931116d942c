"""Outlier bounds, capping and trimming."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .core import numeric_columns
from .ordered import quantiles
from .stages import Fitted, Stage


def tail_bounds(
    df: DataFrame, cols: Sequence[str], distribution: str, fold: float
) -> dict[str, tuple[float | None, float | None]]:
    """Low and high bound per column: mean +- fold std, or quartile fences."""
    if distribution == "gaussian":
        row = df.agg(
            *[F.avg(c).alias(f"{c}__m") for c in cols], *[F.stddev_samp(c).alias(f"{c}__s") for c in cols]
        ).first()
        ends = {c: (row[f"{c}__m"], row[f"{c}__s"]) for c in cols}
        return {c: (m - fold * s, m + fold * s) if s is not None else (None, None) for c, (m, s) in ends.items()}
    if distribution != "skewed":
        raise ValueError("distribution is 'gaussian' or 'skewed'")
    cut = quantiles(df, cols, [0.25, 0.75])
    return {
        c: (q1 - fold * (q3 - q1), q3 + fold * (q3 - q1)) if q1 is not None else (None, None)
        for c, (q1, q3) in cut.items()
    }


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Cap at constants; nulls stay null."""
    out = c
    if high is not None:
        out = F.when(c > F.lit(high), F.lit(high)).otherwise(out)
    if low is not None:
        out = F.when(c < F.lit(low), F.lit(low)).otherwise(out)
    return out


def outside(c: Column, low: float | None, high: float | None) -> Column:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (c < F.lit(low))
    if high is not None:
        bad = bad | (c > F.lit(high))
    return F.coalesce(bad, F.lit(False))


def outside_shares(df: DataFrame, bounds: Mapping[str, tuple]) -> DataFrame:
    """(variable, low, high, below_share, above_share)."""
    from .core import one_row_to_long, share

    aggs = []
    for c, (low, high) in bounds.items():
        aggs += [
            F.first(F.lit(low)).alias(f"{c}__low"),
            F.first(F.lit(high)).alias(f"{c}__high"),
            share(F.col(c) < low).alias(f"{c}__below_share"),
            share(F.col(c) > high).alias(f"{c}__above_share"),
        ]
    return one_row_to_long(df.agg(*aggs), list(bounds), ["low", "high", "below_share", "above_share"])


class FittedCap(Fitted):
    def transform(self, df: DataFrame) -> DataFrame:
        ends = self.by_variable()
        return df.withColumns({v: clip(F.col(v), r["low"], r["high"]) for v, r in ends.items()})

    def trim(self, df: DataFrame) -> DataFrame:
        """Drop rows outside the bounds instead of capping them."""
        bad = F.lit(False)
        for v, r in self.by_variable().items():
            bad = bad | outside(F.col(v), r["low"], r["high"])
        return df.where(~bad)


def _bounds_state(df: DataFrame, rows: list[tuple]) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, "variable string, low double, high double")


class Windsorizer(Stage):
    def __init__(
        self,
        distribution: str = "gaussian",
        tail: str = "right",
        fold: float = 3.0,
        variables: Sequence[str] | None = None,
    ):
        self.distribution, self.tail, self.fold = distribution, tail, fold
        self.variables = variables

    def fit(self, df: DataFrame) -> FittedCap:
        cols = list(self.variables or numeric_columns(df))
        ends = tail_bounds(df, cols, self.distribution, self.fold)
        rows = [
            (c, ends[c][0] if self.tail in ("left", "both") else None, ends[c][1] if self.tail in ("right", "both") else None)
            for c in cols
        ]
        return FittedCap({"variables": cols}, _bounds_state(df, rows))


class FixedCaps(Stage):
    """Caps given per column."""

    def __init__(self, high: Mapping[str, float] | None = None, low: Mapping[str, float] | None = None):
        self.high, self.low = dict(high or {}), dict(low or {})

    def fit(self, df: DataFrame) -> FittedCap:
        cols = list(dict.fromkeys([*self.high, *self.low]))
        rows = [
            (c, None if c not in self.low else float(self.low[c]), None if c not in self.high else float(self.high[c]))
            for c in cols
        ]
        return FittedCap({"variables": cols}, _bounds_state(df, rows))
