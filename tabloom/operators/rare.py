"""Rare-label grouping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .core import label_counts, settle, string_columns
from .stages import Fitted, Stage, label_lookup


def label_shares(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(variable, label, n, share); null labels count in the total but are not listed."""
    counted = label_counts(df, cols).where("label is not null")
    return counted.withColumn("share", F.col("n") / df.agg(F.count(F.lit(1))).scalar())


def rare_labels(df: DataFrame, cols: Sequence[str], tol: float) -> DataFrame:
    return label_shares(df, cols).where(F.col("share") < tol)


def dominated_columns(df: DataFrame, cols: Sequence[str], fewer_than: int = 3) -> DataFrame:
    """Labels and shares of the columns with only a few labels."""
    shares = label_shares(df, cols)
    few = shares.groupBy("variable").agg(F.count(F.lit(1)).alias("n_labels")).where(F.col("n_labels") < fewer_than)
    return shares.join(few, "variable")


class FittedKeep(Fitted):
    """Labels outside the kept list, unseen ones included, become the replacement."""

    def transform(self, df: DataFrame) -> DataFrame:
        instead = self.params["replacement"]
        for v in self.variables:
            df = label_lookup(df, self.state, v, "_kept", "label")
            df = df.withColumn(
                v, F.when(F.col(v).isNotNull(), F.coalesce(F.col("_kept"), F.lit(instead[v])))
            ).drop("_kept")
        return df


class RareLabels(Stage):
    """Group labels whose share is below ``tol`` in columns with more than
    ``n_categories`` labels. ``into`` is a label, or None for the most frequent one."""

    def __init__(
        self, tol: float = 0.05, n_categories: int = 0, variables: Sequence[str] | None = None, into: str | None = "Rare"
    ):
        self.tol, self.n_categories, self.variables, self.into = tol, n_categories, variables, into

    def fit(self, df: DataFrame) -> FittedKeep:
        cols = list(self.variables or string_columns(df))
        shares = settle(label_shares(df, cols).select("variable", "label", "n", "share"))
        sizes = shares.groupBy("variable").agg(
            F.count(F.lit(1)).alias("n_labels"),
            F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("top"),
        ).collect()
        grouped = [r["variable"] for r in sizes if r["n_labels"] > self.n_categories]
        kept = shares.where(F.col("variable").isin(grouped) & (F.col("share") >= self.tol)).select("variable", "label")
        instead = {r["variable"]: (self.into if self.into is not None else r["top"]) for r in sizes}
        params = {"variables": [c for c in cols if c in grouped], "replacement": {c: instead[c] for c in grouped}}
        return FittedKeep(params, kept)
