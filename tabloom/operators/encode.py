"""Categorical encoders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .core import label_counts, settle, string_columns
from .ordered import positions
from .stages import Fitted, Stage, label_lookup

FLOOR = 1e-5


class FittedOneHot(Fitted):
    def transform(self, df: DataFrame) -> DataFrame:
        new: dict[str, Column] = {}
        for r in self.state.orderBy("variable", "position").collect():
            v, label = r["variable"], r["label"]
            hit = F.col(v).isNull() if label is None else F.col(v).cast("string") == label
            new[f"{v}_{'nan' if label is None else label}"] = F.coalesce(hit, F.lit(False)).cast("int")
        return df.withColumns(new).drop(*self.variables) if self.params["drop_source"] else df.withColumns(new)


class OneHot(Stage):
    """Indicator columns. ``top`` keeps the most frequent labels, ``drop`` leaves out
    the 'first' or 'last' label, ``null_column`` adds an indicator of nulls."""

    def __init__(
        self,
        variables: Sequence[str] | None = None,
        top: int | None = None,
        drop: str | None = None,
        null_column: bool = False,
        drop_source: bool = False,
    ):
        self.variables, self.top, self.drop = variables, top, drop
        self.null_column, self.drop_source = null_column, drop_source

    def fit(self, df: DataFrame) -> FittedOneHot:
        cols = list(self.variables or string_columns(df))
        counts = label_counts(df, cols).where("label is not null")
        if self.top is not None:
            rows = []
            for c in cols:
                best = counts.where(F.col("variable") == c).orderBy(F.desc("n"), "label").limit(self.top)
                rows += sorted(best.collect(), key=lambda r: r["label"])
        else:
            rows = counts.orderBy("variable", "label").collect()
        out = []
        for c in cols:
            labels = [r["label"] for r in rows if r["variable"] == c]
            if self.drop == "first":
                labels = labels[1:]
            elif self.drop == "last":
                labels = labels[:-1]
            if self.null_column:
                labels.append(None)
            out += [(c, i, label) for i, label in enumerate(labels)]
        state = df.sparkSession.createDataFrame(out, "variable string, position int, label string")
        return FittedOneHot({"variables": cols, "drop_source": self.drop_source}, state)


class FittedLabels(Fitted):
    """Labels replaced by their fitted number; unseen ones by the fallback or null."""

    def transform(self, df: DataFrame) -> DataFrame:
        fallback, suffix = self.params.get("fallback"), self.params.get("suffix", "")
        for v in self.variables:
            other = None if fallback is None else F.lit(float(fallback))
            df = label_lookup(df, self.state, v, f"{v}{suffix}", "value", other)
        return df


class GivenOrder(Stage):
    """Numbers given by a mapping."""

    def __init__(self, mapping: Mapping[str, Mapping[str, float]], suffix: str = ""):
        self.mapping, self.suffix = mapping, suffix

    def fit(self, df: DataFrame) -> FittedLabels:
        rows = [(v, label, float(x)) for v, m in self.mapping.items() for label, x in m.items()]
        state = df.sparkSession.createDataFrame(rows, "variable string, label string, value double")
        return FittedLabels({"variables": list(self.mapping), "suffix": self.suffix}, state)


class LabelNumbers(Stage):
    """Encode labels by one statistic of the fitted rows.

    ``count`` and ``frequency`` use label frequencies, ``integer`` the label order,
    ``mean`` the target mean, ``ordered`` the rank of the target mean, ``ratio``
    p / (1 - p) and ``woe`` its logarithm, both sides floored.
    """

    METHODS = ("count", "frequency", "integer", "mean", "ordered", "ratio", "woe")

    def __init__(
        self,
        method: str,
        variables: Sequence[str] | None = None,
        target: str | None = None,
        fallback: float | None = None,
        suffix: str = "",
    ):
        if method not in self.METHODS:
            raise ValueError(f"method is one of {self.METHODS}")
        if target is None and method in ("mean", "ordered", "ratio", "woe"):
            raise ValueError(f"{method} needs a target")
        self.method, self.variables, self.target = method, variables, target
        self.fallback, self.suffix = fallback, suffix

    def fit(self, df: DataFrame) -> FittedLabels:
        cols = list(self.variables or string_columns(df, [self.target] if self.target else []))
        params = {"variables": cols, "fallback": self.fallback, "suffix": self.suffix}
        return FittedLabels(params, settle(self._values(df, cols).select("variable", "label", "value")))

    def _values(self, df: DataFrame, cols: list[str]) -> DataFrame:
        if self.method in ("count", "frequency", "integer"):
            counts = label_counts(df, cols).where("label is not null")
            if self.method == "count":
                return counts.withColumn("value", F.col("n").cast("double"))
            if self.method == "frequency":
                return counts.withColumn("value", F.col("n") / df.agg(F.count(F.lit(1))).scalar())
            ranked = positions(counts, ["variable"], "label")
            return ranked.withColumn("value", (F.col("pos") - 1).cast("double"))
        means = (
            df.select(F.col(self.target).cast("double").alias("_y"), *[F.col(c).cast("string").alias(c) for c in cols])
            .unpivot(["_y"], cols, "variable", "label")
            .where("label is not null")
            .groupBy("variable", "label")
            .agg(F.avg("_y").alias("p"))
        )
        if self.method == "mean":
            return means.withColumn("value", F.col("p"))
        if self.method == "ordered":
            ranked = positions(means, ["variable"], "p", ["label"])
            return ranked.withColumn("value", (F.col("pos") - 1).cast("double"))
        odds = F.greatest(F.col("p"), F.lit(FLOOR)) / F.greatest(1 - F.col("p"), F.lit(FLOOR))
        return means.withColumn("value", F.ln(odds) if self.method == "woe" else odds)

