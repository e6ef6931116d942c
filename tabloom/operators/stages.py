"""Fit/transform stages. Fitting is an aggregation whose result, a state table,
is all a fitted stage knows; applying it is a projection or a lookup join."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_KINDS: dict[str, type["Fitted"]] = {}


class Fitted:
    """State table plus the stage parameters needed to apply it."""

    def __init__(self, params: dict, state: DataFrame):
        self.params = params
        self.state = state

    def __init_subclass__(cls) -> None:
        _KINDS[cls.__name__] = cls

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    @property
    def variables(self) -> list[str]:
        return self.params["variables"]

    def by_variable(self) -> dict[str, dict]:
        """State of at most one row per variable."""
        return {r["variable"]: r.asDict() for r in self.state.collect()}

    def save(self, path: str) -> str:
        spark = self.state.sparkSession
        self.state.write.parquet(f"{path}/state")
        kept = [(type(self).__name__, json.dumps(self.params))]
        spark.createDataFrame(kept, "kind string, params string").coalesce(1).write.parquet(f"{path}/params")
        return path


def load_fitted(spark: SparkSession, path: str) -> Fitted:
    row = spark.read.parquet(f"{path}/params").first()
    return _KINDS[row["kind"]](json.loads(row["params"]), spark.read.parquet(f"{path}/state"))


class Stage:
    def fit(self, df: DataFrame) -> Fitted:
        raise NotImplementedError

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class Chain(Stage):
    """Stages fitted one after the other, each on the output of the previous one."""

    def __init__(self, stages: Sequence[Stage]):
        self.stages = list(stages)

    def fit(self, df: DataFrame) -> "FittedChain":
        fitted = []
        # each fit is an aggregate over its own columns, so the scan stays pruned;
        # a caller whose table is costly to derive can hold it around this call
        for stage in self.stages:
            done = stage.fit(df)
            fitted.append(done)
            df = done.transform(df)
        return FittedChain(fitted)


class FittedChain:
    def __init__(self, fitted: Sequence[Fitted]):
        self.fitted = list(fitted)

    def transform(self, df: DataFrame) -> DataFrame:
        for f in self.fitted:
            df = f.transform(df)
        return df

    def save(self, path: str) -> str:
        for i, f in enumerate(self.fitted):
            f.save(f"{path}/{i:03d}")
        return path

    @staticmethod
    def load(spark: SparkSession, path: str, n: int) -> "FittedChain":
        return FittedChain([load_fitted(spark, f"{path}/{i:03d}") for i in range(n)])


def label_lookup(
    df: DataFrame, state: DataFrame, variable: str, out: str, value: str = "value", fallback: Column | None = None
) -> DataFrame:
    """Left join of the (variable, label, value) state on one column."""
    part = state.where(F.col("variable") == variable).select(
        F.col("label").alias("_label"), F.col(value).alias("_value"), F.lit(1).alias("_hit")
    )
    joined = df.join(part, F.col(variable).cast("string") == F.col("_label"), "left")
    found = F.col("_value")
    if fallback is not None:
        found = F.when(F.col("_hit").isNotNull(), found).otherwise(fallback)
    return joined.withColumn(out, found).drop("_label", "_value", "_hit")
