"""Missing-data stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .core import checkpointed, numeric_columns, settle, string_columns
from .ordered import hash_number, hash_positions, quantiles
from .outliers import tail_bounds
from .profile import modes, null_table, numeric_modes
from .stages import Fitted, Stage


def _state(df: DataFrame, rows: list[tuple]) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, "variable string, number double, label string")


class FittedFill(Fitted):
    """Nulls replaced by one value per variable, with an optional indicator column."""

    def transform(self, df: DataFrame) -> DataFrame:
        fills = self.by_variable()
        new = {}
        for v, row in fills.items():
            if v not in df.columns:
                continue
            if self.params.get("flag"):
                new[f"{v}_na"] = F.col(v).isNull().cast("int")
            value = row["number"] if row["label"] is None else row["label"]
            if value is not None:
                new[v] = F.coalesce(F.col(v), F.lit(value))
        return df.withColumns(new)


class MeanMedian(Stage):
    def __init__(self, method: str = "mean", variables: Sequence[str] | None = None):
        if method not in ("mean", "median"):
            raise ValueError("method is 'mean' or 'median'")
        self.method, self.variables = method, variables

    def fit(self, df: DataFrame) -> FittedFill:
        cols = list(self.variables or numeric_columns(df))
        if self.method == "median":
            mid = {c: v[0] for c, v in quantiles(df, cols, [0.5]).items()}
        else:
            mid = df.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict()
        return FittedFill({"variables": cols}, _state(df, [(c, mid[c], None) for c in cols]))


class FixedNumber(Stage):
    def __init__(self, number: float, variables: Sequence[str] | None = None):
        self.number, self.variables = float(number), variables

    def fit(self, df: DataFrame) -> FittedFill:
        cols = list(self.variables or numeric_columns(df))
        return FittedFill({"variables": cols}, _state(df, [(c, self.number, None) for c in cols]))


class EndOfTail(Stage):
    """Fill with a value at the far end: mean +- fold std, or the IQR fence."""

    def __init__(
        self,
        distribution: str = "gaussian",
        tail: str = "right",
        fold: float = 3.0,
        variables: Sequence[str] | None = None,
    ):
        self.distribution, self.tail, self.fold = distribution, tail, fold
        self.variables = variables

    def fit(self, df: DataFrame) -> FittedFill:
        cols = list(self.variables or numeric_columns(df))
        ends = tail_bounds(df, cols, self.distribution, self.fold)
        at = 0 if self.tail == "left" else 1
        return FittedFill({"variables": cols}, _state(df, [(c, ends[c][at], None) for c in cols]))


class FrequentLabel(Stage):
    def __init__(self, variables: Sequence[str] | None = None):
        self.variables = variables

    def fit(self, df: DataFrame) -> FittedFill:
        cols = list(self.variables or string_columns(df))
        state = modes(df, cols).select("variable", F.lit(None).cast("double").alias("number"), F.col("mode").alias("label"))
        return FittedFill({"variables": cols}, settle(state))


class MissingLabel(Stage):
    def __init__(self, variables: Sequence[str] | None = None, label: str = "Missing"):
        self.variables, self.label = variables, label

    def fit(self, df: DataFrame) -> FittedFill:
        cols = list(self.variables or string_columns(df))
        return FittedFill({"variables": cols}, _state(df, [(c, None, self.label) for c in cols]))


class NumericMode(Stage):
    """Mode of a numeric column, optionally with the indicator column."""

    def __init__(self, variables: Sequence[str], flag: bool = True):
        self.variables, self.flag = variables, flag

    def fit(self, df: DataFrame) -> FittedFill:
        cols = list(self.variables)
        state = numeric_modes(df, cols).select(
            "variable", F.col("mode").alias("number"), F.lit(None).cast("string").alias("label")
        )
        return FittedFill({"variables": cols, "flag": self.flag}, settle(state))


class FittedFlag(Fitted):
    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"{v}_na": F.col(v).isNull().cast("int") for v in self.variables})


class MissingFlag(Stage):
    def __init__(self, variables: Sequence[str]):
        self.variables = variables

    def fit(self, df: DataFrame) -> FittedFlag:
        cols = list(self.variables)
        return FittedFlag({"variables": cols}, _state(df, [(c, None, None) for c in cols]))


class FittedDonors(Fitted):
    """Nulls replaced by a donor drawn with a hash of the row key (and of the seed
    column, if any), so a row always gets the same donor."""

    def transform(self, df: DataFrame) -> DataFrame:
        key, seed, row_seed = self.params["key"], self.params["seed"], self.params["row_seed"]
        totals = self.params["donors"]
        for v in self.variables:
            m = totals.get(v, 0)
            if not m:
                continue
            drawn = [F.col(row_seed)] if row_seed else [F.col(k) for k in key]
            pick = F.pmod(hash_number(seed, F.lit(v), *drawn), F.lit(m)) + 1
            # filled rows get a negative number: no match, and no single hot join key
            spread = -F.pmod(F.xxhash64(*[F.col(k) for k in key]), F.lit(m)) - 1
            donors = self.state.where(F.col("variable") == v).select(
                "donor", F.col("value").cast(df.schema[v].dataType).alias("_value")
            )
            df = (
                df.withColumn("donor", F.when(F.col(v).isNull(), pick).otherwise(spread))
                .join(donors, "donor", "left")
                .withColumn(v, F.coalesce(F.col(v), F.col("_value")))
                .drop("donor", "_value")
            )
        return df


class RandomSample(Stage):
    """Fill with values sampled from the fitted rows. ``row_seed`` names a column
    whose value alone decides the draw."""

    def __init__(self, variables: Sequence[str], key: Sequence[str], seed: int = 0, row_seed: str | None = None):
        self.variables, self.key, self.seed, self.row_seed = variables, key, seed, row_seed

    def fit(self, df: DataFrame) -> FittedDonors:
        key = list(self.key)
        cols = list(self.variables)
        state = None
        for v in cols:
            have = df.where(F.col(v).isNotNull()).select(*key, F.col(v).cast("string").alias("value"))
            part = hash_positions(have, [], key, self.seed).select(
                F.lit(v).alias("variable"), F.col("pos").alias("donor"), "value"
            )
            state = part if state is None else state.unionByName(part)
        state = checkpointed(state)
        donors = {r["variable"]: r["n"] for r in state.groupBy("variable").agg(F.count(F.lit(1)).alias("n")).collect()}
        params = {"variables": cols, "key": key, "seed": self.seed, "row_seed": self.row_seed, "donors": donors}
        return FittedDonors(params, state)


def null_only_in_score(train: DataFrame, score: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns complete in train that hold nulls in the scoring table."""
    a = {r["variable"]: r["n_null"] for r in null_table(train, cols).collect()}
    b = {r["variable"]: r["n_null"] for r in null_table(score, cols).collect()}
    return [c for c in cols if a[c] == 0 and b[c] > 0]
