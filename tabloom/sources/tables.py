"""Scans and sinks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from ..operators.core import shared_dir


def table(spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def delimited(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    schema: StructType | str | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Delimited text with a header. Types are inferred unless a schema is given."""
    reader = spark.read.option("header", True).option("sep", sep)
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    return df.select(*columns) if columns else df


def first_rows(df: DataFrame, n: int, key: Sequence[str]) -> DataFrame:
    """The n first rows in key order (a file order does not exist in Spark)."""
    return df.orderBy(*key).limit(n)


def inline(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def drop_unnamed(df: DataFrame) -> DataFrame:
    """Drop index columns that were written without a name."""
    gone = [c for c in df.columns if c == "" or c == "_c0" or c.startswith("Unnamed")]
    return df.drop(*gone)


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of a missing number: NaN of float columns becomes null."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (FloatType, DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def profile(df: DataFrame) -> DataFrame:
    """One row per column: position, type, rows, nulls."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(c) for c in df.columns]
    )
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("variable"),
            F.lit(dtype).alias("dtype"),
            F.col("_rows").alias("n_rows"),
            (F.col("_rows") - F.col(name)).alias("n_null"),
        )
        for i, (name, dtype) in enumerate(df.dtypes)
    ]
    return counts.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> str:
    df.write.option("header", True).option("sep", sep).mode("errorifexists").csv(path)
    return path


def write_table(df: DataFrame, path: str) -> str:
    df.write.mode("errorifexists").parquet(path)
    return path


def save_features(spark: SparkSession, names: Sequence[str], path: str) -> str:
    rows = [(i, n) for i, n in enumerate(names)]
    spark.createDataFrame(rows, "position int, feature string").coalesce(1).write.parquet(path)
    return path


def load_features(spark: SparkSession, path: str) -> list[str]:
    return [r["feature"] for r in spark.read.parquet(path).orderBy("position").collect()]
