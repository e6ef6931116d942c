"""Shared helpers: size checks, fitted-state tables, lineage cuts."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in skip]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]


def shared_dir(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir; a temporary one
    only where none is set and all tasks run on this machine."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        folder = sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tabloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def held(*dfs: DataFrame) -> Iterator[tuple[DataFrame, ...]]:
    """Keep narrow tables in memory (spilling to disk) while they are read several times."""
    kept = tuple(d.persist(StorageLevel.MEMORY_AND_DISK) for d in dfs)
    try:
        for d in kept:
            d.count()  # fill the cache once, before parallel fits would each compute it
        yield kept
    finally:
        for d in kept:
            d.unpersist()


def settle(df: DataFrame) -> DataFrame:
    """Run a fit once: its result is written to the checkpoint folder and read from there."""
    return checkpointed(df)


def label_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(variable, label, n) for several label columns in one pass; null labels kept."""
    return (
        df.select(*[F.col(c).cast("string").alias(c) for c in cols])
        .unpivot([], list(cols), "variable", "label")
        .groupBy("variable", "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def long_values(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., variable, value) with value as double."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(keep), list(cols), "variable", "value"
    )


def one_row_to_long(row_df: DataFrame, cols: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """Turn a one-row aggregate with columns `<c>__<stat>` into one row per column."""
    parts = [
        F.struct(F.lit(c).alias("variable"), *[F.col(f"{c}__{s}").alias(s) for s in stats]) for c in cols
    ]
    return row_df.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def share(cond: Column) -> Column:
    """Share of rows for which the condition holds (null counts as false)."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def total(cond: Column) -> Column:
    return F.count_if(cond)
