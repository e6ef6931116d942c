"""Ranks, running totals, rolling statistics and period groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

from .ordered import CHUNK_ROWS, join_on, positions, running_sums, with_halo


def running_by_period(df: DataFrame, key: str, ts: str, value: str, period: str) -> DataFrame:
    """Dense rank of the period and running sum/count/avg/min/max per key, where all
    rows of a period share one value (the SQL default frame).

    The window runs over one row per key and period, never over the raw rows of a
    hot key; the result is joined back to the rows.
    """
    rows = df.withColumn(period, F.date_trunc(period, F.col(ts)))
    cells = rows.groupBy(key, period).agg(
        F.sum(value).alias("_s"), F.count(value).alias("_c"), F.min(value).alias("_lo"), F.max(value).alias("_hi")
    )
    w = Window.partitionBy(key).orderBy(period)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    ranked = cells.select(
        key,
        period,
        F.dense_rank().over(w).alias("dense_rank"),
        F.sum("_s").over(upto).alias("running_sum"),
        F.sum("_c").over(upto).alias("running_count"),
        F.try_divide(F.sum("_s").over(upto), F.sum("_c").over(upto)).alias("running_avg"),
        F.min("_lo").over(upto).alias("running_min"),
        F.max("_hi").over(upto).alias("running_max"),
    )
    return join_on(rows, ranked, [key, period])


def tick(df: DataFrame, col: str) -> Column:
    """Numeric order of a time, date or number column."""
    kind = df.schema[col].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(col).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(col))
    return F.col(col)


def in_order(
    df: DataFrame, by: Sequence[str], order: str, reach: int, ties: Sequence[str] = (), chunk: int = CHUNK_ROWS
) -> tuple[DataFrame, WindowSpec]:
    """Rows with pos/size and a window that may look back ``reach`` rows.

    The window is confined to chunks of at most ``chunk`` + reach rows; rows with
    own = 0 are copies of a neighbouring chunk and must be filtered out afterwards.
    """
    ranked = positions(df.withColumn("_tick", tick(df, order)), by, "_tick", ties).drop("_tick")
    chunked = with_halo(ranked, by, reach, max(chunk, reach + 1))
    return chunked, Window.partitionBy(*by, "chunk").orderBy("pos")


def rolling(
    df: DataFrame, by: Sequence[str], order: str, value: str, width: int, chunk: int = CHUNK_ROWS
) -> DataFrame:
    """Mean and std over the last ``width`` rows; null until the window is full."""
    rows, w = in_order(df, by, order, width - 1, chunk=chunk)
    frame = w.rowsBetween(-(width - 1), 0)
    full = F.count(value).over(frame) == width
    return (
        rows.withColumn("rolling_mean", F.when(full, F.avg(value).over(frame)))
        .withColumn("rolling_std", F.when(full, F.stddev_samp(value).over(frame)))
        .where("own = 1")
        .drop("own", "chunk", "size")
    )


def lag_pairs(
    df: DataFrame, by: Sequence[str], order: str, value: str, lag: int = 1, chunk: int = CHUNK_ROWS
) -> DataFrame:
    rows, w = in_order(df, by, order, lag, chunk=chunk)
    return rows.withColumn("lagged", F.lag(value, lag).over(w)).where("own = 1").drop("own", "chunk", "pos", "size")


def cumulative_share(
    df: DataFrame, value: str, key: str, by: Sequence[str] = ()
) -> DataFrame:
    """Share of the total and its running sum, largest first."""
    run = running_sums(df, by, value, {"v": F.col(value)}, descending=True, ties=[key])
    return run.select(
        *df.columns,
        F.try_divide(F.col(value), F.col("total_v")).alias("share"),
        F.try_divide(F.col("cum_v"), F.col("total_v")).alias("cum_share"),
    )


def rows_to_reach(df: DataFrame, value: str, key: str, threshold: float) -> DataFrame:
    """How many of the largest rows it takes for the cumulative share to pass the threshold."""
    run = running_sums(
        df, [], value, {"v": F.col(value), "n": F.lit(1)}, descending=True, ties=[key]
    )
    crossed = F.col("cum_v") / F.col("total_v") > threshold
    return run.agg(F.min(F.when(crossed, F.col("cum_n"))).alias("n_needed"))


def resample(df: DataFrame, ts: str, period: str, aggs: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.date_trunc(period, F.col(ts)).alias("period")).agg(
        *[e.alias(n) for n, e in aggs.items()]
    )


def recency(df: DataFrame, key: str, ts: str, as_of: Column) -> DataFrame:
    last = df.groupBy(key).agg(F.max(ts).alias("last_seen"))
    return last.withColumn("recency_days", F.datediff(as_of, F.col("last_seen")))


def top_labels(df: DataFrame, col: str, k: int) -> DataFrame:
    counted = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), col).limit(k)
