"""Order-dependent building blocks that never put an unbounded group in one task.

Running sums and row positions range-partition the rows by (group, order, ties), so that a hot group and a frequent
value are cut like any other rows; sums of the ranges are added up over that small table, and only rows of one range are
sorted together. Exact quantiles are read off running counts of distinct values, all columns at once. There is one form
for every size. Null order values come last in either direction, NaN counts as the largest number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .core import checkpointed, long_values

# Rows of a series that one task sorts when a window looks back a few rows.
CHUNK_ROWS = 100_000


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join whose keys match null with null."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_r_{k}")
    cond = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys] or [F.lit(True)]
    return left.join(renamed, cond, "inner").drop(*[f"_r_{k}" for k in keys])


def _prefixed(df: DataFrame, by: Sequence[str], bucket: str, sums: dict[str, Column], order: Sequence[Column]) -> DataFrame:
    """Running sums in (by, order), where bucket is a monotone coarse form of the order."""
    totals = df.groupBy(*by, bucket).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    # at most one row per range and group
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    prefix = totals.select(
        *by,
        bucket,
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_p_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(whole).alias(f"total_{n}") for n in sums],
    )
    inside = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = join_on(df, prefix, [*by, bucket])
    return joined.withColumns(
        {f"cum_{n}": F.col(f"_p_{n}") + F.sum(c).over(inside) for n, c in sums.items()}
    ).drop(*[f"_p_{n}" for n in sums], bucket)


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    sums: dict[str, Column],
    descending: bool = False,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Add ``cum_<n>`` (inclusive, in order) and ``total_<n>`` per group.

    Rows must be unique on (by, order, ties). The ranges are written to the checkpoint folder, so that the
    number a row has got stays the same however often it is read.
    """
    keys = [F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last(), *[F.col(t).asc() for t in ties]]
    ranged = df.repartitionByRange(*[F.col(b).asc() for b in by], *keys).withColumn("_range", F.spark_partition_id())
    return _prefixed(checkpointed(ranged), by, "_range", sums, keys)


def positions(
    df: DataFrame, by: Sequence[str], order: str, ties: Sequence[str] = (), descending: bool = False, pos: str = "pos", size: str = "size"
) -> DataFrame:
    """Add ``pos`` (1-based rank in the order) and ``size`` (rows of the group), under names that the table has not got."""
    out = running_sums(df, by, order, {"_one": F.lit(1)}, descending, ties)
    return out.withColumnsRenamed({"cum__one": pos, "total__one": size})


def running_by_position(
    df: DataFrame, by: Sequence[str], sums: dict[str, Column], chunk: int = CHUNK_ROWS, pos: str = "pos"
) -> DataFrame:
    """Running sums of rows that already carry their position: chunks of positions are
    the ranges, so nothing has to be counted or sampled."""
    ranged = df.withColumn("_range", F.floor((F.col(pos) - 1) / chunk))
    return _prefixed(ranged, by, "_range", sums, [F.col(pos)])


def hash_positions(
    df: DataFrame, by: Sequence[str], key: Sequence[str], seed: int = 0, pos: str = "pos", size: str = "size"
) -> DataFrame:
    """Number rows 1..n per group in a seeded pseudo-random order that does not
    depend on partitioning."""
    tagged = df.withColumn("_h", hash_number(seed, *[F.col(k) for k in key]))
    return positions(tagged, by, "_h", key, pos=pos, size=size).drop("_h")


def hash_number(seed: int, *parts: Column) -> Column:
    """52 bits that are a function of the seed and of the values' text alone: the first 13 hex digits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def hash_uniform(key: Sequence[str], seed: int = 0) -> Column:
    """Seeded uniform in [0, 1) that is a function of the key alone."""
    return hash_number(seed, *[F.col(k) for k in key]) / F.lit(float(1 << 52))


# ---------------------------------------------------------------- quantiles


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact linearly interpolated quantiles of whole columns, all of them in one pass."""
    cols, probs = list(cols), list(probs)
    named = {f"q{i}": p for i, p in enumerate(probs)}
    rows = group_quantiles(long_values(df, cols), ["variable"], "value", named).collect()
    found = {r["variable"]: [r[n] for n in named] for r in rows}
    return {c: found.get(c, [None] * len(probs)) for c in cols}


def group_quantiles(df: DataFrame, keys: Sequence[str], col: str, probs: dict[str, float]) -> DataFrame:
    """(keys..., one column per named prob) of exact interpolated quantiles.

    Rows are first counted per (keys, value), so a hot group is spread over its values, and then ranked with
    running sums.
    """
    keys = list(keys)
    # nulls count 0, so a group holding only nulls stays with null quantiles
    counted = (
        df.select(*keys, F.col(col).cast("double").alias("_v")).groupBy(*keys, "_v").agg(F.count("_v").alias("_n"))
    )
    ranked = running_sums(counted, keys, "_v", {"c": F.col("_n")})
    aggs = []
    for name, p in probs.items():
        spot = F.lit(float(p)) * (F.col("total_c") - 1)
        for end, at in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            here = (F.col("cum_c") - F.col("_n") <= at) & (at < F.col("cum_c"))
            aggs.append(F.max(F.when(here, F.col("_v"))).alias(f"_{name}_{end}"))
    picked = ranked.groupBy(*keys).agg(F.max("total_c").alias("_m"), *aggs)
    exprs = []
    for name, p in probs.items():
        spot = F.lit(float(p)) * (F.col("_m") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        exprs.append(F.when(lo == hi, lo).otherwise(lo + (spot - F.floor(spot)) * (hi - lo)).alias(name))
    return picked.select(*keys, *exprs)


def group_stats(
    df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], cuts: dict[str, tuple[str, float]]
) -> DataFrame:
    """Aggregates and named (column, prob) quantiles per group: the aggregates joined with the ranked quantiles."""
    out = df.groupBy(*keys).agg(*aggs)
    for col in dict.fromkeys(c for c, _ in cuts.values()):
        named = {n: p for n, (c, p) in cuts.items() if c == col}
        out = join_on(out, group_quantiles(df, keys, col, named), keys)
    return out


# ---------------------------------------------------------------- neighbours in order


def with_halo(df: DataFrame, by: Sequence[str], width: int, chunk: int = CHUNK_ROWS, pos: str = "pos") -> DataFrame:
    """Cut each ordered series into chunks of ``chunk`` positions and copy the last
    ``width`` rows of a chunk in front of the next one (``own`` = 0 for copies).
    Windows over (by, chunk) that look back up to ``width`` rows are then exact."""
    home = F.floor((F.col(pos) - 1) / chunk).cast("long")
    into_next = F.pmod(F.col(pos) - 1, F.lit(chunk)) >= chunk - width
    homes = F.when(into_next, F.array(home, home + 1)).otherwise(F.array(home))
    return df.select("*", F.explode(homes).alias("chunk")).withColumn("own", (F.col("chunk") == home).cast("int"))
