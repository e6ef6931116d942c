"""Row and column operators: cleaning, recoding, sampling, unions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .core import numeric_columns, string_columns
from .ordered import hash_number


def sentinel_to_null(c: Column, *sentinels) -> Column:
    return F.when(~c.isin(*sentinels), c)


def out_of_range_to_null(c: Column, low=None, high=None) -> Column:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (c < low)
    if high is not None:
        bad = bad | (c > high)
    return F.when(~bad, c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def positive_part(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0)))


def lenient_number(c: Column) -> Column:
    return c.try_cast("double")


def recode(c: Column, mapping: Mapping, keep_unmapped: bool = False) -> Column:
    """Dictionary lookup; labels without an entry become null (or stay)."""
    out = None
    for old, new in mapping.items():
        out = F.when(c == F.lit(old), F.lit(new)) if out is None else out.when(c == F.lit(old), F.lit(new))
    if out is None:
        return c if keep_unmapped else F.lit(None)
    return out.otherwise(c) if keep_unmapped else out


def merge_labels(c: Column, variants: Sequence[str], label: str) -> Column:
    return F.when(c.isin(*variants), label).otherwise(c)


def columns_of_type(df: DataFrame, kind: str) -> list[str]:
    return numeric_columns(df) if kind == "number" else string_columns(df)


def drop_sparse_columns(df: DataFrame, max_null_share: float) -> DataFrame:
    """Keep the columns whose null share is below the limit."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if (shares[c] or 0.0) < max_null_share])


def sample_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = 0) -> DataFrame:
    """n rows chosen by a seeded hash of the key: the same rows on any partitioning."""
    return df.orderBy(hash_number(seed, *[F.col(k) for k in key]), *key).limit(n)


def sorted_columns(df: DataFrame) -> DataFrame:
    return df.select(*sorted(df.columns))


def stack_tables(*tables: DataFrame) -> DataFrame:
    """Union by name; columns a table lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def tagged_union(train: DataFrame, score: DataFrame, tag: str = "is_train") -> DataFrame:
    return stack_tables(train.withColumn(tag, F.lit(1)), score.withColumn(tag, F.lit(0)))


def new_columns(df: DataFrame, original: Sequence[str]) -> list[str]:
    known = set(original)
    return sorted(c for c in df.columns if c not in known)


def align_columns(df: DataFrame, columns: Sequence[str], fill=0) -> DataFrame:
    """Project to a fitted column list; absent columns get the fill value."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(fill).alias(c) for c in columns])
