"""One-pass profiles that end in small tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from .core import label_counts, long_values, one_row_to_long, settle
from .gram import pair_moments
from .ordered import group_quantiles, group_stats, join_on, quantiles

EXPRS_PER_PASS = 400

# statistic name -> aggregate; `where` restricts an aggregate to a subset of rows
STATS = {
    "min": F.min,
    "max": F.max,
    "mean": F.avg,
    "sum": F.sum,
    "var": F.var_samp,
    "std": F.stddev_samp,
    "count": F.count,
    "nunique": F.count_distinct,
    "approx_nunique": F.approx_count_distinct,
}


def stat_exprs(
    spec: Mapping[str, Sequence[str]], prefix: str = "", where: Column | None = None
) -> list[Column]:
    """Aggregates named <prefix><column>_<stat> from {column: [stat, ...]}.

    With ``where`` they cover a subset of the rows, so subsets need no second scan.
    """
    out = []
    for col, stats in spec.items():
        c = F.col(col) if where is None else F.when(where, F.col(col))
        for s in stats:
            agg = F.count_if(F.lit(True) if where is None else where) if s == "size" else STATS[s](c)
            out.append(agg.alias(f"{prefix}{col}_{s}"))
    return out


def moment_parts(cols: Sequence[str]) -> list[Column]:
    """Count, mean and summed squared deviations of each column, as <c>__n, <c>__mean, <c>__m2: the state of a
    variance that `merged_moments` merges over any number of roll-ups."""
    out = []
    for c in cols:
        x = F.col(c).cast("double")
        parts = {"n": F.count(x), "mean": F.avg(x), "m2": F.count(x) * F.var_pop(x)}
        out += [e.alias(f"{c}__{name}") for name, e in parts.items()]
    return out


def merged_moments(parts: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """The parts of groups merged to one row per key, in the same form.

    Squared deviations add up with n (mean - common mean)^2 for each group, so nothing cancels where values are large
    beside their spread. The common means are pre-aggregated and joined back; ``parts`` is read twice."""

    def weighted(c: str) -> Column:
        return F.try_divide(F.sum(F.col(f"{c}__n") * F.col(f"{c}__mean")), F.sum(f"{c}__n"))

    names = [f"{c}__{part}" for c in cols for part in ("n", "mean", "m2")]
    means = parts.groupBy(key).agg(*[weighted(c).alias(f"{c}__common") for c in cols])
    out = []
    for c in cols:
        gap = F.col(f"{c}__mean") - F.col(f"{c}__common")
        out += [
            F.sum(f"{c}__n").alias(f"{c}__n"),
            F.first(f"{c}__common").alias(f"{c}__mean"),
            F.sum(F.col(f"{c}__m2") + F.col(f"{c}__n") * gap * gap).alias(f"{c}__m2"),
        ]
    return parts.select(key, *names).join(means, key).groupBy(key).agg(*out)


def sample_variance(c: str) -> Column:
    """Variance of a column from its merged parts; null for fewer than two values."""
    return F.when(F.col(f"{c}__n") > 1, F.col(f"{c}__m2") / (F.col(f"{c}__n") - 1))


def label_list(df: DataFrame, col: str, most: int = 1000) -> list:
    """The labels of a column in order, as they become columns; a column with more than `most` is refused."""
    found = sorted(r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"column {col!r} has more than {most} labels")
    return found


def share_exprs(col: str, labels: Sequence[str], prefix: str = "", where: Column | None = None) -> list[Column]:
    """Share of each label per group: the mean of its indicator, without building it."""
    hit = [F.when(F.col(col) == v, 1.0).otherwise(0.0) for v in labels]
    if where is not None:
        hit = [F.when(where, h) for h in hit]
    return [F.avg(h).alias(f"{prefix}{col}_{v}_mean") for h, v in zip(hit, labels)]


def value_counts(df: DataFrame, col: str, dropna: bool = True) -> DataFrame:
    rows = df.where(F.col(col).isNotNull()) if dropna else df
    counted = rows.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.col("n") / df.agg(F.count(F.lit(1))).scalar())


def null_table(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(variable, n_null, null_share) for every column from one aggregate."""
    cols = list(cols or df.columns)
    row = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"{c}__n_null") for c in cols],
        *[F.avg(F.col(c).isNull().cast("int")).alias(f"{c}__null_share") for c in cols],
    )
    return one_row_to_long(row, cols, ["n_null", "null_share"])


def null_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return null_table(df, cols).where("n_null > 0").orderBy(F.desc("null_share"), "variable")


def missing_vs_target(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    return df.groupBy(target).agg(*[F.avg(F.col(c).isNull().cast("int")).alias(f"{c}_null") for c in cols])


def target_median_by_missing(df: DataFrame, col: str, target: str) -> DataFrame:
    flagged = df.select(F.col(col).isNull().cast("int").alias("missing"), target)
    return group_quantiles(flagged, ["missing"], target, {"target_median": 0.5})


def missing_dependency(df: DataFrame, given: str, other: str) -> DataFrame:
    """Shares of the labels of ``other`` where ``given`` is missing and where it is present."""
    gone, there = F.col(given).isNull(), F.col(given).isNotNull()
    counts = df.groupBy(other).agg(F.count_if(gone).alias("_g"), F.count_if(there).alias("_t"))
    n_gone = df.agg(F.count_if(gone)).scalar()
    n_there = df.agg(F.count_if(there)).scalar()
    return counts.select(
        other,
        F.try_divide(F.col("_g"), n_gone).alias("share_if_missing"),
        F.try_divide(F.col("_t"), n_there).alias("share_if_present"),
    )


def complete_share(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull()
    return df.agg(F.avg(whole.cast("int")).alias("complete_share"))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(variable, n, mean, std, min, q25, q50, q75, max)."""
    cut = quantiles(df, cols, [0.25, 0.5, 0.75])
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [
            F.count(x).alias(f"{c}__n"),
            F.avg(x).alias(f"{c}__mean"),
            F.stddev_samp(x).alias(f"{c}__std"),
            F.min(x).alias(f"{c}__min"),
            *[F.first(F.lit(v).cast("double")).alias(f"{c}__{q}") for q, v in zip(("q25", "q50", "q75"), cut[c])],
            F.max(x).alias(f"{c}__max"),
        ]
    return one_row_to_long(df.agg(*aggs), list(cols), ["n", "mean", "std", "min", "q25", "q50", "q75", "max"])


def quantile_table(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int | None = None
) -> DataFrame:
    """(variable, prob, value); exact, or within n / accuracy ranks in one pass."""
    if accuracy is None:
        cut = quantiles(df, cols, probs)
    else:
        arr = F.array(*[F.lit(float(p)) for p in probs])
        row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), arr, accuracy).alias(c) for c in cols]).first()
        cut = {c: row[c] if row[c] is not None else [None] * len(probs) for c in cols}
    rows = [(c, float(p), v) for c in cols for p, v in zip(probs, cut[c])]
    return df.sparkSession.createDataFrame(rows, "variable string, prob double, value double")


def modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(variable, mode, n): the most frequent label, smallest on ties. Values are
    counted across tasks first, so no task holds the whole value set of a column."""
    counted = label_counts(df, cols).where("label is not null")
    return counted.groupBy("variable").agg(
        F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("mode"), F.max("n").alias("n")
    )


def numeric_modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    counted = (
        long_values(df, cols).where("value is not null").groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.groupBy("variable").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"), F.max("n").alias("n")
    )


def ranges(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    row = df.agg(*[(F.max(c) - F.min(c)).cast("double").alias(f"{c}__range") for c in cols])
    return one_row_to_long(row, list(cols), ["range"])


def correlation(a: str, b: str) -> Column:
    """Pearson's r of the rows that have both values; null where one of them is constant."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = (F.when(both, F.col(c).cast("double")) for c in (a, b))
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y)))


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, r) for every unordered column pair, pairwise complete, all of them from one scan; null where a column is
    constant."""
    r = pair_moments(df, cols).correlations()
    rows = [(a, b, None if r[i, j] != r[i, j] else float(r[i, j])) for (i, a), (j, b) in combinations(enumerate(cols), 2)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def cluster_report(df: DataFrame, cluster: str, cols: Sequence[str]) -> DataFrame:
    """Size and median of each feature per cluster."""
    if cluster not in df.columns:
        raise ValueError(f"no cluster column {cluster!r}")
    cuts = {f"{c}_median": (c, 0.5) for c in cols}
    return group_stats(df.select(cluster, *cols), [cluster], [F.count(F.lit(1)).alias("size")], cuts)


def cardinality(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct values per column; null counts as one value."""
    return label_counts(df, cols).groupBy("variable").agg(
        F.count(F.lit(1)).alias("n_labels"), F.max(F.col("label").isNull().cast("int")).alias("has_null")
    )


def label_target_profile(df: DataFrame, label: str, target: str) -> DataFrame:
    means = [F.count(F.lit(1)).alias("n"), F.avg(target).alias("target_mean")]
    return group_stats(df.select(label, target), [label], means, {"target_median": (target, 0.5)})


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """(bin, lo, hi, n): equal-width bins, the last one closed; empty bins included."""
    ends = df.agg(F.min(col).cast("double").alias("a"), F.max(col).cast("double").alias("b")).first()
    lo, hi = ends["a"], ends["b"]
    if lo is None:
        raise ValueError(f"column {col!r} has no values")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    x = F.col(col).cast("double")
    at = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(x.isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spots = df.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(lo) + F.col("id") * width).alias("lo"),
        (F.lit(lo) + (F.col("id") + 1) * width).alias("hi"),
    )
    return spots.join(counts, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def box_stats(df: DataFrame, cols: Sequence[str], fold: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends inside fold x IQR, outliers per column."""
    cut = quantiles(df, cols, [0.25, 0.5, 0.75])
    aggs = []
    for c in cols:
        q1, q2, q3 = cut[c]
        x = F.col(c).cast("double")
        if q1 is None:  # no values
            low = high = F.lit(None).cast("double")
        else:
            low, high = F.lit(q1 - fold * (q3 - q1)), F.lit(q3 + fold * (q3 - q1))
        inside = (x >= low) & (x <= high)
        aggs += [F.first(F.lit(v).cast("double")).alias(f"{c}__{n}") for n, v in (("q25", q1), ("q50", q2), ("q75", q3))]
        aggs += [
            F.min(F.when(inside, x)).alias(f"{c}__whisker_low"),
            F.max(F.when(inside, x)).alias(f"{c}__whisker_high"),
            F.count_if((x < low) | (x > high)).alias(f"{c}__n_outlier"),
        ]
    names = ["q25", "q50", "q75", "whisker_low", "whisker_high", "n_outlier"]
    return one_row_to_long(df.agg(*aggs), list(cols), names)


def group_box_stats(
    df: DataFrame, keys: Sequence[str], col: str, fold: float = 1.5
) -> DataFrame:
    """Box statistics per group: quartiles are joined back, then one more aggregate."""
    cuts = group_quantiles(df, keys, col, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    wide = join_on(df.select(*keys, F.col(col).cast("double").alias("_x")), cuts, list(keys))
    low = F.col("q25") - fold * (F.col("q75") - F.col("q25"))
    high = F.col("q75") + fold * (F.col("q75") - F.col("q25"))
    inside = (F.col("_x") >= low) & (F.col("_x") <= high)
    return wide.groupBy(*keys, "q25", "q50", "q75").agg(
        F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outlier"),
    )


def split_shares(df: DataFrame, label: str, split: str = "split", train: str = "train") -> DataFrame:
    """Share of each label inside train and inside the rest."""
    is_train = F.col(split) == train
    counts = df.groupBy(label).agg(F.count_if(is_train).alias("_a"), F.count_if(~is_train).alias("_b"))
    n_train = df.agg(F.count_if(is_train)).scalar()
    n_test = df.agg(F.count_if(~is_train)).scalar()
    return counts.select(
        label,
        F.try_divide(F.col("_a"), n_train).alias("train_share"),
        F.try_divide(F.col("_b"), n_test).alias("test_share"),
    )


def group_sizes(df: DataFrame, key: str) -> DataFrame:
    """How many keys have 1, 2, 3, ... rows."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("group_size"))
    return sizes.groupBy("group_size").agg(F.count(F.lit(1)).alias("n_groups"))


def variable_types(
    df: DataFrame, target: str, key: str, year_marks: Sequence[str] = ("Yr", "Year"), discrete_below: int = 20
) -> dict[str, list[str]]:
    """Categorical, year, discrete and continuous column names."""
    from .core import numeric_columns, string_columns

    numeric = numeric_columns(df, [target, key])
    years = [c for c in numeric if any(m in c for m in year_marks)]
    rest = [c for c in numeric if c not in years]
    counts: dict[str, int] = {}
    if rest:
        rows = settle(cardinality(df, rest)).collect()
        counts = {r["variable"]: r["n_labels"] - r["has_null"] for r in rows}
    discrete = [c for c in rest if counts[c] < discrete_below]
    return {
        "categorical": string_columns(df, [target, key]),
        "year": years,
        "discrete": discrete,
        "continuous": [c for c in rest if c not in discrete],
    }
