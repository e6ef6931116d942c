"""Explainability tables for any model given as a function that adds a score column."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .core import checkpointed
from .metrics import HIGHER_IS_BETTER, metric_value
from .models import in_parallel, rows_table
from .ordered import hash_positions, quantiles

Scorer = Callable[[DataFrame], DataFrame]


def shuffled(df: DataFrame, cols: Sequence[str], key: Sequence[str], seed: int) -> DataFrame:
    """Adds ``other``: the columns of the row drawn for this one by a seeded permutation.
    Rows are numbered in two hash orders and joined on the number."""
    here = hash_positions(df, [], key, 2 * seed + 1, "_pos", "_size").drop("_size")
    there = hash_positions(df.select(*key, *cols), [], key, 2 * seed + 2, "_pos", "_size")
    return here.join(there.select("_pos", F.struct(*cols).alias("other")), "_pos").drop("_pos")


def permutation_importance(
    scorer: Scorer,
    df: DataFrame,
    cols: Sequence[str],
    label: str,
    key: Sequence[str],
    metric: str,
    repeats: int = 3,
    seed: int = 0,
) -> DataFrame:
    """(feature, mean_drop, std_drop): how much the metric falls when one column is
    shuffled. One permutation join per repeat serves all features; its result is held
    while they are scored, so pass only the columns the scorer needs."""
    sign = 1.0 if HIGHER_IS_BETTER[metric] else -1.0
    df = checkpointed(df)
    base = metric_value(scorer(df), metric, label)
    rows = []
    for r in range(repeats):
        mixed = shuffled(df, cols, key, seed + r).persist()

        def drop(c: str) -> float:
            return sign * (base - metric_value(scorer(mixed.withColumn(c, F.col(f"other.{c}"))), metric, label))

        rows += [(c, r, float(v)) for c, v in zip(cols, in_parallel([lambda c=c: drop(c) for c in cols]))]
        mixed.unpersist()
    drops = rows_table(df, rows, "feature string, repeat int, drop double")
    return drops.groupBy("feature").agg(
        F.avg("drop").alias("mean_drop"), F.coalesce(F.stddev_samp("drop"), F.lit(0.0)).alias("std_drop")
    )


def grid_points(df: DataFrame, col: str, points: int = 10) -> list[float]:
    """Distinct percentiles of a column."""
    return sorted(set(quantiles(df, [col], [i / (points - 1) for i in range(points)])[col]))


def individual_effects(
    scorer: Scorer, df: DataFrame, col: str, grid: Sequence[float], key: Sequence[str], score: str = "score"
) -> DataFrame:
    """(key, grid value, score, centred): every row scored at every grid point; centred on
    the first point. A row has as many copies as there are grid points."""
    spread = df.withColumn(col, F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    curves = scorer(spread).select(*key, F.col(col).alias("value"), F.col(score).alias("score"))
    # a window holds the grid points of one row
    at_first = F.first("score").over(Window.partitionBy(*key).orderBy("value"))
    return curves.withColumn("centred", F.col("score") - at_first)


def partial_dependence(
    scorer: Scorer, df: DataFrame, col: str, grid: Sequence[float], score: str = "score"
) -> DataFrame:
    """(value, mean_score); copies are averaged map-side right after scoring."""
    spread = df.withColumn(col, F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    return scorer(spread).groupBy(F.col(col).alias("value")).agg(F.avg(score).alias("mean_score"))


def partial_dependence_2d(
    scorer: Scorer,
    df: DataFrame,
    cols: Sequence[str],
    grids: Sequence[Sequence[float]],
    score: str = "score",
) -> DataFrame:
    a, b = cols
    points = F.array(
        *[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x in grids[0] for y in grids[1]]
    )
    spread = df.withColumn("_at", F.explode(points)).withColumns({a: F.col("_at.x"), b: F.col("_at.y")}).drop("_at")
    return (
        scorer(spread)
        .groupBy(F.col(a).alias("value_a"), F.col(b).alias("value_b"))
        .agg(F.avg(score).alias("mean_score"))
    )


def linear_shapley(df: DataFrame, coefficients: dict[str, float], key: Sequence[str]) -> DataFrame:
    """Exact Shapley values of a linear model: (key, feature, value, phi)."""
    means = df.agg(*[F.avg(c).alias(c) for c in coefficients]).first()
    parts = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(c).cast("double").alias("value"),
            (F.lit(float(w)) * (F.col(c) - F.lit(means[c]))).alias("phi"),
        )
        for c, w in coefficients.items()
    ]
    return df.select(*key, F.explode(F.array(*parts)).alias("s")).select(*key, "s.*")


def sampled_shapley(
    scorer: Scorer,
    df: DataFrame,
    cols: Sequence[str],
    key: Sequence[str],
    background: DataFrame,
    background_key: Sequence[str],
    draws: int = 8,
    seed: int = 0,
    score: str = "score",
) -> DataFrame:
    """Shapley values of any model by sampled feature orders and background rows.

    Every row draws its own background rows from the whole background, following ones in a seeded order by a join on
    their positions (as many draws as rows use each once), and an order of the features with each. A draw turns a row into a chain of len(cols) + 1 hybrids that switch features from the background
    to the row one at a time. Scores enter twice with opposite signs, so summing per (key, feature) gives mean score
    steps, and the values of a row add up to its score minus the mean score of the background rows that it drew.
    """
    size = background.count()
    numbered = hash_positions(background, [], background_key, 2 * seed + 1, "_pos", "_size")
    numbered = numbered.select("_pos", F.struct(*[F.col(c).cast("double").alias(c) for c in cols]).alias("_base"))
    drawn = df.select(*key, *cols).withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    order = [F.xxhash64(F.lit(seed), F.lit(c), "_draw", *key) for c in cols]
    sorted_order = F.sort_array(F.array(*order))
    drawn = drawn.withColumns(
        {
            "_pos": F.pmod(F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(max(1, size))) + F.col("_draw"), F.lit(max(1, size))) + 1,
            "_rank": F.array(*[F.array_position(sorted_order, h) for h in order]),
        }
    )
    steps = F.sequence(F.lit(0), F.lit(len(cols)))
    hybrids = drawn.join(numbered, "_pos").withColumn("_step", F.explode(steps))
    own = F.array(*[F.col(c).cast("double") for c in cols])
    mixed = hybrids.withColumn("_own", own).withColumns(
        {
            c: F.when(F.col("_rank")[i] <= F.col("_step"), F.col(c).cast("double")).otherwise(F.col(f"_base.{c}"))
            for i, c in enumerate(cols)
        }
    )
    out = scorer(mixed)
    # the step that switches a feature in counts its score, the one before subtracts it
    credit = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col("_own")[i].alias("value"),
                F.when(F.col("_rank")[i] == F.col("_step"), F.col(score))
                .when(F.col("_rank")[i] == F.col("_step") + 1, -F.col(score))
                .alias("part"),
            )
            for i, c in enumerate(cols)
        ]
    )
    return (
        out.select(*key, F.explode(credit).alias("c"))
        .where("c.part is not null")
        .groupBy(*key, F.col("c.feature").alias("feature"))
        .agg(F.max("c.value").alias("value"), (F.sum("c.part") / draws).alias("phi"))
    )


def shapley_summary(phi: DataFrame) -> DataFrame:
    return phi.groupBy("feature").agg(
        F.avg(F.abs(F.col("phi"))).alias("mean_abs"), F.min("phi").alias("phi_min"), F.max("phi").alias("phi_max")
    )


def shapley_dependence(phi: DataFrame, feature: str, colour: str, key: Sequence[str]) -> DataFrame:
    """(key, value, phi, colour): one feature's effects beside another feature's value."""
    mine = phi.where(F.col("feature") == feature).select(*key, "value", "phi")
    other = phi.where(F.col("feature") == colour).select(*key, F.col("value").alias("colour"))
    return mine.join(other, list(key))


def raw_rate(df: DataFrame, feature: str, label: str) -> DataFrame:
    return df.groupBy(feature).agg(F.avg(label).alias("rate"), F.count(F.lit(1)).alias("n"))
