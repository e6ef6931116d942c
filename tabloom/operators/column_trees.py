"""Decision trees on single columns, all columns and folds at once.

Rows are counted by (column, fold, value) in one pass. Running counts and target sums over the ordered values then hold
for every level: a node is an interval of running counts, so the best cut of each node is one aggregate, and the number
of jobs depends on the depth alone. A tree predicts the mean target; for a 0/1 target splits by variance are those by
Gini impurity. Null values and null targets are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .core import checkpointed
from .ordered import running_sums

#: Part of the model that is grown on all folds.
WHOLE = -1
#: Least reduction of squared error for a cut.
LEAST_GAIN = 1e-9


def counted_values(df: DataFrame, cols: Sequence[str], target: str, fold: str | None = None) -> DataFrame:
    """(variable, fold, x, n, s, s2): rows, sum and sum of squares of the target by value, all columns in one pass."""
    rows = df.select(
        F.col(target).cast("double").alias("_y"),
        (F.col(fold).cast("int") if fold else F.lit(0)).alias("_fold"),
        *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)],
    ).where("_y is not null")
    entries = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"_x{i}").alias("x")) for i, c in enumerate(cols)])
    long = rows.select("_y", F.col("_fold").alias("fold"), F.explode(entries).alias("e")).select("_y", "fold", "e.*")
    sums = [F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s"), F.sum(F.col("_y") * F.col("_y")).alias("s2")]
    return long.where("x is not null").groupBy("variable", "fold", "x").agg(*sums)


def _models(values: DataFrame, folds: int | None) -> DataFrame:
    """(variable, model, x, n, s): the values on which each model is grown; model f leaves out fold f."""
    if folds is None:
        models = F.array(F.lit(WHOLE))
    else:
        models = F.filter(F.sequence(F.lit(WHOLE), F.lit(folds - 1)), lambda k: k != F.col("fold"))
    spread = values.select("variable", F.explode(models).alias("model"), "x", "n", "s")
    return spread.groupBy("variable", "model", "x").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def _ends(cuts: str) -> tuple[Column, Column]:
    """(n, s) of the running sums where a value's node begins and ends."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s"))
    whole = F.struct(F.col("total_n").alias("n"), F.col("total_s").alias("s"))
    before = F.try_element_at(F.filter(cuts, lambda c: c["n"] < F.col("cum_n")), F.lit(-1))
    after = F.try_element_at(F.filter(cuts, lambda c: c["n"] >= F.col("cum_n")), F.lit(1))
    return F.coalesce(before, zero), F.coalesce(after, whole)


def grow(values: DataFrame, depths: Sequence[int], folds: int | None = None) -> DataFrame:
    """(variable, model, depth, position, hi, value, n): the leaves of each tree at each of the depths.

    `hi` is the middle between the values on both sides of a cut, infinity for the last leaf; of equally good cuts the
    smallest is taken."""
    keys = ["variable", "model"]
    ordered = running_sums(_models(values, folds), keys, "x", {"n": F.col("n"), "s": F.col("s")})
    ordered = checkpointed(ordered.select(*keys, "x", "n", "s", "cum_n", "cum_s", "total_n", "total_s"))
    cuts = ordered.select(*keys).distinct().withColumn("cuts", F.array().cast("array<struct<n:bigint,s:double>>"))
    cuts = checkpointed(cuts)
    by_depth = [cuts.withColumn("depth", F.lit(0))]
    for level in range(max(depths)):
        start, end = _ends("cuts")
        rows = ordered.join(cuts, keys).withColumns({"_a": start, "_b": end})
        ln, ls = F.col("cum_n") - F.col("_a.n"), F.col("cum_s") - F.col("_a.s")
        tn, ts = F.col("_b.n") - F.col("_a.n"), F.col("_b.s") - F.col("_a.s")
        after = ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln)
        best = F.max(F.struct(after.alias("after"), (-F.col("x")).alias("first"), F.col("cum_n").alias("n"), F.col("cum_s").alias("s"), (ts * ts / tn).alias("now")))
        found = rows.where(F.col("cum_n") < F.col("_b.n")).groupBy(*keys, F.col("_a.n").alias("node")).agg(best.alias("best"))
        found = found.where(F.col("best.after") > F.col("best.now") + LEAST_GAIN)
        new = found.groupBy(*keys).agg(F.collect_list(F.struct("best.n", "best.s")).alias("new"))  # a cut for each node
        joined = cuts.join(new, keys, "left")
        cuts = checkpointed(joined.select(*keys, F.array_sort(F.concat("cuts", F.coalesce("new", F.array().cast("array<struct<n:bigint,s:double>>")))).alias("cuts")))
        by_depth.append(cuts.withColumn("depth", F.lit(level + 1)))
    wanted = [by_depth[d] for d in sorted(set(depths))]
    tables = wanted[0]
    for more in wanted[1:]:
        tables = tables.unionByName(more)
    start, _ = _ends("cuts")
    placed = ordered.join(tables, keys).withColumn("_a", start)
    sums = [F.min("x").alias("low"), F.max("x").alias("high"), F.sum("n").alias("n"), F.sum("s").alias("s")]
    leaves = placed.groupBy(*keys, "depth", F.col("_a.n").alias("node")).agg(*sums)
    # the leaves of one tree
    w = Window.partitionBy(*keys, "depth").orderBy("node")
    hi = F.coalesce((F.col("high") + F.lead("low").over(w)) / 2, F.lit(float("inf")))
    position = (F.row_number().over(w) - 1).alias("position")
    return checkpointed(leaves.select(*keys, "depth", position, hi.alias("hi"), (F.col("s") / F.col("n")).alias("value"), "n"))


def leaf_value(ends: Column, x: Column) -> Column:
    """The value at x of a tree given as an ordered array of (hi, value)."""
    return F.get(F.transform(ends, lambda e: e["value"]), F.size(F.filter(ends, lambda e: e["hi"] < x)))


def _trees(leaves: DataFrame) -> DataFrame:
    """(variable, model, depth, ends): a tree in one row."""
    ends = F.sort_array(F.collect_list(F.struct("hi", "value")))
    return leaves.groupBy("variable", "model", "depth").agg(ends.alias("ends"))


def tree_scores(values: DataFrame, leaves: DataFrame, metric: str) -> DataFrame:
    """(variable, model, depth, value): "mse" or "auc" of each tree on the values whose fold is the model's."""
    keys = ["variable", "model", "depth"]
    rows = values.withColumnRenamed("fold", "model").join(_trees(leaves), ["variable", "model"])
    v = leaf_value(F.col("ends"), F.col("x"))
    sums = [F.sum(c).alias(c) for c in ("n", "s", "s2")]
    by_value = rows.select(*keys, v.alias("v"), "n", "s", "s2").groupBy(*keys, "v").agg(*sums)  # a row for each leaf
    if metric == "mse":
        v = F.col("v")
        return by_value.groupBy(*keys).agg((F.sum(F.col("s2") - 2 * v * F.col("s") + v * v * F.col("n")) / F.sum("n")).alias("value"))
    if metric != "auc":
        raise ValueError("trees on single columns are scored by mse or auc")
    below = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    negative = F.col("n") - F.col("s")
    ranked = by_value.select(*keys, "s", negative.alias("neg"), F.coalesce(F.sum(negative).over(below), F.lit(0.0)).alias("under"))
    won = F.sum(F.col("s") * (F.col("under") + F.col("neg") / 2))
    return ranked.groupBy(*keys).agg(F.try_divide(won, F.sum("s") * F.sum("neg")).alias("value"))


def best_depths(values: DataFrame, leaves: DataFrame, metric: str) -> DataFrame:
    """(variable, depth): the depth with the best mean score over the folds; of equal ones the smallest."""
    scores = tree_scores(values, leaves.where(F.col("model") != WHOLE), metric)
    mean = scores.groupBy("variable", "depth").agg(F.avg("value").alias("mean"))
    worth = F.col("mean") if metric == "auc" else -F.col("mean")
    return mean.groupBy("variable").agg(F.max_by("depth", F.struct(F.round(worth, 12), -F.col("depth"))).alias("depth"))
