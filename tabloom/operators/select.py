"""Feature selection: every step returns column names or a small score table;
data is only ever narrowed by a final select."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.ml.base import Estimator
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import tails
from .column_trees import WHOLE, counted_values, grow, tree_scores
from .core import held, label_counts, settle
from .discretise import EqualFrequency, add_bins
from .explain import permutation_importance
from .metrics import HIGHER_IS_BETTER, auc_of_counts, metric_value
from .models import cv_scores, few_tasks, early_stopped, evaluate, fit, fold_values, importances, in_parallel, learner, rows_table, scored
from .ordered import hash_uniform
from .profile import EXPRS_PER_PASS, correlation, correlations
from .scale import Scale


def _one_row(df: DataFrame, exprs: list) -> dict:
    """Many aggregates as a few passes of bounded width."""
    out: dict = {}
    for i in range(0, len(exprs), EXPRS_PER_PASS):
        out |= df.agg(*exprs[i : i + EXPRS_PER_PASS]).first().asDict()
    return out


# ---------------------------------------------------------------- column filters


def constant_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Numeric columns without spread."""
    row = _one_row(df, [(F.min(c).eqNullSafe(F.max(c))).alias(c) for c in cols])
    return [c for c in cols if row[c]]


def constant_labels(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns with a single value, null counting as a value."""
    one = [
        (
            (F.min(F.col(c).cast("string")).eqNullSafe(F.max(F.col(c).cast("string"))))
            & ((F.count(c) == F.count(F.lit(1))) | (F.count(c) == 0))
        ).alias(c)
        for c in cols
    ]
    row = _one_row(df, one)
    return [c for c in cols if row[c]]


def low_variance_columns(df: DataFrame, cols: Sequence[str], threshold: float = 0.01) -> list[str]:
    row = _one_row(df, [(F.var_pop(c) <= threshold).alias(c) for c in cols])
    return [c for c in cols if row[c]]


def predominant_shares(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(variable, share) of the most frequent value of each column."""
    top = label_counts(df, cols).groupBy("variable").agg(F.max("n").alias("n"))
    return top.select("variable", (F.col("n") / df.agg(F.count(F.lit(1))).scalar()).alias("share"))


def predominant_columns(df: DataFrame, cols: Sequence[str], threshold: float = 0.998) -> list[str]:
    found = {r["variable"] for r in predominant_shares(df, cols).where(F.col("share") > threshold).collect()}
    return [c for c in cols if c in found]


def duplicate_columns(df: DataFrame, cols: Sequence[str], key: Sequence[str]) -> list[tuple[str, str]]:
    """(kept, duplicate) pairs. One order-free hash per column finds candidates in a single pass: a sum, so that equal
    rows don't cancel. A second pass compares all columns of one hash with each other, value by value."""
    keys = [F.col(k) for k in key]
    types = dict(df.dtypes)

    def hashed(c: str) -> Column:
        return F.sum(F.xxhash64(*keys, F.coalesce(F.col(c).cast("string"), F.lit("\0"))).cast("decimal(38,0)")).alias(c)

    row = _one_row(df, [hashed(c) for c in cols])
    alike: dict[tuple, list[str]] = {}
    for c in cols:
        alike.setdefault((types[c], row[c]), []).append(c)
    pairs = [(a, b) for group in alike.values() for i, b in enumerate(group) for a in group[:i]]
    if not pairs:
        return []
    differ = _one_row(
        df, [F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias(f"d{i}") for i, (a, b) in enumerate(pairs)]
    )
    kept: dict[str, str] = {}
    for i, (a, b) in enumerate(pairs):
        if differ[f"d{i}"] == 0 and a not in kept:
            kept.setdefault(b, a)
    return [(kept[c], c) for c in cols if c in kept]


def _pairs(df: DataFrame, cols: Sequence[str]) -> dict[tuple[str, str], float]:
    return {(r["a"], r["b"]): r["r"] for r in correlations(df, cols).collect()}


def correlated_columns(df: DataFrame, cols: Sequence[str], threshold: float = 0.8) -> list[str]:
    """The later column of each pair whose absolute correlation exceeds the limit."""
    gone = {b for (_, b), r in _pairs(df, cols).items() if r is not None and abs(r) > threshold}
    return [c for c in cols if c in gone]


def collinear_table(df: DataFrame, cols: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """(drop, because_of, r) above the diagonal of the correlation matrix."""
    rows = [
        (b, a, float(r)) for (a, b), r in sorted(_pairs(df, cols).items()) if r is not None and abs(r) > threshold
    ]
    return rows_table(df, rows, "drop string, because_of string, r double")


def correlated_groups(df: DataFrame, cols: Sequence[str], threshold: float = 0.8) -> list[tuple[str, list[str]]]:
    """(head, members) blocks: features are visited by their strongest correlation, and
    one that no earlier block holds heads a block of everything correlated with it.
    Perfect correlation (1) is left out."""
    mates: dict[str, dict[str, float]] = {}
    for (a, b), r in _pairs(df, cols).items():
        if r is not None and threshold <= abs(r) < 1:
            mates.setdefault(a, {})[b] = abs(r)
            mates.setdefault(b, {})[a] = abs(r)
    blocks: list[tuple[str, list[str]]] = []
    taken: set[str] = set()
    for c in sorted(mates, key=lambda f: (-max(mates[f].values()), f)):
        if c not in taken:
            blocks.append((c, sorted(mates[c])))
            taken |= {c, *mates[c]}
    return blocks


def best_of_groups(
    df: DataFrame, groups: Sequence[Sequence[str]], label: str, estimator: Estimator
) -> DataFrame:
    """(group, feature, importance) by a forest fitted inside each group."""
    tasks = [lambda g=g: importances(fit(df, g, label, estimator), g) for g in groups]
    rows = [
        (i, f, float(v)) for i, part in enumerate(in_parallel(tasks)) for f, v in sorted(part, key=lambda p: (-p[1], p[0]))
    ]
    return rows_table(df, rows, "group int, feature string, importance double")


# ---------------------------------------------------------------- univariate scores


def mutual_information(
    df: DataFrame, cols: Sequence[str], target: str, bins: int = 10, regression: bool = False
) -> DataFrame:
    """Plug-in mutual information (nats) of equal-frequency bins with the class, or
    with bins of the target for regression."""
    cut = EqualFrequency(bins, list(cols) + ([target] if regression else []), "drop", suffix="_b").fit(df)
    binned = cut.transform(df)
    goal = F.col(f"{target}_b" if regression else target).cast("string")
    cells = (
        binned.select(goal.alias("goal"), *[F.col(f"{c}_b").cast("string").alias(c) for c in cols])
        .unpivot(["goal"], list(cols), "variable", "bin")
        .where("bin is not null and goal is not null")
        .groupBy("variable", "bin", "goal")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    per_bin, per_goal = Window.partitionBy("variable", "bin"), Window.partitionBy("variable", "goal")
    whole = Window.partitionBy("variable")
    n = F.sum("n").over(whole)
    term = F.col("n") / n * F.ln(F.col("n") * n / (F.sum("n").over(per_bin) * F.sum("n").over(per_goal)))
    return cells.select("variable", term.alias("t")).groupBy("variable").agg(F.sum("t").alias("mutual_information"))


def best_k(scores: DataFrame, value: str, k: int, name: str = "variable") -> DataFrame:
    return scores.orderBy(F.desc(value), name).limit(k)


def best_percent(scores: DataFrame, value: str, percent: float, name: str = "variable") -> DataFrame:
    return best_k(scores, value, max(1, int(scores.count() * percent / 100)), name)


def chi2_scores(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Class sums of each non-negative feature against class shares."""
    per_class = df.groupBy(target).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).cast("double").alias(c) for c in cols]
    )
    with held(per_class) as (classes,):
        total = classes.agg(F.count(F.lit(1)).alias("_k"), F.sum("_n").alias("_n"), *[F.sum(c).alias(c) for c in cols]).first()
        stats = []
        for c in cols:
            expected = F.lit(float(total[c] or 0.0)) * F.col("_n") / F.lit(float(total["_n"]))
            gap = F.col(c) - expected
            stats.append(F.coalesce(F.sum(F.try_divide(gap * gap, expected)), F.lit(0.0)).alias(c))
        row = _one_row(classes, stats)
    out = [(c, row[c], tails.chi2_upper(row[c], total["_k"] - 1)) for c in cols]
    return rows_table(df, out, "variable string, chi2 double, p double")


def anova_scores(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """One-way ANOVA F of each feature over the classes."""
    aggs = []
    for c in cols:
        aggs += [F.count(c).alias(f"{c}__n"), F.avg(c).alias(f"{c}__m"), F.var_pop(c).alias(f"{c}__v")]
    with held(df.groupBy(target).agg(*aggs)) as (classes,):
        sums = []
        for c in cols:
            n = F.col(f"{c}__n")
            sums += [F.count_if(n > 0).alias(f"{c}__k"), F.sum(n).alias(f"{c}__n"), F.sum(n * F.col(f"{c}__m")).alias(f"{c}__s")]
        first = _one_row(classes, sums)
        spread = []
        for c in cols:
            n = F.col(f"{c}__n")
            gap = F.col(f"{c}__m") - F.lit(first[f"{c}__s"] / first[f"{c}__n"] if first[f"{c}__n"] else None).cast("double")
            spread += [F.sum(n * gap * gap).alias(f"{c}__b"), F.sum(n * F.col(f"{c}__v")).alias(f"{c}__w")]
        second = _one_row(classes, spread)
    out = []
    for c in cols:
        k, n = first[f"{c}__k"], first[f"{c}__n"]
        if k < 2 or n <= k:  # one class, or no rows to spare
            out.append((c, None, None))
            continue
        within = second[f"{c}__w"] / (n - k)
        f = second[f"{c}__b"] / (k - 1) / within if within else float("inf")
        out.append((c, f, tails.f_upper(f, k - 1, n - k) if within else 0.0))
    return rows_table(df, out, "variable string, f double, p double")


def regression_f_scores(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    aggs = []
    for c in cols:
        both = F.col(c).isNotNull() & F.col(target).isNotNull()
        aggs += [correlation(c, target).alias(f"{c}__r"), F.count_if(both).alias(f"{c}__n")]
    row = _one_row(df, aggs)
    out = []
    for c in cols:
        r, n = row[f"{c}__r"], row[f"{c}__n"]
        if r is None or n < 3:  # a constant, or no rows to spare
            out.append((c, None, None))
            continue
        f = float("inf") if abs(r) >= 1 else r * r / (1 - r * r) * (n - 2)
        out.append((c, f, tails.f_upper(f, 1, n - 2) if f != float("inf") else 0.0))
    return rows_table(df, out, "variable string, f double, p double")


def single_feature_scores(
    train: DataFrame, test: DataFrame, cols: Sequence[str], target: str, metric: str, depth: int = 5
) -> DataFrame:
    """(variable, value): test metric (auc, mse, rmse) of a tree grown on each feature alone, all of them at once."""
    leaves = grow(counted_values(train, cols, target), [depth])
    values = counted_values(test, cols, target).withColumn("fold", F.lit(WHOLE))
    scores = tree_scores(values, leaves, "mse" if metric == "rmse" else metric)
    value = F.sqrt("value") if metric == "rmse" else F.col("value")
    return scores.select("variable", value.alias("value"))


def label_mean_auc(
    df: DataFrame, cols: Sequence[str], target: str, split: str = "split", train: str = "train"
) -> DataFrame:
    """(variable, auc): the train target mean of each label used as score on the test rows.

    Both halves are reduced to counts per label in one pass, so no row is joined.
    Test rows with unseen labels have no score and are left out.
    """
    is_train = F.col("_s") == train
    cells = (
        df.select(F.col(split).alias("_s"), F.col(target).alias("_y"), *[F.coalesce(F.col(c).cast("string"), F.lit("Missing")).alias(c) for c in cols])
        .unpivot(["_s", "_y"], list(cols), "variable", "label")
        .groupBy("variable", "label")
        .agg(
            F.avg(F.when(is_train, F.col("_y"))).alias("score"),
            F.count_if(~is_train & (F.col("_y") == 1)).alias("pos"),
            F.count_if(~is_train & (F.col("_y") != 1)).alias("neg"),
        )
        .where("score is not null")
    )
    tied = cells.groupBy("variable", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return auc_of_counts(tied, ["variable"])


def binned_mean_auc(
    df: DataFrame, cols: Sequence[str], target: str, bins: int = 10, split: str = "split", train: str = "train"
) -> DataFrame:
    """The same for numeric columns cut into equal-frequency bins of the train rows."""
    cut = EqualFrequency(bins, list(cols), "drop", clamp=True, suffix="_b").fit(df.where(F.col(split) == train))
    for c, edges in cut.edges().items():
        df = add_bins(df, c, edges, c, clamp=True)
    return label_mean_auc(df, cols, target, split, train)


# ---------------------------------------------------------------- wrappers


def _better(metric: str) -> Callable[[float], float]:
    return (lambda v: v) if HIGHER_IS_BETTER[metric] else (lambda v: -v)


def step_forward(
    df: DataFrame, cols: Sequence[str], label: str, estimator: Estimator, metric: str, k: int, fold: str = "fold"
) -> DataFrame:
    """(step, feature, value): each step adds the candidate with the best validation score."""
    gain, chosen, rows = _better(metric), [], []
    with held(df.select(label, fold, *cols)) as (data,):
        data = few_tasks(data)
        folds = fold_values(data, fold)
        while len(chosen) < k:
            left = [c for c in cols if c not in chosen]
            values = cv_scores(data, [[*chosen, c] for c in left], label, estimator, metric, fold, folds)
            best = max(range(len(left)), key=lambda i: (gain(values[i]), -i))
            chosen.append(left[best])
            rows.append((len(chosen), left[best], float(values[best])))
    return rows_table(df, rows, "step int, feature string, value double")


def step_backward(
    df: DataFrame, cols: Sequence[str], label: str, estimator: Estimator, metric: str, k: int, fold: str = "fold"
) -> DataFrame:
    """(step, dropped, value): each step drops the column whose absence scores best."""
    gain, chosen, rows = _better(metric), list(cols), []
    with held(df.select(label, fold, *cols)) as (data,):
        data = few_tasks(data)
        folds = fold_values(data, fold)
        while len(chosen) > k:
            values = cv_scores(data, [[o for o in chosen if o != c] for c in chosen], label, estimator, metric, fold, folds)
            best = max(range(len(chosen)), key=lambda i: (gain(values[i]), -i))
            rows.append((len(rows) + 1, chosen.pop(best), float(values[best])))
    return rows_table(df, rows, "step int, dropped string, value double")


def exhaustive(
    df: DataFrame,
    cols: Sequence[str],
    label: str,
    estimator: Estimator,
    metric: str,
    smallest: int = 1,
    largest: int = 2,
    fold: str = "fold",
) -> DataFrame:
    """(features, value) of every subset of the given sizes, best first."""
    subsets = [s for n in range(smallest, largest + 1) for s in combinations(cols, n)]
    gain = _better(metric)
    with held(df.select(label, fold, *cols)) as (data,):
        data = few_tasks(data)
        folds = fold_values(data, fold)
        values = cv_scores(data, subsets, label, estimator, metric, fold, folds)
    rows = sorted(((", ".join(s), float(v)) for s, v in zip(subsets, values)), key=lambda r: (-gain(r[1]), r[0]))
    return rows_table(df, rows, "features string, value double")


# ---------------------------------------------------------------- model based


def coefficient_table(df: DataFrame, cols: Sequence[str], label: str, estimator: Estimator) -> DataFrame:
    """(feature, coefficient) on standardised features."""
    scaled = Scale("standard", list(cols)).fit(df).transform(df)
    model = fit(scaled, cols, label, estimator)
    rows = [(c, float(v)) for c, v in zip(cols, model.coefficients.toArray())]
    return rows_table(df, rows, "feature string, coefficient double")


def nonzero_features(coefs: DataFrame) -> DataFrame:
    return coefs.where(F.col("coefficient") != 0)


def above_mean_features(table: DataFrame, value: str) -> DataFrame:
    """Features whose absolute value exceeds the mean absolute value."""
    return table.where(F.abs(F.col(value)) > table.agg(F.avg(F.abs(F.col(value)))).scalar())


def coefficient_path(
    df: DataFrame, cols: Sequence[str], label: str, make: Callable[[float], Estimator], penalties: Sequence[float]
) -> DataFrame:
    """(penalty, feature, coefficient) for a sweep of penalties."""
    out = None
    for p in penalties:
        part = coefficient_table(df, cols, label, make(p)).withColumn("penalty", F.lit(float(p)))
        out = part if out is None else out.unionByName(part)
    return out


def importance_table(df: DataFrame, cols: Sequence[str], label: str, estimator: Estimator) -> DataFrame:
    rows = [(f, float(v)) for f, v in importances(fit(df, cols, label, estimator), cols)]
    return rows_table(df, rows, "feature string, importance double")


def recursive_elimination(
    df: DataFrame, cols: Sequence[str], label: str, estimator: Estimator, keep: int, step: int = 1
) -> DataFrame:
    """(feature, rank): refit and drop the least important until ``keep`` are left (rank 1)."""
    left, rows = list(cols), []
    with held(df.select(label, *cols)) as (data,):
        while len(left) > keep:
            ranked = sorted(importances(fit(data, left, label, estimator), left), key=lambda p: (p[1], p[0]))
            for f, _ in ranked[: min(step, len(left) - keep)]:
                left.remove(f)
                rows.append(f)
    order = [(f, 1) for f in left] + [(f, i + 2) for i, f in enumerate(reversed(rows))]
    return rows_table(df, order, "feature string, rank int")


def recursive_elimination_cv(
    df: DataFrame, cols: Sequence[str], label: str, estimator: Estimator, metric: str, fold: str = "fold"
) -> DataFrame:
    """(feature, rank, size, score): the elimination order over all rows, each feature with the mean validation metric
    of the set that it is the last to join (the ``size`` best features). Rank 1 is every feature of the best set,
    the smallest one on ties; the number of features is thus chosen by the folds."""
    gain = _better(metric)
    with held(df.select(label, fold, *cols)) as (data,):
        folds = fold_values(data, fold)
        order = recursive_elimination(data, cols, label, estimator, 1).orderBy("rank").collect()
        ranked = [r["feature"] for r in order]
        sizes = list(range(1, len(ranked) + 1))
        scores = cv_scores(data, [ranked[:n] for n in sizes], label, estimator, metric, fold, folds)
    best = max(sizes, key=lambda n: (gain(scores[n - 1]), -n))
    rows = [(f, 1 if n <= best else n - best + 1, n, float(scores[n - 1])) for n, f in zip(sizes, ranked)]
    return rows_table(df, rows, "feature string, rank int, size int, score double")


def shuffle_selection(
    train: DataFrame, test: DataFrame, cols: Sequence[str], label: str, key: Sequence[str], estimator: Estimator, metric: str
) -> DataFrame:
    """Features whose shuffling hurts the test metric."""
    model = fit(train, cols, label, estimator)
    drops = permutation_importance(lambda d: scored(model, d, cols), test, cols, label, key, metric, repeats=1)
    return drops.where(F.col("mean_drop") > 0)


def hybrid_elimination(
    train: DataFrame, test: DataFrame, cols: Sequence[str], label: str, estimator: Estimator, metric: str, tol: float
) -> DataFrame:
    """(feature, drop, kept): from the least important up, a feature stays only if
    leaving it out costs at least ``tol``."""
    gain = _better(metric)
    with held(train.select(label, *cols), test.select(label, *cols)) as (a, b):
        full = fit(a, cols, label, estimator)
        ranked = [f for f, _ in sorted(importances(full, cols), key=lambda p: (p[1], p[0]))]
        reference = gain(metric_value(scored(full, b, cols), metric, label))
        left, rows = list(cols), []
        for f in ranked:
            rest = [c for c in left if c != f]
            if not rest:
                rows.append((f, 0.0, True))
                break
            value = gain(evaluate(a, b, rest, label, estimator, metric))
            kept = reference - value >= tol
            rows.append((f, float(reference - value), kept))
            if not kept:
                left, reference = rest, value
    return rows_table(train, rows, "feature string, drop double, kept boolean")


def hybrid_addition(
    train: DataFrame, test: DataFrame, cols: Sequence[str], label: str, estimator: Estimator, metric: str, tol: float
) -> DataFrame:
    """(feature, gain, kept): from the most important down, a feature enters only if it
    adds at least ``tol``."""
    gain = _better(metric)
    with held(train.select(label, *cols), test.select(label, *cols)) as (a, b):
        ranked = [f for f, _ in sorted(importances(fit(a, cols, label, estimator), cols), key=lambda p: (-p[1], p[0]))]
        chosen = [ranked[0]]
        reference = gain(evaluate(a, b, chosen, label, estimator, metric))
        rows = [(ranked[0], float(reference), True)]
        for f in ranked[1:]:
            value = gain(evaluate(a, b, [*chosen, f], label, estimator, metric))
            kept = value - reference >= tol
            rows.append((f, float(value - reference), kept))
            if kept:
                chosen.append(f)
                reference = value
    return rows_table(train, rows, "feature string, gain double, kept boolean")


def mean_importance(
    df: DataFrame,
    cols: Sequence[str],
    label: str,
    make: Callable[[int], Estimator],
    key: Sequence[str],
    fits: int = 2,
    hold_out: float = 0.25,
) -> DataFrame:
    """(feature, importance): mean over seeded fits of a boosted learner. Each fit holds out its own share of the rows,
    drawn by a hash of the key, and stops when they no longer improve."""
    totals = dict.fromkeys(cols, 0.0)
    with held(df.select(*dict.fromkeys([*key, label, *cols]))) as (data,):
        models = in_parallel(
            [lambda s=s: early_stopped(data, cols, label, make(s), hash_uniform(key, s) < hold_out) for s in range(fits)]
        )
    for model in models:
        for f, v in importances(model, cols):
            totals[f] += float(v) / fits
    return rows_table(df, list(totals.items()), "feature string, importance double")


def features_to_reach(table: DataFrame, threshold: float) -> DataFrame:
    """Importance table with its cumulative share and whether the feature is needed to reach t."""
    from .windows import cumulative_share

    out = cumulative_share(table, "importance", "feature")
    return out.withColumn("needed", (F.col("cum_share") - F.col("share")) <= threshold)


def selection_funnel(
    train: DataFrame, test: DataFrame, cols: Sequence[str], label: str, key: Sequence[str], estimator: Estimator, correlated_above: float = 0.8
) -> DataFrame:
    """(step, n_features, dropped, auc) after each filter: constant, quasi-constant,
    duplicate, correlated, univariate AUC."""
    left = list(cols)
    rows = []

    def note(step: str, gone: Sequence[str]) -> None:
        for c in gone:
            left.remove(c)
        auc = evaluate(a, b, left, label, estimator, "auc")
        rows.append((len(rows), step, len(left), ", ".join(gone), float(auc)))

    keep = [*key, label, *cols]
    with held(train.select(*keep), test.select(*keep)) as (a, b):
        note("all", [])
        note("constant", constant_columns(a, left))
        note("quasi_constant", low_variance_columns(a, left, 0.01))
        note("duplicate", [d for _, d in duplicate_columns(a, left, key)])
        note("correlated", correlated_columns(a, left, correlated_above))
        alone = {r["variable"]: r["value"] for r in single_feature_scores(a, b, left, label, "auc").collect()}
        note("univariate_auc", [c for c in left if alone[c] <= 0.5])
    return rows_table(train, rows, "position int, step string, n_features int, dropped string, auc double")


def compare_feature_lists(
    train: DataFrame, test: DataFrame, lists: dict[str, Sequence[str]], label: str, estimators: dict[str, Estimator], metric: str
) -> DataFrame:
    """(variant, model, train, test) for each feature list and learner."""
    from .models import compare_tables

    needed = list(dict.fromkeys([label, *(f for cols in lists.values() for f in cols)]))
    with held(train.select(*needed), test.select(*needed)) as (a, b):
        return settle(compare_tables({n: (a, b, f) for n, f in lists.items()}, label, estimators, metric))
