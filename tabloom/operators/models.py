"""Splits, folds, learners, tuning and out-of-fold scoring on Spark ML."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable, Mapping, Sequence
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import classification as C, clustering, regression as R
from pyspark.ml.base import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, functions as F

from .core import held
from .metrics import HIGHER_IS_BETTER, AggregateEvaluator, metric_value
from .ordered import hash_positions, hash_uniform

THREADS = 4
#: Rows of a held table that one task of a fit takes where there are more tasks than cores.
TASK_ROWS = 100_000


# ---------------------------------------------------------------- splits


def add_split(df: DataFrame, key: Sequence[str], test_share: float = 0.3, seed: int = 0) -> DataFrame:
    """Seeded train/test tag that depends on the key only."""
    return df.withColumn("split", F.when(hash_uniform(key, seed) < test_share, "test").otherwise("train"))


def add_stratified_split(
    df: DataFrame, key: Sequence[str], strata: Sequence[str], test_share: float = 0.3, seed: int = 0
) -> DataFrame:
    """Exactly round(share x size) test rows in each stratum."""
    ranked = hash_positions(df, strata, key, seed, "_pos", "_size")
    return ranked.withColumn(
        "split", F.when(F.col("_pos") <= F.round(F.col("_size") * test_share), "test").otherwise("train")
    ).drop("_pos", "_size")


def add_folds(
    df: DataFrame, key: Sequence[str], k: int = 5, seed: int = 0, strata: Sequence[str] = ()
) -> DataFrame:
    """Fold 0..k-1 of near equal size, per stratum if given."""
    ranked = hash_positions(df, strata, key, seed, "_pos", "_size")
    return ranked.withColumn("fold", F.pmod(F.col("_pos") - 1, F.lit(k)).cast("int")).drop("_pos", "_size")


# ---------------------------------------------------------------- learners


def learner(kind: str, regression: bool = False, **params) -> Estimator:
    """Spark ML learner by short name; params are Spark ML's own."""
    classes = {
        "logistic": C.LogisticRegression,
        "tree": R.DecisionTreeRegressor if regression else C.DecisionTreeClassifier,
        "forest": R.RandomForestRegressor if regression else C.RandomForestClassifier,
        "boosted": R.GBTRegressor if regression else C.GBTClassifier,
        "svm": C.LinearSVC,
        "bayes": C.NaiveBayes,
        "perceptron": C.MultilayerPerceptronClassifier,
        "kmeans": clustering.KMeans,
        "linear": R.LinearRegression,
        "ridge": R.LinearRegression,
        "lasso": R.LinearRegression,
    }
    fixed = {"ridge": {"elasticNetParam": 0.0}, "lasso": {"elasticNetParam": 1.0}, "bayes": {"modelType": "gaussian"}}
    if kind == "svm_many":
        return C.OneVsRest(classifier=C.LinearSVC(**params))
    seeded = {"seed": 0} if kind in ("tree", "forest", "boosted", "perceptron", "kmeans") else {}
    return classes[kind](**{**fixed.get(kind, {}), **seeded, **params})


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Vector column of the named features. Rows with nulls are refused by the assembler."""
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def with_label(estimator: Estimator, label: str) -> Estimator:
    return estimator.copy({estimator.labelCol: label}) if estimator.hasParam("labelCol") else estimator


def fit(df: DataFrame, features: Sequence[str], label: str, estimator: Estimator) -> Model:
    """Fit on the needed columns. Learners read their input several times, so its vectors
    are kept for the length of the fit."""
    est = with_label(estimator, label)
    extra = [
        est.getOrDefault(p)
        for p in ("weightCol", "validationIndicatorCol")
        if est.hasParam(p) and est.isDefined(p) and est.getOrDefault(p)
    ]
    with held(assemble(df, features).select("features", label, *extra)) as (data,):
        return est.fit(data)


def scored(model: Model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds ``prediction`` and, for classifiers, ``score`` = probability (or margin) of class 1."""
    out = model.transform(assemble(df, features))
    if "probability" in out.columns:
        out = out.withColumn("score", vector_to_array("probability")[1])
    elif "rawPrediction" in out.columns:
        out = out.withColumn("score", vector_to_array("rawPrediction")[1])
    else:
        out = out.withColumn("score", F.col("prediction"))
    return out.drop("features", "rawPrediction", "probability")


def evaluate(
    train: DataFrame, test: DataFrame, features: Sequence[str], label: str, estimator: Estimator, metric: str
) -> float:
    return metric_value(scored(fit(train, features, label, estimator), test, features), metric, label)


def in_parallel(tasks: Sequence[Callable[[], object]], threads: int = THREADS) -> list:
    """Run independent fits from driver threads; Spark schedules their jobs side by side."""
    if not tasks:
        return []
    run = inheritable_thread_target(SparkSession.getActiveSession())(lambda t: t())
    with ThreadPool(min(threads, len(tasks))) as pool:
        return pool.map(run, tasks)


def importances(model: Model, features: Sequence[str]) -> list[tuple[str, float]]:
    """(feature, importance): tree importances or absolute coefficients."""
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray().tolist()
    else:
        values = [abs(v) for v in model.coefficients.toArray().tolist()]
    return list(zip(features, values))


def rows_table(df: DataFrame, rows: Iterable[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(list(rows), schema)


# ---------------------------------------------------------------- validation


def cross_validate(
    df: DataFrame, features: Sequence[str], label: str, estimator: Estimator, metrics: Sequence[str], fold: str = "fold"
) -> DataFrame:
    """(fold, metric, train, test) for every fold of a fold column."""
    with held(df.select(*dict.fromkeys([*features, label, fold]))) as (data,):
        folds = fold_values(data, fold)

        def one(f):
            model = fit(data.where(F.col(fold) != f), features, label, estimator)
            with held(scored(model, data, features).select(label, fold, "prediction", "score")) as (both,):
                train, test = both.where(F.col(fold) != f), both.where(F.col(fold) == f)
                return [
                    (int(f), m, float(metric_value(train, m, label)), float(metric_value(test, m, label)))
                    for m in metrics
                ]

        rows = in_parallel([lambda f=f: one(f) for f in folds])
    return rows_table(df, [r for part in rows for r in part], "fold int, metric string, train double, test double")


def fold_values(df: DataFrame, fold: str = "fold") -> list:
    return [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]


def few_tasks(data: DataFrame) -> DataFrame:
    """A held table of more than `TASK_ROWS` rows in as many partitions as there are cores, or more by its rows: each
    task of a forest's level sends the sums of all its nodes. A smaller table stays as it is."""
    rows = data.count()
    if rows <= TASK_ROWS:
        return data
    return data.coalesce(max(data.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def cv_score(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    estimator: Estimator,
    metric: str,
    fold: str = "fold",
    folds: Sequence | None = None,
) -> float:
    """Mean validation metric over the folds."""
    return cv_scores(df, [features], label, estimator, metric, fold, folds)[0]


def cv_scores(
    df: DataFrame,
    lists: Sequence[Sequence[str]],
    label: str,
    estimator: Estimator,
    metric: str,
    fold: str = "fold",
    folds: Sequence | None = None,
) -> list[float]:
    """Mean validation metric over the folds of each feature list; the fits of all lists and folds run side by side."""
    folds = list(folds) if folds is not None else fold_values(df, fold)
    values = in_parallel(
        [
            lambda features=features, f=f: evaluate(df.where(F.col(fold) != f), df.where(F.col(fold) == f), features, label, estimator, metric)
            for features in lists
            for f in folds
        ]
    )
    return [sum(values[i : i + len(folds)]) / len(folds) for i in range(0, len(values), len(folds))]


def grid_search(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    estimator: Estimator,
    grid: Mapping[str, Sequence],
    metric: str,
    folds: int = 3,
    fold: str | None = None,
) -> tuple[DataFrame, Model]:
    """Results table (params, mean, std), best first, and the refitted best model."""
    est = with_label(estimator, label)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(est.getParam(name), list(values))
    maps = builder.build()
    more = {"foldCol": fold} if fold else {"seed": 0}
    cv = CrossValidator(
        estimator=est,
        estimatorParamMaps=maps,
        evaluator=AggregateEvaluator(metric, label),
        numFolds=folds,
        parallelism=THREADS,
        **more,
    )
    model = cv.fit(assemble(df, features))
    rows = [
        (", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda kv: kv[0].name)), float(a), float(s))
        for m, a, s in zip(maps, model.avgMetrics, model.stdMetrics)
    ]
    rows.sort(key=lambda r: -r[1] if HIGHER_IS_BETTER[metric] else r[1])
    return rows_table(df, rows, "params string, mean double, std double"), model.bestModel


def random_search(
    train: DataFrame,
    valid: DataFrame,
    features: Sequence[str],
    label: str,
    kind: str,
    grid: Mapping[str, Sequence],
    metric: str,
    max_evals: int,
    seed: int = 0,
    regression: bool = False,
) -> DataFrame:
    """(iteration, params, value), best first, for distinct settings drawn from the grid."""
    names = sorted(grid)
    settings = list(product(*[grid[n] for n in names]))
    chosen = random.Random(seed).sample(settings, min(max_evals, len(settings)))

    def one(values):
        est = learner(kind, regression, **dict(zip(names, values)))
        return float(evaluate(train, valid, features, label, est, metric))

    scores = in_parallel([lambda v=v: one(v) for v in chosen])
    rows = [
        (i, ", ".join(f"{n}={x}" for n, x in zip(names, v)), s) for i, (v, s) in enumerate(zip(chosen, scores))
    ]
    rows.sort(key=lambda r: (-r[2] if HIGHER_IS_BETTER[metric] else r[2], r[0]))
    return rows_table(train, rows, "iteration int, params string, value double")


def validation_curve(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    make: Callable[[object], Estimator],
    values: Sequence,
    metric: str,
    fold: str = "fold",
) -> DataFrame:
    """(value, train, test): mean metric per parameter value."""
    out = None
    for v in values:
        part = cross_validate(df, features, label, make(v), [metric], fold).agg(
            F.lit(str(v)).alias("value"), F.avg("train").alias("train"), F.avg("test").alias("test")
        )
        out = part if out is None else out.unionByName(part)
    return out


def out_of_fold(
    df: DataFrame,
    score: DataFrame | None,
    features: Sequence[str],
    label: str,
    key: str,
    make: Callable[[int], Estimator],
    fold: str = "fold",
) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Out-of-fold scores of the labelled rows, mean score of the unlabelled rows over
    the fold models, and the (feature, importance, fold) table."""
    with held(df.select(*dict.fromkeys([*features, label, fold]))) as (data,):
        folds = fold_values(data, fold)
        models = in_parallel([lambda f=f: fit(data.where(F.col(fold) != f), features, label, make(f)) for f in folds])
    oof, given, rows = None, None, []
    for f, model in zip(folds, models):
        part = scored(model, df.where(F.col(fold) == f), features).select(key, label, fold, "score")
        oof = part if oof is None else oof.unionByName(part)
        rows += [(n, float(v), int(f)) for n, v in importances(model, features)]
        if score is not None:
            given = scored(model, score if given is None else given, features)
            total = F.col("score") if "_sum" not in given.columns else F.col("_sum") + F.col("score")
            given = given.withColumn("_sum", total).drop("score", "prediction")
    mean = None if given is None else given.select(key, (F.col("_sum") / len(folds)).alias("score"))
    return oof, mean, rows_table(df, rows, "feature string, importance double, fold int")


def early_stopped(
    df: DataFrame, features: Sequence[str], label: str, estimator: Estimator, is_valid
) -> Model:
    """Boosting that stops when the marked validation rows no longer improve."""
    marked = df.withColumn("_valid", is_valid)
    return fit(marked, features, label, estimator.copy({estimator.validationIndicatorCol: "_valid"}))


def weight_column(df: DataFrame, label: str, weights: Mapping) -> DataFrame:
    out = None
    for value, w in weights.items():
        out = F.when(F.col(label) == value, float(w)) if out is None else out.when(F.col(label) == value, float(w))
    return df.withColumn("weight", out.otherwise(1.0))


def adversarial_weights(
    train: DataFrame, score: DataFrame, features: Sequence[str], key: str, estimator: Estimator
) -> DataFrame:
    """Weights 1/p - 1 with p the probability of being a training row, scaled to mean 1."""
    both = train.select(key, *features, F.lit(1).alias("is_train")).unionByName(
        score.select(key, *features, F.lit(0).alias("is_train"))
    )
    model = fit(both, features, "is_train", estimator)
    p = F.greatest(F.col("score"), F.lit(1e-6))
    raw = scored(model, train, features).select(key, (1.0 / p - 1.0).alias("raw"))
    mean = raw.agg(F.avg("raw")).first()[0]
    return raw.select(key, (F.col("raw") / F.lit(mean or 1.0)).alias("weight"))


def log_target_predictions(
    train: DataFrame, score: DataFrame, features: Sequence[str], label: str, estimator: Estimator
) -> DataFrame:
    """Fit on the log of the target, predictions transformed back."""
    model = fit(train.withColumn("_log_y", F.ln(label)), features, "_log_y", estimator)
    return scored(model, score, features).withColumn("prediction", F.exp("prediction")).drop("score")


def compare_tables(
    tables: Mapping[str, tuple[DataFrame, DataFrame, Sequence[str]]], label: str, estimators: Mapping[str, Estimator], metric: str
) -> DataFrame:
    """(variant, model, train, test): one metric for every table variant and learner."""
    tasks, names = [], []
    for variant, (train, test, features) in tables.items():
        for name, est in estimators.items():

            def one(train=train, test=test, features=features, est=est):
                model = fit(train, features, label, est)
                return [metric_value(scored(model, d, features), metric, label) for d in (train, test)]

            tasks.append(one)
            names.append((variant, name))
    values = in_parallel(tasks)
    any_df = next(iter(tables.values()))[0]
    rows = [(*n, float(a), float(b)) for n, (a, b) in zip(names, values)]
    return rows_table(any_df, rows, "variant string, model string, train double, test double")
