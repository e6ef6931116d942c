"""Model quality from (label, score) or (label, prediction) columns.

Curves and rank statistics group by score first, so ties are exact and the ordered
part sees one row per distinct score.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.evaluation import Evaluator
from pyspark.sql import Column, DataFrame, functions as F

from .core import share
from .ordered import hash_uniform, running_sums
from .profile import describe


def _by_score(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    """Rows without a score have no rank and don't count."""
    return df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )


def auc_of_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve from (by..., score, pos, neg), in its rank form."""
    run = running_sums(counts, by, "score", {"neg": F.col("neg")})
    won = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2.0))
    return run.groupBy(*by).agg(F.try_divide(won, F.sum("pos") * F.sum("neg").cast("double")).alias("auc"))


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return auc_of_counts(_by_score(df, label, score, by), by)


def curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row per distinct score used as threshold (score >= threshold is positive):
    true and false positive counts, rates, precision and accuracy."""
    run = running_sums(
        _by_score(df, label, score, []),
        [],
        "score",
        {"pos": F.col("pos"), "neg": F.col("neg")},
        descending=True,
    )
    tp, fp, all_pos, all_neg = F.col("cum_pos"), F.col("cum_neg"), F.col("total_pos"), F.col("total_neg")
    return run.select(
        F.col("score").alias("threshold"),
        tp.alias("tp"),
        fp.alias("fp"),
        F.try_divide(tp, all_pos).alias("tpr"),
        F.try_divide(fp, all_neg).alias("fpr"),
        F.try_divide(tp, tp + fp).alias("precision"),
        ((tp + all_neg - fp) / (all_pos + all_neg)).alias("accuracy"),
    )


def point_near(points: DataFrame, threshold: float) -> DataFrame:
    """The curve point whose threshold is closest to a value, the larger one on ties."""
    gap = F.struct(F.abs(F.col("threshold") - threshold), -F.col("threshold"))
    best = F.min_by(F.struct(*points.columns), gap).alias("p")
    return points.agg(best).select("p.*")


def best_threshold(points: DataFrame) -> DataFrame:
    """Most accurate threshold, the larger one on ties."""
    best = F.max_by(F.struct(*points.columns), F.struct("accuracy", "threshold")).alias("p")
    return points.agg(best).select("p.*")


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where undefined."""
    cells = confusion(df, label, prediction)
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("actual").alias("class"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("long").alias("called"),
                    F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"),
                ),
                F.struct(
                    F.col("predicted").alias("class"),
                    F.lit(0).cast("long").alias("support"),
                    F.col("n").alias("called"),
                    F.lit(0).cast("long").alias("hit"),
                ),
            )
        ).alias("s")
    ).select("s.*")
    per = sides.groupBy("class").agg(
        F.sum("hit").alias("tp"), F.sum("called").alias("called"), F.sum("support").alias("support")
    )
    return per.select(
        "class",
        _or_zero(F.try_divide("tp", "called")).alias("precision"),
        _or_zero(F.try_divide("tp", "support")).alias("recall"),
        _or_zero(F.try_divide(2.0 * F.col("tp"), F.col("called") + F.col("support"))).alias("f1"),
        "support",
        "tp",
        "called",
    )


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.agg(share(F.col(label) == F.col(prediction)).alias("accuracy"))


def averaged_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(average, precision, recall, f1) for micro and macro averaging."""
    per = class_report(df, label, prediction)
    macro = per.agg(
        F.lit("macro").alias("average"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"),
    )
    micro = per.agg(
        F.lit("micro").alias("average"),
        _or_zero(F.try_divide(F.sum("tp"), F.sum("called"))).alias("precision"),
        _or_zero(F.try_divide(F.sum("tp"), F.sum("support"))).alias("recall"),
        _or_zero(F.try_divide(2.0 * F.sum("tp"), F.sum("called") + F.sum("support"))).alias("f1"),
    )
    return micro.unionByName(macro)


def regression_scores(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    y = F.col(label).cast("double")
    err = y - F.col(prediction)
    mse = F.avg(err * err)
    return df.groupBy(*by).agg(
        mse.alias("mse"), F.sqrt(mse).alias("rmse"), (1 - F.try_divide(mse, F.var_pop(y))).alias("r2")
    )


def forecast_accuracy(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    y = F.col(label).cast("double")
    err = y - F.col(prediction)
    return df.groupBy(*by).agg(
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg(F.when(y != 0, F.abs(err / F.when(y != 0, y)))) * 100).alias("mape"),
        (F.try_divide(F.sum(F.abs(err)), F.sum(F.abs(y))) * 100).alias("wape"),
    )


def residual_summary(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return describe(df.select((F.col(label) - F.col(prediction)).alias("residual")), ["residual"])


def mean_of_columns(cols: Sequence[str]) -> Column:
    out = F.col(cols[0])
    for c in cols[1:]:
        out = out + F.col(c)
    return out / len(cols)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (classes x n_class) per class."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = sizes.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("k"))
    return sizes.select(
        label, "n", (totals.select("rows").scalar() / (totals.select("k").scalar() * F.col("n"))).alias("weight")
    )


def lrap(df: DataFrame, query: str, label: str, score: str) -> DataFrame:
    """Macro label-ranking average precision: per query, the mean over relevant items of
    (relevant items scored at least as high) / (items scored at least as high)."""
    per_score = df.groupBy(query, F.col(score).cast("double").alias("_s")).agg(
        F.count_if(F.col(label) == 1).alias("rel"), F.count(F.lit(1)).alias("n")
    )
    run = running_sums(per_score, [query], "_s", {"rel": F.col("rel"), "n": F.col("n")}, descending=True)
    per_query = run.groupBy(query).agg(
        F.try_divide(F.sum(F.col("rel") * F.col("cum_rel") / F.col("cum_n")), F.sum("rel")).alias("ap")
    )
    # a query without relevant items counts as perfect
    return per_query.agg(F.avg(F.coalesce("ap", F.lit(1.0))).alias("lrap"))


# ---------------------------------------------------------------- baselines


def majority_baseline(train: DataFrame, score: DataFrame, label: str) -> DataFrame:
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.min_by(label, F.struct(-F.col("n"), F.col(label)))).first()[0]
    return score.withColumn("prediction", F.lit(top))


def mean_baseline(train: DataFrame, score: DataFrame, label: str) -> DataFrame:
    return score.withColumn("prediction", F.lit(train.agg(F.avg(label)).first()[0]))


def proportional_baseline(
    train: DataFrame, score: DataFrame, label: str, key: Sequence[str], seed: int = 0
) -> DataFrame:
    """Classes drawn in proportion to their training share, by a hash of the key."""
    sizes = train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label).collect()
    total = sum(r["n"] for r in sizes)
    draw = hash_uniform(key, seed)
    upto, pick = 0, None
    for r in sizes[:-1]:
        upto += r["n"]
        hit = draw < upto / total
        pick = F.when(hit, r[label]) if pick is None else pick.when(hit, r[label])
    last = F.lit(sizes[-1][label])
    return score.withColumn("prediction", last if pick is None else pick.otherwise(last))


# ---------------------------------------------------------------- evaluators

HIGHER_IS_BETTER = {"auc": True, "accuracy": True, "f1": True, "precision": True, "recall": True, "r2": True, "mse": False, "rmse": False}


def metric_value(df: DataFrame, metric: str, label: str, score: str = "score", prediction: str = "prediction") -> float:
    """One number from a scored table."""
    if metric == "auc":
        return _auc_value(df, label, score)
    if metric in ("mse", "rmse", "r2"):
        return regression_scores(df, label, prediction).first()[metric]
    if metric == "accuracy":
        return accuracy(df, label, prediction).first()["accuracy"]
    hit = (F.col(label) == 1) & (F.col(prediction) == 1)
    tp, called, actual = F.count_if(hit), F.count_if(F.col(prediction) == 1), F.count_if(F.col(label) == 1)
    forms = {
        "precision": F.try_divide(tp, called),
        "recall": F.try_divide(tp, actual),
        "f1": F.try_divide(2.0 * tp, called + actual),
    }
    return df.agg(_or_zero(forms[metric]).alias("v")).first()["v"]


def _auc_value(df: DataFrame, label: str, score: str) -> float:
    """The rank form of `auc_of_counts`; NaN where one of the classes is absent."""
    found = roc_auc(df, label, score).first()
    return math.nan if found is None or found["auc"] is None else found["auc"]


class AggregateEvaluator(Evaluator):
    """Spark ML evaluator over `metric_value`, for tuning with the exact metrics."""

    def __init__(self, metric: str, label: str, score: str = "score", prediction: str = "prediction"):
        super().__init__()
        self.metric, self.label, self.score, self.prediction = metric, label, score, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        from pyspark.ml.functions import vector_to_array

        if self.score not in dataset.columns and "probability" in dataset.columns:
            dataset = dataset.withColumn(self.score, vector_to_array("probability")[1])
        return metric_value(dataset, self.metric, self.label, self.score, self.prediction)

    def isLargerBetter(self) -> bool:
        return HIGHER_IS_BETTER[self.metric]
