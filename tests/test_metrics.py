import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tabloom.functions import tails
from tabloom.operators import explain as ex, metrics as mt, models as m, select as sel


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(1)
    rows = []
    for i in range(500):
        y = int(rng.random() < 0.4)
        rows.append((i, y, round(min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * y, 0.25))), 1 if i % 3 else 3)))
    return spark.createDataFrame(rows, "id long, y int, s double").cache()


def brute_auc(rows):
    pos = [r["s"] for r in rows if r["y"] == 1]
    neg = [r["s"] for r in rows if r["y"] == 0]
    return sum((a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg)) / (len(pos) * len(neg))


def test_auc_with_ties(scored):
    want = brute_auc(scored.collect())
    assert mt.roc_auc(scored, "y", "s").first()["auc"] == pytest.approx(want, abs=1e-12)
    assert mt.metric_value(scored, "auc", "y", "s") == pytest.approx(want, abs=1e-12)
    assert mt.metric_value(scored.where("y = 1"), "auc", "y", "s") != mt.metric_value(scored, "auc", "y", "s")


def test_auc_leaves_out_null_scores_and_is_nan_for_one_class(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.4), (0, 0.6), (1, None)], "y int, s double")
    assert mt.metric_value(df, "auc", "y", "s") == pytest.approx(0.75) == mt.roc_auc(df, "y", "s").first()["auc"]
    assert math.isnan(mt.metric_value(df.where("y = 1"), "auc", "y", "s"))
    assert mt.roc_auc(df.where("y = 1"), "y", "s").first()["auc"] is None


def test_curve(scored):
    a = mt.curve(scored, "y", "s").orderBy("threshold").collect()
    last = min(a, key=lambda r: r["threshold"])
    assert (last["tpr"], last["fpr"]) == (1.0, 1.0)
    for r in a[:: max(1, len(a) // 7)]:
        hit = scored.where(F.col("s") >= r["threshold"]).agg(F.sum("y"), F.count("*")).first()
        assert (r["tp"], r["fp"]) == (hit[0], hit[1] - hit[0])


def test_lrap_against_definition(spark):
    rng = random.Random(5)
    rows = [(q, int(rng.random() < 0.4), rng.randint(0, 4) / 4) for q in range(30) for _ in range(6)]
    total = 0.0
    for q in range(30):
        items = [r for r in rows if r[0] == q]
        rel = [r for r in items if r[1]]
        if not rel:
            total += 1.0
            continue
        total += sum(sum(o[2] >= r[2] for o in rel) / sum(o[2] >= r[2] for o in items) for r in rel) / len(rel)
    df = spark.createDataFrame(rows, "q int, y int, s double")
    assert mt.lrap(df, "q", "y", "s").first()["lrap"] == pytest.approx(total / 30, abs=1e-12)


def test_tails():
    assert tails.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074, abs=1e-12)
    assert tails.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert tails.f_upper(4.0, 1, 30) == pytest.approx(tails.t_two_sided(2.0, 30), abs=1e-12)
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert tails.t_critical(0.05, 10) == pytest.approx(2.2281388519649385, abs=1e-9)


def test_split_and_folds_ignore_partitioning(scored):
    a = m.add_split(scored, ["id"], 0.3, 1).orderBy("id").collect()
    assert a == m.add_split(scored.repartition(7), ["id"], 0.3, 1).orderBy("id").collect()
    f = m.add_folds(scored, ["id"], 4, 2, ["y"])
    g = m.add_folds(scored.repartition(7), ["id"], 4, 2, ["y"])
    assert f.select("id", "fold").orderBy("id").collect() == g.select("id", "fold").orderBy("id").collect()
    sizes = [r["count"] for r in f.groupBy("y", "fold").count().collect()]
    for y in (0, 1):
        part = [r["count"] for r in f.where(f["y"] == y).groupBy("fold").count().collect()]
        assert max(part) - min(part) <= 1
    assert len(sizes) == 8


def test_stratified_split_is_exact(scored):
    out = m.add_stratified_split(scored, ["id"], ["y"], 0.3, 4)
    for r in out.groupBy("y").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect():
        assert r["t"] == round(r["n"] * 0.3)


def score_of(df):
    return df.withColumn("score", F.col("a") * F.col("b") + 2 * F.col("c"))


@pytest.fixture(scope="module")
def inputs(spark):
    rng = random.Random(8)
    return spark.createDataFrame(
        [(i, rng.gauss(0, 1), rng.gauss(1, 2), rng.random(), int(rng.random() < 0.5)) for i in range(60)],
        "id long, a double, b double, c double, y int",
    ).cache()


def test_sampled_shapley_adds_up(spark, inputs):
    background = inputs.limit(4)
    phi = ex.sampled_shapley(score_of, inputs, ["a", "b", "c"], ["id"], background, ["id"], draws=12, seed=1)
    base = score_of(background).agg(F.avg("score")).first()[0]
    rows = phi.groupBy("id").agg(F.sum("phi").alias("t")).join(score_of(inputs), "id").collect()
    assert len(rows) == 60
    assert all(r["t"] == pytest.approx(r["score"] - base, abs=1e-9) for r in rows)


def test_linear_shapley_matches_sampled(inputs):
    coef = {"a": 2.0, "b": -1.0, "c": 0.5}
    exact = ex.linear_shapley(inputs, coef, ["id"])
    sampled = ex.sampled_shapley(
        lambda d: d.withColumn("score", 2 * F.col("a") - F.col("b") + 0.5 * F.col("c")),
        inputs, ["a", "b", "c"], ["id"], inputs, ["id"], draws=60,
    )
    both = exact.join(sampled.withColumnRenamed("phi", "other").drop("value"), ["id", "feature"]).collect()
    assert all(r["phi"] == pytest.approx(r["other"], abs=1e-9) for r in both) and len(both) == 180


def test_shuffled_is_a_permutation(inputs):
    out = ex.shuffled(inputs, ["a"], ["id"], 3).select("a", F.col("other.a").alias("b")).collect()
    assert sorted(r["a"] for r in out) == sorted(r["b"] for r in out)
    assert [r["a"] for r in out] != [r["b"] for r in out]


def test_permutation_importance_of_an_unused_column_is_zero(inputs):
    labelled = inputs.withColumn("y", (F.col("c") > 0.5).cast("int"))
    out = ex.permutation_importance(lambda d: d.withColumn("score", F.col("c")), labelled, ["a", "c"], "y", ["id"], "auc")
    drops = {r["feature"]: r["mean_drop"] for r in out.collect()}
    assert drops["a"] == 0.0 and drops["c"] > 0.2


def test_duplicate_columns(spark):
    df = spark.createDataFrame([(i, i % 3, i % 3, (i % 3) + (i == 5), None if i == 2 else 1, None if i == 2 else 1) for i in range(20)],
                               "id long, a int, b int, c int, d int, e int")
    assert sel.duplicate_columns(df, ["a", "b", "c", "d", "e"], ["id"]) == [("a", "b"), ("d", "e")]
    assert sel.constant_labels(df.withColumn("k", F.lit(None).cast("string")), ["a", "d", "k"]) == ["k"]


def test_anova_and_regression_f_agree_on_two_classes(inputs):
    a = {r["variable"]: (r["f"], r["p"]) for r in sel.anova_scores(inputs, ["a", "b"], "y").collect()}
    b = {r["variable"]: (r["f"], r["p"]) for r in sel.regression_f_scores(inputs, ["a", "b"], "y").collect()}
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-9)
        assert 0 <= a[k][1] <= 1 and not math.isnan(a[k][0])


def test_forward_selection_finds_the_signal(spark):
    rng = random.Random(2)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1), i % 2) for i in range(300)]
    df = spark.createDataFrame([(i, a, b, int(a > 0), f) for i, a, b, f in rows], "id long, a double, b double, y int, fold int")
    out = sel.step_forward(df, ["b", "a"], "y", m.learner("bayes"), "auc", 1).collect()
    assert [r["feature"] for r in out] == ["a"]
