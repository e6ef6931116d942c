"""Histogram boosting: splits against enumeration, nulls, early stopping, folds side by side."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import boosting as bst, trees as tr


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, a double, b double, y double, fold int, w double").repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(600):
        a, b = rng.choice([1.0, 2.0, 3.0, 5.0, None]), rng.random()
        y = float((2.0 if a is None else a / 5) + b + rng.gauss(0, 0.3) > 1.4)
        out.append((i, a, None if rng.random() < 0.1 else round(b, 2), y, i % 3, 1.0 + i % 2))
    return out


def best_stump(x, y):
    """(threshold, null side) of the best cut of one column by squared error, and the predictions."""
    e = y - y.mean()
    best = None
    for side in (False, True):
        for t in sorted(set(x[~np.isnan(x)])) + [math.inf]:
            left = np.where(np.isnan(x), side, x <= t)
            if left.all() or not left.any():
                continue
            gain = e[left].sum() ** 2 / left.sum() + e[~left].sum() ** 2 / (~left).sum()
            if best is None or gain > best[0] + 1e-9:
                best = gain, np.where(left, y[left].mean(), y[~left].mean())
    return best[1]


@pytest.mark.parametrize("column", ["a", "b"])
def test_one_split_is_the_best(spark, rows, column):
    df = frame(spark, rows)
    (model,) = bst.boost(df, [column], "y", bst.Settings("squared", rounds=1, depth=1, rate=1.0, l2=0.0, bins=255))
    got = {r["id"]: r["score"] for r in model.scored(df).collect()}
    x = np.array([math.nan if r[1 if column == "a" else 2] is None else r[1 if column == "a" else 2] for r in rows])
    want = best_stump(x, np.array([r[3] for r in rows]))
    assert [got[r[0]] for r in rows] == pytest.approx(want.tolist())


def log_loss(rows, scores):
    return -np.mean([r[3] * math.log(s) + (1 - r[3]) * math.log(1 - s) for r, s in zip(rows, scores)])


def test_early_stopping_keeps_the_best_round(spark, rows, monkeypatch):
    monkeypatch.setattr(bst, "REWRITE", 4)
    df = frame(spark, rows).withColumn("valid", F.col("id") % 4 == 0)
    settings = bst.Settings(rounds=300, depth=2, rate=0.5, patience=4)
    (model,) = bst.boost(df, ["a", "b"], "y", settings, valid="valid")
    assert 0 < model.rounds < 290
    assert model.losses[model.rounds] == min(model.losses) and len(model.losses) <= model.rounds + 5
    scores = {r["id"]: r["score"] for r in model.scored(df).collect()}
    held = [r for r in rows if r[0] % 4 == 0]
    assert log_loss(held, [scores[r[0]] for r in held]) == pytest.approx(model.losses[model.rounds])
    assert log_loss(held, [scores[r[0]] for r in held]) < 0.8 * model.losses[0]
    (again,) = bst.boost(df.repartition(7), ["a", "b"], "y", settings, valid="valid")
    assert again.rounds == model.rounds and again.losses == pytest.approx(model.losses)


def test_fold_models_equal_models_of_their_own(spark, rows):
    df = frame(spark, rows)
    settings = bst.Settings(rounds=6, depth=2, rate=0.5, patience=2)
    together = bst.boost(df, ["a", "b"], "y", settings, fold="fold")
    for k, model in enumerate(together):
        (alone,) = bst.boost(df.withColumn("valid", F.col("fold") == k), ["a", "b"], "y", settings, valid="valid")
        assert alone.rounds == model.rounds and alone.losses == pytest.approx(model.losses)
        assert alone.gains == pytest.approx(model.gains)
    oof, mean, importance = bst.out_of_fold(df, df, ["a", "b"], "y", "id", settings)
    got = {r["id"]: r["score"] for r in oof.collect()}
    means = {r["id"]: r["score"] for r in mean.collect()}
    every = [{r["id"]: r["score"] for r in model.scored(df).collect()} for model in together]
    assert got == pytest.approx({r[0]: every[r[4]][r[0]] for r in rows})
    assert means == pytest.approx({r[0]: np.mean([e[r[0]] for e in every]) for r in rows})
    shares = importance.groupBy("fold").agg(F.sum("importance").alias("s")).collect()
    assert [r["s"] for r in shares] == pytest.approx([1.0] * 3)


def test_nulls_take_the_learnt_side(spark):
    rng = random.Random(1)
    made = [(i, None if i % 3 == 0 else rng.random(), 0.0, 0.0, 0, 1.0) for i in range(300)]
    made = [(i, a, b, 1.0 if a is None or a > 0.8 else 0.0, f, w) for i, a, b, _, f, w in made]
    (model,) = bst.boost(frame(spark, made), ["a", "b"], "y", bst.Settings(rounds=8, depth=2, rate=1.0, bins=200))
    scores = {r["id"]: r["score"] for r in model.scored(frame(spark, made)).collect()}
    assert all((scores[i] > 0.5) == (y == 1.0) for i, _, _, y, _, _ in made)
    assert model.gains["b"] == 0.0 and dict(model.importances())["a"] == 1.0
    phi, expected = tr.tree_shapley(frame(spark, made), model.model, ["id"], frame(spark, made))
    total = {r["id"]: r["t"] + expected for r in phi.groupBy("id").agg(F.sum("phi").alias("t")).collect()}
    assert total == pytest.approx({i: math.log(s / (1 - s)) for i, s in scores.items()})


def test_weights_and_nothing_to_learn(spark, rows):
    df = frame(spark, rows)
    settings = bst.Settings("squared", rounds=2, depth=2, rate=1.0, bins=100)
    (weighted,) = bst.boost(df, ["a", "b"], "y", settings, weight="w")
    (doubled,) = bst.boost(df.unionByName(df.where("w = 2")), ["a", "b"], "y", settings)
    a, b = ({r["id"]: r["score"] for r in x.scored(df).collect()} for x in (weighted, doubled))
    # quantile cuts of the doubled rows may differ a little
    assert np.mean([abs(a[i] - b[i]) for i in a]) < 0.02
    (flat,) = bst.boost(df.withColumn("a", F.lit(None).cast("double")).withColumn("b", F.lit(1.0)), ["a", "b"], "y", settings)
    assert {round(r["score"], 9) for r in flat.scored(df).collect()} == {round(np.mean([r[3] for r in rows]), 9)}
