"""Tree ensembles: scores, and Shapley values against enumeration of all coalitions and all background rows."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import models as m, trees as tr

NAMES = ("a", "b", "c")


def random_tree(rng, depth):
    nodes = []

    def grow(level):
        at = len(nodes)
        nodes.append(None)
        if level == depth or rng.random() < 0.15:
            nodes[at] = (-1, math.nan, -1, -1, False, rng.gauss(0, 1))
        else:
            f, cut, side = rng.randrange(3), rng.choice([0.2, 0.4, 0.5, 0.7]), rng.random() < 0.5
            left, right = grow(level + 1), grow(level + 1)
            nodes[at] = (f, cut, left, right, side, 0.0)
        return at

    grow(0)
    return tr.Tree.of(nodes)


@pytest.fixture(scope="module")
def ensemble():
    rng = random.Random(5)
    return tr.Trees(NAMES, tuple(random_tree(rng, 4) for _ in range(6)), (1.0, 0.5, -2.0, 1.0, 0.1, 3.0), 0.7)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    return [(i, *[None if rng.random() < 0.2 else rng.choice([0.2, 0.5, rng.random()]) for _ in range(3)]) for i in range(40)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(3)


def array(rows):
    return np.array([[math.nan if v is None else v for v in r[1:]] for r in rows])


def enumerated(model, x, background):
    """Shapley values by all coalitions over every background row."""
    value = {}
    for s in itertools.product([0, 1], repeat=3):
        mixed = np.where(np.array(s, bool), x, background)
        value[s] = model.predict(mixed).mean()
    out = []
    for i in range(3):
        total = 0.0
        for s in value:
            if not s[i]:
                size = sum(s)
                total += math.factorial(size) * math.factorial(2 - size) / 6 * (value[s[:i] + (1,) + s[i + 1 :]] - value[s])
        out.append(total)
    return out


def test_tree_shapley_equals_enumeration(spark, ensemble, rows):
    train, test = rows[:25], rows[25:]
    phi, expected = tr.tree_shapley(frame(spark, test), ensemble, ["id"], frame(spark, train))
    got = {(r["id"], r["feature"]): (r["value"], r["phi"]) for r in phi.collect()}
    x, background = array(test), array(train)
    assert expected == pytest.approx(ensemble.predict(background).mean())
    assert len(got) == 3 * len(test)
    for i, own in zip((r[0] for r in test), x):
        want = enumerated(ensemble, own, background)
        assert [got[i, c][1] for c in NAMES] == pytest.approx(want, abs=1e-12)
        assert [got[i, c][0] for c in NAMES] == [None if math.isnan(v) else v for v in own]


def test_scores_with_nulls(spark, ensemble, rows):
    got = {r["id"]: r["score"] for r in tr.scored_by(frame(spark, rows), ensemble).collect()}
    assert [got[i] for i in range(len(rows))] == pytest.approx(ensemble.predict(array(rows)).tolist())


def test_unused_features_and_single_leaves(spark, rows):
    model = tr.Trees(NAMES, (tr.Tree.of([(-1, math.nan, -1, -1, False, 2.0)]),), (1.0,))
    phi, expected = tr.tree_shapley(frame(spark, rows), model, ["id"], frame(spark, rows))
    assert expected == 2.0 and {r["phi"] for r in phi.collect()} == {0.0}


@pytest.mark.parametrize(("kind", "regression", "params"), [
    ("forest", False, {"numTrees": 5, "maxDepth": 4}), ("tree", True, {"maxDepth": 3}), ("boosted", True, {"maxIter": 4, "maxDepth": 3}), ("forest", True, {"numTrees": 4, "maxDepth": 3}),
])
def test_values_add_up_for_fitted_models(spark, kind, regression, params):
    rng = random.Random(1)
    made = [(i, rng.random(), rng.random(), rng.random()) for i in range(200)]
    df = frame(spark, made).withColumn("y", ((F.col("a") + F.col("b") * F.col("c")) > 0.7).cast("double"))
    model = m.fit(df, NAMES, "y", m.learner(kind, regression, **params))
    phi, expected = tr.tree_shapley(df, tr.trees_of(model, NAMES), ["id"], df)
    score = m.scored(model, df, NAMES)
    rows = phi.groupBy("id").agg(F.sum("phi").alias("t")).join(score, "id").collect()
    assert len(rows) == 200
    assert [r["t"] + expected for r in rows] == pytest.approx([r["score"] for r in rows], abs=1e-9)


def test_boosted_classifier_is_explained_on_its_margin(spark):
    rng = random.Random(2)
    df = frame(spark, [(i, rng.random(), rng.random(), 0.5) for i in range(150)]).withColumn("y", (F.col("a") > F.col("b")).cast("double"))
    model = m.fit(df, NAMES, "y", m.learner("boosted", maxIter=3, maxDepth=2))
    got = {r["id"]: r["score"] for r in tr.scored_by(df, tr.trees_of(model, NAMES)).collect()}
    for r in m.scored(model, df, NAMES).collect():
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-2 * got[r["id"]])))
