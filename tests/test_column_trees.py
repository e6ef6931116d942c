"""Trees on single columns against a recursive search, folds, and the number of jobs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import column_trees as ct, discretise as disc, select as sel


def best_leaves(x, y, depth):
    """(hi, value, n) of the leaves of an exhaustive tree."""
    if depth:
        best = None
        values = sorted(set(x))
        for a, b in zip(values, values[1:]):
            left = x <= a
            after = y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum()
            if after > y.sum() ** 2 / len(y) + 1e-9 and (best is None or after > best[0]):
                best = after, (a + b) / 2
        if best is not None:
            left = x <= best[1]
            below = best_leaves(x[left], y[left], depth - 1)
            return [*below[:-1], (best[1], *below[-1][1:]), *best_leaves(x[~left], y[~left], depth - 1)]
    return [(math.inf, y.mean(), len(y))]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = []
    for i in range(300):
        a, b = rng.choice([None, *range(12)]), round(rng.gauss(0, 1), 1)
        y = float(rng.random() < (0.8 if (a or 0) > 6 else 0.3)) if rng.random() > 0.03 else None
        out.append((i, None if a is None else float(a), b, 1.0, y, i % 3))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, a double, b double, k double, y double, fold int").repartition(4)


def column(rows, place, keep=lambda r: True):
    kept = [r for r in rows if r[place] is not None and r[4] is not None and keep(r)]
    return np.array([r[place] for r in kept]), np.array([r[4] for r in kept])


def test_leaves_equal_the_exhaustive_search(spark, rows):
    values = ct.counted_values(frame(spark, rows), ["a", "b", "k"], "y", "fold")
    leaves = ct.grow(values, [1, 2, 4], folds=3).orderBy("position").collect()
    for name, place in (("a", 1), ("b", 2), ("k", 3)):
        for model in (-1, 0, 1, 2):
            x, y = column(rows, place, lambda r: r[5] != model)
            for depth in (1, 2, 4):
                got = [(r["hi"], r["value"], r["n"]) for r in leaves if (r["variable"], r["model"], r["depth"]) == (name, model, depth)]
                want = best_leaves(x, y, depth)
                assert [g[0] for g in got] == pytest.approx([w[0] for w in want])
                assert [g[1] for g in got] == pytest.approx([w[1] for w in want])
                assert [g[2] for g in got] == [w[2] for w in want]


@pytest.mark.parametrize("regression", [True, False])
def test_depth_is_the_best_over_the_folds(spark, rows, regression):
    df = frame(spark, rows)
    stage = disc.TreeBins("y", ["a", "b"], depths=(1, 2, 3), folds=3, regression=regression, key=["id"])
    folded = stage._with_folds(df, ["a", "b"]).collect()
    state = stage.fit(df).state.collect()
    for name in "ab":
        worth = {}
        for depth in (1, 2, 3):
            found = []
            for k in range(3):
                train = [(r[name], r["y"]) for r in folded if r["_fold"] != k and r[name] is not None]
                test = [(r[name], r["y"]) for r in folded if r["_fold"] == k and r[name] is not None]
                leaves = best_leaves(*map(np.array, zip(*train)), depth)
                pred = [next(v for hi, v, _ in leaves if x <= hi) for x, _ in test]
                if regression:
                    found.append(-np.mean([(p - y) ** 2 for p, (_, y) in zip(pred, test)]))
                else:
                    pos, neg = ([p for p, (_, y) in zip(pred, test) if y == v] for v in (1.0, 0.0))
                    found.append(np.mean([(p > q) + (p == q) / 2 for p in pos for q in neg]))
            worth[depth] = round(np.mean(found), 12)
        depth = max(worth, key=lambda d: (worth[d], -d))
        whole = [(r[name], r["y"]) for r in folded if r[name] is not None]
        want = best_leaves(*map(np.array, zip(*whole)), depth)
        got = sorted((r["position"], r["hi"], r["value"]) for r in state if r["variable"] == name)
        assert [g[1] for g in got] == pytest.approx([w[0] for w in want]) and [g[2] for g in got] == pytest.approx([w[1] for w in want])


def test_jobs_do_not_depend_on_the_columns(spark, rows):
    tracker = spark.sparkContext.statusTracker()

    def jobs(cols):
        group = f"trees-{len(cols)}"
        spark.sparkContext.setJobGroup(group, group)
        ct.grow(ct.counted_values(wide, cols, "y"), [2]).count()
        spark.sparkContext.setJobGroup("", "")
        return len(tracker.getJobIdsForGroup(group))

    wide = frame(spark, rows).withColumns({f"c{i}": F.col("b") * i for i in range(12)}).cache()
    wide.count()
    assert abs(jobs(["b"]) - jobs([f"c{i}" for i in range(12)])) <= 3
    wide.unpersist()


def test_scores_of_single_features(spark, rows):
    train, test = frame(spark, rows[:200]), frame(spark, rows[200:])
    got = {r["variable"]: r["value"] for r in sel.single_feature_scores(train, test, ["a", "b"], "y", "rmse", depth=2).collect()}
    for name, place in (("a", 1), ("b", 2)):
        leaves = best_leaves(*column(rows[:200], place), 2)
        x, y = column(rows[200:], place)
        pred = np.array([next(v for hi, v, _ in leaves if u <= hi) for u in x])
        assert got[name] == pytest.approx(np.sqrt(((y - pred) ** 2).mean()))
    with pytest.raises(ValueError):
        sel.single_feature_scores(train, test, ["a"], "y", "f1")
    none = ct.grow(ct.counted_values(train.where("a is null"), ["a"], "y"), [2])
    assert none.count() == 0
