"""The wrapper searches fit the learner that they name."""

import threading

import pytest
from pyspark.ml import classification as C

from tabloom.operators import models as m
from tabloom.operators import select as sel
from tabloom.plans import q_select, registry


@pytest.mark.parametrize(
    "query, function, place",
    [("n18_step_forward", "step_forward", 3), ("n19_step_backward", "step_backward", 3), ("n20_exhaustive", "exhaustive", 3), ("n36_compare_feature_lists", "compare_feature_lists", 4)],
)
def test_learners_of_searches(spark, monkeypatch, query, function, place):
    given = []
    monkeypatch.setattr(sel, function, lambda *args: given.extend(args))
    monkeypatch.setattr(q_select, "folded", lambda spark, sf: None)
    monkeypatch.setattr(q_select, "parts", lambda spark, sf: (None, None))
    registry.QUERIES[query](spark, None)
    if query.startswith("n36"):
        assert isinstance(given[place]["logistic"], C.LogisticRegression) and isinstance(given[place]["forest"], C.RandomForestClassifier)
    else:
        assert isinstance(given[place], C.RandomForestClassifier)


@pytest.mark.parametrize("query, function", [("n18_step_forward", "step_forward"), ("n19_step_backward", "step_backward"), ("n20_exhaustive", "exhaustive")])
def test_deep_forests_keep_the_nodes_of_rows(spark, monkeypatch, query, function):
    given = []
    monkeypatch.setattr(sel, function, lambda *args: given.extend(args))
    monkeypatch.setattr(q_select, "folded", lambda spark, sf: None)
    registry.QUERIES[query](spark, None)
    forest = given[3]
    assert forest.getCacheNodeIds() and forest.getNumTrees() == 100 and forest.getMaxDepth() == 30


def folded_rows(spark):
    rows = [(float(i * 7 % 31), float(i * 5 % 23), int((i * 7 % 31) + (i * 5 % 23) + i % 9 > 30), i % 3) for i in range(300)]
    return spark.createDataFrame(rows, "a double, b double, y int, fold int").coalesce(2)


def test_kept_nodes_give_the_same_forest(spark):
    rows = folded_rows(spark)
    plain = m.learner("forest", numTrees=10, maxDepth=30)
    kept = m.learner("forest", numTrees=10, maxDepth=30, cacheNodeIds=True)
    first, second = (m.fit(rows, ["a", "b"], "y", forest) for forest in (plain, kept))
    assert first.toDebugString.split("\n")[1:] == second.toDebugString.split("\n")[1:]


def test_fits_of_all_lists_and_folds_run_side_by_side(spark, monkeypatch):
    meeting = threading.Barrier(4, timeout=60)

    def evaluate(train, test, features, label, estimator, metric):
        meeting.wait()  # breaks unless two lists and two folds are under way together
        return {"a": 1.0, "b": 2.0}[features[0]] + test.first()["fold"]

    monkeypatch.setattr(m, "evaluate", evaluate)
    assert m.cv_scores(folded_rows(spark), [["a"], ["b"]], "y", None, "auc", folds=[0, 2]) == [2.0, 3.0]
    assert meeting.n_waiting == 0


@pytest.mark.parametrize("search, sizes", [("step_forward", (1,)), ("step_backward", (1,)), ("exhaustive", (1, 1))])
def test_searches_fit_in_few_tasks(spark, monkeypatch, search, sizes):
    """As many tasks as cores, or more by the rows, and not more than the table has; a small table stays as it is."""
    cores = spark.sparkContext.defaultParallelism
    seen = set()

    def evaluate(train, test, features, label, estimator, metric):
        seen.add((train.rdd.getNumPartitions(), train.count() + test.count()))
        return 0.5

    monkeypatch.setattr(m, "evaluate", evaluate)
    for parts, rows_a_task, want in ((3 * cores, 200, cores), (3 * cores, 10, min(3 * cores, max(cores, 30))), (1, 200, 1), (3 * cores, 300, 3 * cores)):
        seen.clear()
        monkeypatch.setattr(m, "TASK_ROWS", rows_a_task)
        getattr(sel, search)(folded_rows(spark).repartition(parts), ["a", "b"], "y", None, "auc", *sizes)
        assert seen == {(want, 300)}
