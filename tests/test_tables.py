"""Hand-sized tables with known results."""

import datetime

import pytest
from pyspark.sql import functions as F

from tabloom.operators import joins, profile as prof, relational as rel, windows as win
from tabloom.operators.ordered import group_stats
from tabloom.sources import tables as src


@pytest.fixture(scope="module")
def txn(spark):
    rows = [(1, 10, 1, "2020-01-01"), (1, 30, 2, "2020-01-01"), (1, 20, 1, "2020-02-05"), (2, 5, 1, "2020-03-01"), (2, 7, 4, "2020-03-09")]
    df = spark.createDataFrame(rows, "customer_id int, amount int, quantity int, day string")
    return df.withColumn("day", F.to_date("day"))


def test_customer_statistics(txn):
    aggs = [*prof.stat_exprs({"amount": ["min", "max", "sum", "std"], "day": ["nunique", "count"]})]
    out = {r["customer_id"]: r for r in group_stats(txn, ["customer_id"], aggs, {"median": ("amount", 0.5)}).collect()}
    one = out[1]
    assert (one["amount_min"], one["amount_max"], one["amount_sum"], one["amount_std"], one["median"]) == (10, 30, 60, 10.0, 20.0)
    assert (one["day_nunique"], one["day_count"]) == (2, 3)
    assert out[2]["median"] == 6.0


def test_recency(txn):
    out = win.recency(txn, "customer_id", "day", F.lit("2020-03-10").cast("date"))
    got = {r["customer_id"]: (r["last_seen"], r["recency_days"]) for r in out.collect()}
    assert got == {1: (datetime.date(2020, 2, 5), 34), 2: (datetime.date(2020, 3, 9), 1)}


def test_running_by_period_gives_peers_one_value_and_keeps_null_keys(txn):
    more = txn.unionByName(txn.limit(1).withColumn("customer_id", F.lit(None).cast("int")))
    out = win.running_by_period(more, "customer_id", "day", "amount", "month")
    rows = sorted((r["customer_id"] or 0, r["dense_rank"], r["running_sum"], r["running_count"]) for r in out.collect())
    assert rows == [(0, 1, 10, 1), (1, 1, 40, 2), (1, 1, 40, 2), (1, 2, 60, 3), (2, 1, 12, 2), (2, 1, 12, 2)]


def test_subset_statistics_match_filtered_ones(txn):
    inside = txn.groupBy("customer_id").agg(*prof.stat_exprs({"amount": ["mean", "size"]}, "BIG_", F.col("amount") > 8))
    got = {r["customer_id"]: (r["BIG_amount_mean"], r["BIG_amount_size"]) for r in inside.collect()}
    assert got == {1: (20.0, 3), 2: (None, 0)}


def test_box_stats_without_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    rows = {r["variable"]: r for r in prof.box_stats(df, ["a", "b"]).collect()}
    assert rows["a"]["q50"] is None and rows["a"]["n_outlier"] == 0
    assert rows["b"]["q50"] == 1.5


def test_approximate_quantiles_stay_within_their_bound(spark):
    df = spark.range(10_001).withColumn("x", F.col("id").cast("double"))
    rows = prof.quantile_table(df, ["x"], [0.1, 0.5], accuracy=1000).collect()
    assert all(abs(r["value"] - r["prob"] * 10_000) <= 11 for r in rows)


def test_lookup_and_anti_join(spark, txn):
    state = spark.createDataFrame([("1", 0.5)], "label string, value double")
    out = joins.lookup(txn, "customer_id", state, "code", F.lit(-1.0))
    assert {(r["customer_id"], r["code"]) for r in out.collect()} == {(1, 0.5), (2, -1.0)}
    left = joins.labels_only_in(txn, txn.where("customer_id = 1"), "customer_id").collect()
    assert [r["customer_id"] for r in left] == [2]


def test_relational_edges(spark):
    df = spark.createDataFrame([(1.0, 0.0, "3"), (None, 2.0, "x"), (float("nan"), 4.0, None)], "a double, b double, s string")
    clean = src.nan_to_null(df)
    assert clean.where("a is null").count() == 2
    out = clean.select(
        rel.ratio(F.col("a"), F.col("b")).alias("r"),
        rel.positive_part(F.col("a") - 5).alias("p"),
        rel.lenient_number(F.col("s")).alias("n"),
        rel.recode(F.col("s"), {"x": 1}).alias("m"),
    ).collect()
    assert [tuple(r) for r in out] == [(None, 0.0, 3.0, None), (None, None, None, 1), (None, None, None, None)]


def test_seeded_sample_ignores_partitioning(spark):
    df = spark.range(1000)
    a = rel.sample_rows(df, 50, ["id"], 1).collect()
    assert sorted(a) == sorted(rel.sample_rows(df.repartition(13), 50, ["id"], 1).collect()) and len(a) == 50


def test_correlations_skip_null_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None), (4.0, 8.0)], "a double, b double")
    assert prof.correlations(df, ["a", "b"]).first()["r"] == pytest.approx(1.0)


def test_variance_merges_over_two_roll_ups_without_cancelling(spark):
    import numpy as np
    from tabloom.operators.profile import merged_moments, moment_parts, sample_variance

    rng = np.random.default_rng(3)
    rows = [(k % 7, k % 30, 1e8 + float(rng.random()), None if k % 5 else float(k)) for k in range(400)] + [(99, 1000, None, 1.0)]
    df = spark.createDataFrame(rows, "customer int, `order` int, x double, y double").repartition(5)
    parts = df.groupBy("customer", "order").agg(*moment_parts(["x", "y"]))
    merged = merged_moments(parts, "customer", ["x", "y"]).select("customer", *[sample_variance(c).alias(c) for c in "xy"])
    got = {r["customer"]: r for r in merged.collect()}
    for c in range(7):
        x = np.array([r[2] for r in rows if r[0] == c])
        y = np.array([r[3] for r in rows if r[0] == c and r[3] is not None])
        assert got[c]["x"] == pytest.approx((x - 1e8).var(ddof=1), rel=1e-6)
        assert got[c]["y"] == pytest.approx(y.var(ddof=1))
    assert got[99]["x"] is None and got[99]["y"] is None


def test_joined_fixtures_hold_no_table_at_the_driver(spark):
    from tabloom.plans.registry import fixture

    df = fixture(spark, "/root/testdata/sf0.001", "fx_num", merge=True)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
