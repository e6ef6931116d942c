"""Ordered operators against plain code, with groups cut into several ranges."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators import ordered
from tabloom.operators.windows import lag_pairs, rolling


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        # group "a" holds most rows and most of its values are one tie
        g = "a" if i % 3 else f"g{i % 7}"
        v = 5.0 if rng.random() < 0.3 else round(rng.gauss(0, 100), 1)
        rows.append((i, g, None if i % 50 == 0 else v))
    return spark.createDataFrame(rows, "id long, g string, v double").repartition(5).cache()


@pytest.fixture(autouse=True)
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def linear(values, p):
    values = sorted(values)
    if not values:
        return None
    spot = p * (len(values) - 1)
    low = int(spot)
    return values[low] + (spot - low) * (values[min(low + 1, len(values) - 1)] - values[low])


def test_quantiles_are_exact(values):
    probs = [0.0, 0.01, 0.25, 0.37, 0.5, 0.75, 0.99, 1.0]
    have = [r["v"] for r in values.collect() if r["v"] is not None]
    got = ordered.quantiles(values, ["v", "id"], probs)
    assert got["v"] == pytest.approx([linear(have, p) for p in probs], abs=1e-12)
    assert got["id"] == pytest.approx([linear(range(3000), p) for p in probs], abs=1e-9)


def test_quantiles_of_constant_and_empty(spark):
    df = spark.createDataFrame([(1.0, None)] * 10, "a double, b double")
    assert ordered.quantiles(df, ["a", "b"], [0.0, 0.5, 1.0]) == {"a": [1.0] * 3, "b": [None] * 3}
    assert ordered.quantiles(df.where("a > 1"), ["a"], [0.5]) == {"a": [None]}


def test_nan_is_the_largest_number(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,), (3.0,), (None,)], "v double")
    got = ordered.quantiles(df, ["v"], [0.0, 1 / 3, 1.0])["v"]
    assert got[:2] == [1.0, 2.0] and got[2] != got[2]


def test_group_quantiles(values):
    probs = {"lo": 0.1, "mid": 0.5, "hi": 0.93}
    rows = values.collect()
    for r in ordered.group_quantiles(values, ["g"], "v", probs).collect():
        have = [x["v"] for x in rows if x["g"] == r["g"] and x["v"] is not None]
        for name, p in probs.items():
            assert r[name] == pytest.approx(linear(have, p), abs=1e-12)


def test_group_quantiles_keep_all_null_groups(spark):
    df = spark.createDataFrame([("x", None), ("y", 1.0), (None, 2.0)], "g string, v double")
    rows = {r["g"]: r["m"] for r in ordered.group_quantiles(df, ["g"], "v", {"m": 0.5}).collect()}
    assert rows == {"x": None, "y": 1.0, None: 2.0}


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(values, descending):
    counted = values.groupBy("g", "v").agg(F.count("*").alias("n"))
    got = ordered.running_sums(counted, ["g"], "v", {"n": F.col("n")}, descending).collect()
    for g in {r["g"] for r in got}:
        mine = [r for r in got if r["g"] == g]
        # nulls last in either direction
        mine.sort(key=lambda r: (r["v"] is None, -r["v"] if descending and r["v"] is not None else r["v"] or 0.0))
        total = 0
        for r in mine:
            total += r["n"]
            assert r["cum_n"] == total
        assert all(r["total_n"] == total for r in mine)


def test_one_value_only_is_cut_by_the_ties(spark):
    df = spark.range(2000).select("id", F.lit(1.0).alias("v"))
    out = ordered.positions(df, [], "v", ["id"]).collect()
    assert all(r["pos"] == r["id"] + 1 and r["size"] == 2000 for r in out)


def test_positions_with_ties_and_no_group(values):
    rows = [(r["v"], r["id"]) for r in values.where("v is not null").collect()]
    rank = {i: k + 1 for k, (_, i) in enumerate(sorted(rows))}
    for r in ordered.positions(values.where("v is not null"), [], "v", ["id"]).collect():
        assert (r["pos"], r["size"]) == (rank[r["id"]], len(rows))


def test_positions_of_text(spark):
    df = spark.createDataFrame([("b",), ("aaaaaaaab",), ("aaaaaaaaa",), (None,), ("é",)], "t string")
    assert {r["t"]: r["pos"] for r in ordered.positions(df, [], "t").collect()} == {"aaaaaaaaa": 1, "aaaaaaaab": 2, "b": 3, "é": 4, None: 5}


def test_hash_positions_are_a_stable_permutation(values):
    a = ordered.hash_positions(values, ["g"], ["id"], seed=5)
    b = ordered.hash_positions(values.repartition(3), ["g"], ["id"], seed=5)
    c = ordered.hash_positions(values, ["g"], ["id"], seed=6)
    pa, pb, pc = (x.select("id", "g", "pos", "size").orderBy("id").toPandas() for x in (a, b, c))
    pd.testing.assert_frame_equal(pa, pb)
    assert not pa["pos"].equals(pc["pos"])
    for _, part in pa.groupby("g"):
        assert sorted(part["pos"]) == list(range(1, len(part) + 1))
        assert (part["size"] == len(part)).all()


@pytest.mark.parametrize("chunk", [7, 25, 400])
def test_windows_over_chunks(values, chunk):
    rows = values.withColumn("v", F.coalesce("v", F.lit(0.0)))
    for fn in (lambda n: rolling(rows, ["g"], "id", "v", 6, chunk=n), lambda n: lag_pairs(rows, ["g"], "id", "v", 3, chunk=n)):
        a = fn(10**9).orderBy("id").toPandas()
        b = fn(chunk).orderBy("id").toPandas()
        pd.testing.assert_frame_equal(a, b[a.columns], check_dtype=False)
        assert len(a) == 3000


def test_group_stats(values):
    aggs = [F.count("id").alias("n"), F.max("v").alias("top")]
    rows = values.collect()
    for r in ordered.group_stats(values, ["g"], aggs, {"mid": ("v", 0.5), "id_mid": ("id", 0.5)}).collect():
        mine = [x for x in rows if x["g"] == r["g"]]
        assert r["n"] == len(mine) and r["top"] == max(x["v"] for x in mine if x["v"] is not None)
        assert r["mid"] == pytest.approx(linear([x["v"] for x in mine if x["v"] is not None], 0.5))
        assert r["id_mid"] == pytest.approx(linear([x["id"] for x in mine], 0.5))
