import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators import neighbours
from tabloom.operators.joins import nearest_place


def brute(score, train, k):
    rows = []
    for sid, s in score:
        near = sorted((float(np.linalg.norm(np.array(s) - np.array(t))), tid) for tid, t in train)[:k]
        rows += [(sid, tid, d, i + 1) for i, (d, tid) in enumerate(near)]
    return pd.DataFrame(rows, columns=["score_id", "train_id", "distance", "rank"])


@pytest.mark.parametrize("shape", ["clusters", "one_hot_point"])
def test_blocks_equal_brute_force(spark, shape):
    rng = np.random.default_rng(0)
    if shape == "clusters":
        centres = rng.normal(size=(6, 3)) * 20
        train = [(i, (centres[i % 6] + rng.normal(size=3)).tolist()) for i in range(400)]
    else:  # a third of the rows are the same point
        train = [(i, [1.0, 1.0, 1.0] if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(400)]
    score = [(1000 + i, (rng.normal(size=3) * 10).tolist()) for i in range(60)] + [(2000, [1.0, 1.0, 1.0])]
    s = spark.createDataFrame(score, "id long, vec array<double>")
    t = spark.createDataFrame(train, "id long, vec array<double>")
    want = brute(score, train, 5)

    for sizes in ({}, {"pivots": 7, "block_rows": 30, "asked_rows": 10}):
        got = neighbours.nearest(s, t, 5, **sizes)
        got = got.orderBy("score_id", "rank").toPandas()
        assert (got["train_id"].values == want["train_id"].values).all()
        assert got["distance"].values == pytest.approx(want["distance"].values, abs=1e-9)


def test_votes(spark):
    near = spark.createDataFrame(
        [(1, 10, 0.5, 1), (1, 11, 1.0, 2), (1, 12, 1.0, 3), (2, 10, 0.0, 1), (2, 11, 0.1, 2), (2, 12, 0.1, 3)],
        "score_id long, train_id long, distance double, rank int",
    )
    labels = spark.createDataFrame([(10, "b"), (11, "a"), (12, "a")], "id long, label string")
    plain = {r["score_id"]: r["predicted"] for r in neighbours.vote(near, labels).collect()}
    weighted = {r["score_id"]: r["predicted"] for r in neighbours.vote(near, labels, weighted=True).collect()}
    assert plain == {1: "a", 2: "a"}
    assert weighted == {1: "a", 2: "b"}  # 2 + ties on 1: 2.0 each, smallest label; 2: exact hit


def test_nearest_place(spark):
    people = [(i, 13 + i / 50, 100 + i / 70) for i in range(50)]
    places = [(f"p{i}", 13 + i / 40, 100.5 - i / 90) for i in range(40)]

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6378 * math.asin(math.sqrt(h))

    got = nearest_place(
        spark.createDataFrame(people, "id long, lat double, lon double"),
        "lat", "lon", spark.createDataFrame(places, "place string, latitude double, longitude double"), "id",
    ).collect()
    assert len(got) == 50
    for r in got:
        best = min((km(r["lat"], r["lon"], la, lo), p) for p, la, lo in places)
        assert r["nearest"] == best[1] and r["km"] == pytest.approx(best[0], abs=1e-9)


def test_null_vectors_have_no_neighbours_and_are_none(spark):
    t = spark.createDataFrame([(1, [0.0]), (2, None), (3, [5.0])], "id long, vec array<double>")
    s = spark.createDataFrame([(10, [1.0]), (11, None)], "id long, vec array<double>")
    got = [(r["score_id"], r["train_id"]) for r in neighbours.nearest(s, t, 2).orderBy("rank").collect()]
    assert got == [(10, 1), (10, 3)]


def test_nearest_place_in_both_forms(spark):
    rng = np.random.default_rng(1)
    places = spark.createDataFrame([(f"p{i}", float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-80, 80, (40, 2)))] + [("none", None, 1.0)], "place string, latitude double, longitude double")
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-80, 80, (100, 2)))] + [(1000, None, 2.0)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double")
    short = {r["id"]: (r["nearest"], r["km"]) for r in nearest_place(df, "lat", "lon", places, "id").collect()}
    many = {r["id"]: (r["nearest"], r["km"]) for r in nearest_place(df, "lat", "lon", places.where("latitude is not null"), "id", most=10).collect()}
    assert short[1000] == (None, None) == many[1000] and len(short) == 101
    for i in range(100):
        assert short[i][0] == many[i][0] and short[i][1] == pytest.approx(many[i][1])


def test_routing_holds_few_values():
    """The rows sent to blocks are made a piece at a time, however many blocks a row asks."""
    import tracemalloc

    rng = np.random.default_rng(1)
    points, centre = rng.normal(size=(3000, 64)), rng.normal(size=(128, 64))
    rings = pd.DataFrame({"cell": np.repeat(np.arange(128), 8), "near": 0.0, "far": 50.0, "n": 10, "parts": np.arange(1024) % 2 + 1})
    batch = pd.DataFrame({"id": np.arange(3000), "vec": list(points)})
    asked = np.zeros(3000, int)
    tracemalloc.start()
    for piece in neighbours._routed(batch, centre, rings, 5):
        assert len(piece) * 64 <= neighbours.WORK_VALUES
        asked += np.bincount(piece["id"], minlength=3000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (asked == rings["parts"].sum()).all()  # balls as wide as these leave no block out
    assert peak < 300e6


def test_a_score_row_is_sent_once_for_many_small_rings(spark, monkeypatch):
    """Where the triangle inequality leaves nothing out, a row goes to as many blocks as the train rows fill."""
    rng = np.random.default_rng(2)
    t = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(900, 24)).tolist())], "id long, vec array<double>")
    s = spark.createDataFrame([(5000 + i, v) for i, v in enumerate(rng.normal(size=(20, 24)).tolist())], "id long, vec array<double>")
    written = []
    plain = neighbours.checkpointed
    monkeypatch.setattr(neighbours, "checkpointed", lambda df: written.append(plain(df)) or written[-1])
    assert neighbours.nearest(s, t, 3, block_rows=300).count() == 60
    assert 20 * 3 <= written[-1].count() <= 20 * 6


@pytest.mark.parametrize("case", ["plain", "far", "copies", "few", "nan", "huge"])
def test_distances_of_a_block_are_exact(case, monkeypatch):
    rng = np.random.default_rng(4)
    vecs, points = rng.normal(size=(700, 16)), rng.normal(size=(50, 16))
    if case == "far":  # squared lengths drown the differences
        vecs, points = vecs * 1e-3 + 1e5, points * 1e-3 + 1e5
    elif case == "copies":
        vecs[::3] = vecs[0]
        points[:10] = vecs[0]
    elif case == "few":
        vecs = vecs[:3]
    elif case == "nan":
        vecs[5, 2] = np.nan
    elif case == "huge":
        vecs[5] = 1e200
    ids = rng.permutation(len(vecs))
    monkeypatch.setattr(neighbours, "WORK_VALUES", 5000)
    dist = np.sqrt(((points[:, None, :] - vecs[None, :, :]) ** 2).sum(axis=2))
    want = [sorted(zip(np.nan_to_num(d, nan=np.inf), ids))[:5] for d in dist]
    got = [[] for _ in points]
    for row, found, d in neighbours._top_k(points, ids, vecs, 5):
        for r, i, x in zip(row.tolist(), found.tolist(), d.tolist()):
            got[r].append((x, i))
    assert got == want


def test_no_train_rows(spark):
    s = spark.createDataFrame([(1, [1.0])], "id long, vec array<double>")
    assert neighbours.nearest(s, s.where("id < 0"), 2).count() == 0
