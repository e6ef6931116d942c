"""Exact k nearest neighbours by Euclidean distance.

The training side is cut into blocks by nearest pivot and distance ring (the
pivot-partitioned kNN join of Lu et al., VLDB 2012): ring counts bound each score
row's k-th distance, the triangle inequality drops blocks that cannot hold a
neighbour, and every surviving block returns only its k best. Small rings of near
pivots are put together to blocks, large ones split, all to one size, so that a score
row is sent once for `BLOCK_ROWS` rows it may need. A block is sent once for every
`ASKED_ROWS` score rows that need it, and not at all where none does, so what is sent
follows the questions, not the product. Inside a block a matrix product picks the rows
that rounding can't keep from the k best; their distances are taken by differences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .core import checkpointed

PIVOTS = 128
RINGS = 8
BLOCK_ROWS = 20_000
ASKED_ROWS = 20_000
WORK_VALUES = 4_000_000
STRIP = 64


def _distances(points: np.ndarray, vecs: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - vecs) ** 2).sum(axis=-1))


def _candidates(part: np.ndarray, size: np.ndarray, vecs: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) pairs with all of the k nearest of each row, by squared distances from a matrix product: what
    rounding may move, there and in the differences, is allowed for. `size` and `sizes` are the squared lengths."""
    square = part @ vecs.T
    square *= -2
    square += size[:, None]
    square += sizes
    strips = len(vecs) // STRIP
    if strips >= k:  # the k-th smallest of the strips' minima has k values below it or equal
        least = square[:, : strips * STRIP].reshape(len(part), strips, STRIP).min(axis=2)
    else:
        least = square
    enough = np.partition(least, k - 1, axis=1)[:, k - 1]
    slack = 32 * (vecs.shape[1] + 8) * np.finfo(float).eps * (size + sizes.max())
    return np.nonzero(square <= (enough + slack)[:, None])


def _top_k(points: np.ndarray, ids: np.ndarray, vecs: np.ndarray, k: int):
    """Index pairs and distances of the k nearest per point, ties by id order."""
    order = np.argsort(ids, kind="stable")
    ids, vecs = ids[order], vecs[order]
    k = min(k, len(ids))
    if not k:
        return
    size, sizes = (points**2).sum(axis=1), (vecs**2).sum(axis=1)
    if np.isfinite(size).all() and np.isfinite(sizes).all():
        step = max(1, WORK_VALUES // len(vecs))
        for start in range(0, len(points), step):
            part = points[start : start + step]
            row, place = _candidates(part, size[start : start + step], vecs, sizes, k)
            dist = np.empty(len(row))
            some = max(1, WORK_VALUES // max(1, vecs.shape[1]))
            for at in range(0, len(row), some):
                dist[at : at + some] = _distances(part[row[at : at + some]], vecs[place[at : at + some]])
            best = np.lexsort((dist, row))  # stable: places ascend
            first = np.searchsorted(row, np.arange(len(part)))
            pick = best[(first[:, None] + np.arange(k)).ravel()]
            yield start + row[pick], ids[place[pick]], dist[pick]
        return
    step = max(1, WORK_VALUES // max(1, vecs.size))
    for start in range(0, len(points), step):
        part = points[start : start + step]
        dist = _distances(part[:, None, :], vecs[None, :, :])
        pick = np.argsort(dist, axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(start, start + len(part)), k)
        yield rows, ids[pick].ravel(), np.take_along_axis(dist, pick, axis=1).ravel()


def _matrix(col: pd.Series) -> np.ndarray:
    return np.array(col.tolist(), dtype=np.float64)


def _asked_blocks(points: np.ndarray, centre: np.ndarray, rings: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, block, part) of the blocks that may hold a neighbour of the points. A block is a ring, or the rings that
    one number in a column `block` holds together."""
    cell, near, far, n, parts = (rings[c].to_numpy() for c in ("cell", "near", "far", "n", "parts"))
    to_pivot = np.sqrt(((points[:, None, :] - centre[None, :, :]) ** 2).sum(axis=2))[:, cell]
    most = to_pivot + far
    order = np.argsort(most, axis=1)
    enough = np.cumsum(n[order], axis=1) >= min(k, n.sum())
    bound = np.take_along_axis(most, order, 1)[np.arange(len(points)), enough.argmax(axis=1)]
    least = np.maximum(0.0, np.maximum(to_pivot - far, near - to_pivot))
    asked = least <= bound[:, None] * (1 + 1e-9) + 1e-12
    if "block" in rings:
        first = np.flatnonzero(np.diff(rings["block"].to_numpy(), prepend=-1))
        asked, parts = np.logical_or.reduceat(asked, first, axis=1), parts[first]
    row, block = np.nonzero(asked)
    times = parts[block]
    part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(row, times), np.repeat(block, times), part


def _chain(centre: np.ndarray) -> np.ndarray:
    """The place of each pivot in a walk that goes on to the nearest pivot not yet visited."""
    place = np.zeros(len(centre), dtype=int)
    left = np.ones(len(centre), dtype=bool)
    at = 0
    for i in range(len(centre)):
        place[at], left[at] = i, False
        at = np.where(left, _distances(centre, centre[at]), np.inf).argmin()
    return place


def _blocks(rings: pd.DataFrame, centre: np.ndarray, block_rows: int) -> pd.DataFrame:
    """The rings in the order of blocks, with their `block` and the `parts` it is cut into."""
    rings = rings.assign(_place=_chain(centre)[rings["cell"].to_numpy(dtype=int)]).sort_values(["_place", "ring"], ignore_index=True).drop(columns="_place")
    block, number, held = [], -1, block_rows
    for n in rings["n"]:
        if held + n > block_rows:
            number, held = number + 1, 0
        held += n
        block.append(number)
    rings["block"] = np.array(block, dtype=int)
    rings["parts"] = np.ceil(rings.groupby("block")["n"].transform("sum") / block_rows).astype(int).clip(lower=1)
    return rings


def _routed(batch: pd.DataFrame, centre: np.ndarray, rings: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    """A row for each block that a score row asks, a bounded number of values at a time."""
    points, ids, vecs = _matrix(batch["vec"]), batch["id"].to_numpy(), batch["vec"].to_numpy()
    step = max(1, WORK_VALUES // max(centre.size, int(rings["parts"].sum())))
    piece = max(1, WORK_VALUES // max(1, points.shape[1]))
    for start in range(0, len(batch), step):
        row, block, part = _asked_blocks(points[start : start + step], centre, rings, k)
        for at in range(0, len(row), piece):
            some = slice(at, at + piece)
            pick = start + row[some]
            yield pd.DataFrame({"id": ids[pick], "vec": vecs[pick], "block": block[some], "part": part[some]})


def nearest(score: DataFrame, train: DataFrame, k: int, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, asked_rows: int = ASKED_ROWS) -> DataFrame:
    """(score_id, train_id, distance, rank) from tables of (id, vec array); rows with a null vector are left out."""
    found = _against_blocks(score, train, k, pivots, block_rows, asked_rows)
    # at most k candidates per block reach one score row
    best = Window.partitionBy("score_id").orderBy("distance", "train_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _types(score: DataFrame, train: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("score_id", score.schema["id"].dataType),
            T.StructField("train_id", train.schema["id"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )


def _against_blocks(
    score: DataFrame, train: DataFrame, k: int, pivots: int, block_rows: int, asked_rows: int
) -> DataFrame:
    spark = score.sparkSession
    # a row without a vector has no neighbours and is none
    score, train = (d.select("id", F.col("vec").cast("array<double>").alias("vec")).where("vec is not null") for d in (score, train))
    chosen = train.orderBy(F.xxhash64("id"), "id").limit(pivots).toPandas()
    centre = spark.sparkContext.broadcast(_matrix(chosen["vec"]))

    id_type = train.schema["id"].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            cell = np.empty(len(b), dtype=np.int32)
            far = np.empty(len(b))
            ids = np.arange(len(centre.value))
            for rows, pivot, dist in _top_k(_matrix(b["vec"]), ids, centre.value, 1):
                cell[rows], far[rows] = pivot, dist
            yield b.assign(cell=cell, far=far)

    # read four times below; placing compares every row with every pivot
    placed = checkpointed(train.mapInPandas(place, f"id {id_type}, vec array<double>, cell int, far double"))
    reach = placed.groupBy("cell").agg(F.max("far").alias("reach"))
    ringed = placed.join(reach, "cell").withColumn(
        "ring", F.least(F.floor(F.try_divide(F.col("far"), F.col("reach")) * RINGS), F.lit(RINGS - 1)).cast("int")
    ).withColumn("ring", F.coalesce("ring", F.lit(0)))
    # at most PIVOTS x RINGS rows
    rings = (
        ringed.groupBy("cell", "ring")
        .agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("near"), F.max("far").alias("far"))
        .orderBy("cell", "ring")
        .toPandas()
    )
    rings = _blocks(rings, centre.value, block_rows)
    plan, n_train = spark.sparkContext.broadcast(rings), int(rings["n"].sum())
    if not n_train:
        return spark.createDataFrame([], _types(score, train))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield from _routed(b, centre.value, plan.value, k)

    score_id_type = score.schema["id"].dataType.simpleString()
    asked = checkpointed(score.mapInPandas(route, f"id {score_id_type}, vec array<double>, block int, part int"))
    wanted = asked.groupBy("block", "part").agg(F.ceil(F.count(F.lit(1)) / asked_rows).cast("int").alias("lanes"))
    asked = asked.join(wanted, ["block", "part"]).withColumn("lane", F.pmod(F.xxhash64("id"), F.col("lanes")).cast("int")).drop("lanes")
    index = spark.createDataFrame(
        [tuple(map(int, r)) for r in rings[["cell", "ring", "block", "parts"]].to_numpy()],
        "cell int, ring int, block int, parts int",
    )
    stored = (
        ringed.join(index, ["cell", "ring"])
        .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        .join(wanted, ["block", "part"])
        .select("id", "vec", "block", "part", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"))
    )

    def match(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(t):
            sid = q["id"].to_numpy()
            for rows, tid, dist in _top_k(_matrix(q["vec"]), t["id"].to_numpy(), _matrix(t["vec"]), k):
                out.append(pd.DataFrame({"score_id": sid[rows], "train_id": tid, "distance": dist}))
        return pd.concat(out) if out else pd.DataFrame({"score_id": [], "train_id": [], "distance": []})

    on = ["block", "part", "lane"]
    return asked.groupBy(*on).cogroup(stored.groupBy(*on)).applyInPandas(match, _types(score, train))


def vote(neighbours: DataFrame, labels: DataFrame, weighted: bool = False) -> DataFrame:
    """Majority label per score row, ties to the smallest label. With ``weighted``
    a vote counts 1/distance and an exact hit outweighs everything else."""
    found = neighbours.join(labels.select(F.col("id").alias("train_id"), "label"), "train_id")
    if weighted:
        hit = found.groupBy("score_id").agg(F.min("distance").alias("_closest"))
        found = found.join(hit, "score_id").withColumn(
            "w",
            F.when(F.col("_closest") == 0, (F.col("distance") == 0).cast("double")).otherwise(
                F.try_divide(F.lit(1.0), F.col("distance"))
            ),
        )
    else:
        found = found.withColumn("w", F.lit(1.0))
    tally = found.groupBy("score_id", "label").agg(F.sum("w").alias("votes"))
    return tally.groupBy("score_id").agg(F.min_by("label", F.struct(-F.col("votes"), F.col("label"))).alias("predicted"))


def neighbour_mean(neighbours: DataFrame, targets: DataFrame) -> DataFrame:
    found = neighbours.join(targets.select(F.col("id").alias("train_id"), "target"), "train_id")
    return found.groupBy("score_id").agg(F.avg("target").alias("predicted"))
