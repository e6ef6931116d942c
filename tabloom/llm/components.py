"""Connected components of a links table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.core import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours linked to the smallest among them and the node: larger neighbours (large star), or
    smaller ones and the node itself (small star). Minima are pre-aggregated; the join back may be split for hot nodes."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return out.filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the links (a, b) of 64-bit integers.

    Rounds are logarithmic in the longest path; each is written to the checkpoint folder, and nothing but two sums
    comes to the driver.
    """
    edges = checkpointed(links.select("a", "b").filter("a != b").distinct())
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    state = None
    while True:
        edges = checkpointed(_star(_star(edges, large=True), large=False))
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == state:
            break
        state = now
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
