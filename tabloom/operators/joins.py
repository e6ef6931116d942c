"""Joins of states and child tables to rows.

No broadcast is forced: states are local relations of known size or fresh
aggregates, so Catalyst and AQE broadcast them only below the size threshold
and fall back to a (skew-split) sort-merge join above it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.maths import haversine
from .neighbours import nearest


def group_stat_back(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """Attach group statistics to every row: partial aggregation, then a left join
    (a window would pull a whole hot group into one task)."""
    stats = df.groupBy(*keys).agg(*[e.alias(n) for n, e in aggs.items()])
    return df.join(stats, list(keys), "left")


def attach_children(parent: DataFrame, key: str, children: Sequence[DataFrame]) -> DataFrame:
    """Left-join child rollups that hold one row per key."""
    out = parent
    for child in children:
        out = out.join(child, key, "left")
    return out


def lookup(df: DataFrame, col: str, state: DataFrame, out: str, fallback: Column | None = None) -> DataFrame:
    """Left join of a (label, value) state on a column; unmapped labels get the fallback or null."""
    s = state.select(F.col("label").alias("_label"), F.col("value").alias("_value"))
    joined = df.join(s, F.col(col).cast("string") == F.col("_label"), "left")
    value = F.col("_value") if fallback is None else F.coalesce(F.col("_value"), fallback)
    return joined.withColumn(out, value).drop("_label", "_value")


def labels_only_in(left: DataFrame, right: DataFrame, col: str) -> DataFrame:
    """Labels of the left table that the right table does not have."""
    a = left.select(col).where(F.col(col).isNotNull()).distinct()
    return a.join(right.select(col).distinct(), col, "left_anti")


def keep_listed(df: DataFrame, col: str, listed: DataFrame) -> DataFrame:
    return df.join(listed.select(col), col, "left_semi")


def label_profile(df: DataFrame, label: str, target: str) -> DataFrame:
    """Row share and target mean per label in one aggregation."""
    grouped = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("target_mean"))
    rows = df.agg(F.count(F.lit(1))).scalar()
    return grouped.select(label, "n", (F.col("n") / rows).alias("share"), "target_mean")


#: Places that every row is compared with inside its task; a longer list goes through the neighbour search.
PLACES = 4096


def nearest_place(df: DataFrame, lat: str, lon: str, places: DataFrame, key: str, most: int = PLACES) -> DataFrame:
    """Nearest of a set of (place, latitude, longitude), the smallest name of equally near ones, and its distance in km.

    A short list, counted first, is an array in each task, so rows aren't shuffled. A longer one is searched exactly as
    points of the unit sphere, whose chords are ordered as the arcs; the key must then tell rows apart."""
    listed = places.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    short = listed.limit(most + 1).collect()
    if len(short) > most:
        return _nearest_of_many(df, lat, lon, places, key)
    if not short:
        return df.withColumns({"nearest": F.lit(None).cast(places.schema["place"].dataType), "km": F.lit(None).cast("double")})
    spots = F.array(*[F.struct(F.lit(r["place"]).alias("place"), F.lit(float(r["latitude"])).alias("la"), F.lit(float(r["longitude"])).alias("lo")) for r in short])
    away = F.transform(spots, lambda s: F.struct(haversine(F.col(lat), F.col(lon), s["la"], s["lo"]).alias("km"), s["place"].alias("place")))
    here = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    best = F.when(here, F.array_min(away))
    return df.withColumn("_best", best).withColumns({"nearest": F.col("_best.place"), "km": F.col("_best.km")}).drop("_best")


def _nearest_of_many(df: DataFrame, lat: str, lon: str, places: DataFrame, key: str) -> DataFrame:
    def sphere(la: Column, lo: Column) -> Column:
        a, b = F.radians(la), F.radians(lo)
        return F.when(la.isNotNull() & lo.isNotNull(), F.array(F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)))

    score = df.select(F.col(key).alias("id"), sphere(F.col(lat), F.col(lon)).alias("vec"))
    train = places.select(
        F.col("place").alias("id"), sphere(F.col("latitude"), F.col("longitude")).alias("vec")
    )
    found = nearest(score, train, 1).select(F.col("score_id").alias(key), F.col("train_id").alias("nearest"))
    spots = places.select(F.col("place").alias("nearest"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
    km = haversine(F.col(lat), F.col(lon), F.col("_lat"), F.col("_lon"))
    return df.join(found, key, "left").join(spots, "nearest", "left").withColumn("km", km).drop("_lat", "_lon")
