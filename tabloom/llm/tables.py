"""Columns and sizes that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that a fitted model may be trained on; larger labelled tables give a sample in hash order.
TRAINING_ROWS = 6000


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_remainder(key: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % divisor


def shard_count(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the number that users set to fit their data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def labelled_sample(labels: DataFrame, label: str, rows: int, key: str = "doc_id") -> DataFrame:
    """At most `rows` ids for each of the labels 0 and 1, in hash order: a documented bound, fit to be broadcast."""
    one = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    order = F.xxhash64(key)
    parts = [one.filter(F.col("label") == v).orderBy(order, key).limit(rows // 2) for v in (0, 1)]
    return parts[0].unionByName(parts[1])
