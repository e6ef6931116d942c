"""A pipeline from raw documents to a training mix.

Toxic documents go, one document of each near-duplicate group stays, text that an earlier document has is cut out,
documents with benchmark passages go, and the rest is mixed to source weights. Each stage's result is written as
Parquet and read again as the next one's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import decontaminate, mixing, signature_join, suffix_repeats, toxicity
from tabloom.llm.tables import read_table
from tabloom.operators.core import shared_dir


def reject_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the toxicity classifier, learnt from the labels, doesn't reject."""
    model = toxicity.fit_toxicity(docs, read_table(spark, folder, "labels"))
    return toxicity.drop_toxic(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest id."""
    return signature_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without the bytes that repeat 50 bytes or more of a document with a smaller id."""
    return suffix_repeats.cut_repeats(docs)


def reject_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no more than the allowed share of benchmark passages."""
    return decontaminate.drop_contaminated(docs, read_table(spark, folder, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Copies of the documents to the sources' target weights."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", one_of_each_group),
    ("suffix_dedup", cut_repeats),
    ("decontaminate", reject_contaminated),
    ("mixing", mix),
]

#: Learnt verdicts have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """Every stage over the documents, each reading what the one before has written to the shared folder."""
    docs = read_table(spark, folder, "documents")
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{place}/{k}-{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
