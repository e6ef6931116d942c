"""Queries of the training-data operators over the given tables, and SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import conversation_repair, decontaminate, fm_dedup, html_blocks, license_scan, mixing, nce_lm, phrase_mining, piecewise_hash, quality_rules, signature_join, suffix_repeats, toxicity
from .tables import id_remainder, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


@query("op1_nce_lm")
def op1_nce_lm(spark: SparkSession, folder: str) -> DataFrame:
    """Log-probability of each document under the log-bilinear model, and under counts of single words."""
    return nce_lm.score_documents(read_table(spark, folder, "documents"))


@query("op2_suffix_dedup", suffix_repeats.REPEAT_SQL)
def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of each document that repeat 50 bytes or more of a smaller document."""
    return suffix_repeats.repeat_digest(read_table(spark, folder, "documents"))


@query("op3_decontaminate", decontaminate.CONTAMINATION_SQL)
def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each document hit by 13-word passages of the benchmark."""
    found = decontaminate.contamination(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
    return found.withColumnRenamed("doc", "doc_id").drop("text_hash")


@query("op4_license_scan")
def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence of each document, filed as source/lang/thousand/hundred/file; a document whose id ends in 0 is filed as a
    licence file of its hundred, of its thousand if it ends in 00, of its language if in 000."""
    docs = read_table(spark, folder, "documents")
    hundred, thousand = F.floor(F.col("doc_id") / 100).cast("string"), F.floor(F.col("doc_id") / 1000).cast("string")
    top = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")))
    file = F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string"))
    path = (
        F.when(F.col("doc_id") % 1000 == 0, F.concat_ws("/", top, file))
        .when(F.col("doc_id") % 100 == 0, F.concat_ws("/", top, thousand, file))
        .when(F.col("doc_id") % 10 == 0, F.concat_ws("/", top, thousand, hundred, file))
        .otherwise(F.concat_ws("/", top, thousand, hundred, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    )
    return license_scan.scan_licences(docs.select("doc_id", path.alias("path"), "text"), keep=("doc_id",))


@query("op5_jaccard_join", signature_join.NEAR_DUPLICATE_SQL)
def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Shingle count and near-duplicate group of each document."""
    return signature_join.near_duplicate_classes(read_table(spark, folder, "documents"), percent=85, shingle=4)


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of each document, learnt from the labels of four folds of five."""
    docs = read_table(spark, folder, "documents")
    model = toxicity.fit_toxicity(docs, read_table(spark, folder, "labels"))
    held = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    return toxicity.toxicity_scores(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


@query("op7_html_blocks")
def op7_html_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of each page."""
    return html_blocks.extract_pages(read_table(spark, folder, "pages"))


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base rules and boosted-tree verdict of each document."""
    docs = read_table(spark, folder, "documents")
    trees = quality_rules.fit_quality(docs, read_table(spark, folder, "labels"))
    return quality_rules.quality_verdicts(docs, trees)


@query("op9_mixing", mixing.MIXING_SQL)
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as often as its source's target repetition rate asks, in a global random order."""
    return mixing.mix_sources(read_table(spark, folder, "documents"))


@query("op10_fm_dedup", fm_dedup.WORD_REPEAT_SQL)
def op10_fm_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each document that repeat 50 words or more of a smaller document."""
    return fm_dedup.word_repeat_digest(read_table(spark, folder, "documents"))


@query("op11_phrase_mining", phrase_mining.COLLOCATION_SQL)
def op11_phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    """The 2000 phrases of each language that hold together best."""
    return phrase_mining.collocations(read_table(spark, folder, "documents"))


@query("op12_piecewise_hash")
def op12_piecewise_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint of each document and of its edited text, and how alike they and the next document's are."""
    return piecewise_hash.edited_likeness(read_table(spark, folder, "documents"))


@query("op13_conversation_repair", conversation_repair.REPAIR_SQL)
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of each damaged conversation and the cheapest edits that repair it."""
    return conversation_repair.damaged_audits(read_table(spark, folder, "conversations"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
