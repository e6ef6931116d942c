"""Mixing sources to target weights by Poisson replication, in DataFrame functions.

A source's target repetition rate is its share of the target divided by its share of the corpus. A document's number
of copies is the Poisson quantile, with that rate as mean, of a uniform number hashed from seed and id: a pure function
of the row, equal wherever it is recomputed. Every copy then goes to a place drawn by a hash of seed, id and copy.

Rates come from one aggregate over all rows, a row for each source. Up to 20,000 sources they are broadcast, so that
documents aren't dealt out by source; the one shuffle of the texts is keyed by each copy's own hash.

Defined cases: a null source is a source of its own; a null id hashes as an empty one; repeated rows get equal counts;
null or empty texts have length 0; a source without any text is kept at rate 1; an empty table gives no rows; a column
`copy` is replaced, any other name may occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.core import checkpointed

from .tables import shard_count

#: Exponent of a source's text in its target weight: 1 keeps the corpus as it is, 0 gives every source the same.
TEMPERATURE = 0.5
#: Sources whose rates are broadcast: some MB of distribution functions.
BROADCAST_SOURCES = 20_000


def hashed_uniform(seed: int, key: Column, *more: Column) -> Column:
    """A number in (0, 1) of 52 hashed bits."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")), *[m.cast("string") for m in more])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_rates(docs: DataFrame, source: str = "source", text: str = "text", temperature: float = TEMPERATURE) -> DataFrame:
    """(source, rate): target repetition rates; the expected text of all copies equals the corpus."""
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.coalesce(F.length(F.col(text)), F.lit(0))).cast("double").alias("size"))
    weight = F.when(F.col("size") > 0, F.pow("size", F.lit(temperature))).otherwise(0.0)
    totals = sizes.select(F.sum("size").alias("total"), F.sum(weight).alias("weights"))
    rate = F.when(F.col("size") > 0, weight / F.col("weights") * F.col("total") / F.col("size")).otherwise(1.0)
    return sizes.join(F.broadcast(totals)).select("source", rate.alias("rate"))  # totals is one row


def poisson_quantile_table(rates: DataFrame) -> DataFrame:
    """Adds `steps`: the distribution function at 0, 1, 2, ... up to where the rest is below 2 ** -52."""
    last = F.ceil(F.col("rate") + 10 * F.sqrt("rate") + 20).cast("int")
    term = lambda a, k: a["log_p"] + F.log(F.col("rate")) - F.log(k.cast("double"))
    start = F.struct((-F.col("rate")).alias("log_p"), F.exp(-F.col("rate")).alias("sum"), F.array(F.exp(-F.col("rate"))).alias("steps"))
    walked = F.aggregate(
        F.sequence(F.lit(1), last),
        start,
        lambda a, k: F.struct(
            term(a, k).alias("log_p"), (a["sum"] + F.exp(term(a, k))).alias("sum"), F.concat(a["steps"], F.array(a["sum"] + F.exp(term(a, k)))).alias("steps")
        ),
    )
    return rates.withColumn("steps", walked["steps"])


def replicate(docs: DataFrame, rates: DataFrame, seed: int = 17, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Each row once for each of its copies, numbered from 0 in `copy`, in a global order drawn by hash."""
    # a row for each source, counted before it is broadcast; more sources than that are joined by a shuffle
    rates = checkpointed(rates)
    steps = poisson_quantile_table(rates).select(F.col("source").alias("of_source"), "steps")
    steps = F.broadcast(steps) if rates.count() <= BROADCAST_SOURCES else steps
    # the row travels as one column, so that no name of its own meets one of ours
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "copy"]
    rows = docs.select(F.struct(*kept).alias("row"), F.col(key).alias("id"), F.col(source).alias("source"), hashed_uniform(seed, F.col(key)).alias("u"))
    rows = rows.join(steps, F.col("source").eqNullSafe(F.col("of_source")))
    counted = rows.select("row", "id", F.size(F.filter("steps", lambda s: s < F.col("u"))).alias("n")).filter("n > 0")
    copies = counted.select("row", "id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    placed = copies.select("row", "copy", hashed_uniform(seed + 1, F.col("id"), F.col("copy")).alias("place"))
    return placed.repartition(shard_count(docs.sparkSession), "place").sortWithinPartitions("place").select("row.*", "copy")


def mix_sources(docs: DataFrame, seed: int = 17, key: str = "doc_id", source: str = "source", text: str = "text", temperature: float = TEMPERATURE) -> DataFrame:
    return replicate(docs, source_rates(docs, source, text, temperature), seed, key, source)


MIXING_SQL = """
WITH RECURSIVE sizes AS (SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS size FROM documents GROUP BY source),
totals AS (SELECT sum(size) AS total, sum(CASE WHEN size > 0 THEN pow(size, 0.5) ELSE 0 END) AS weights FROM sizes),
rates AS (SELECT source, CASE WHEN size > 0 THEN pow(size, 0.5) / weights * total / size ELSE 1.0 END AS rate FROM sizes, totals),
steps AS (
  SELECT source, rate, CAST(0 AS BIGINT) AS k, -rate AS log_p, exp(-rate) AS below FROM rates
  UNION ALL
  SELECT source, rate, k + 1, log_p + ln(rate) - ln(CAST(k + 1 AS DOUBLE)), below + exp(log_p + ln(rate) - ln(CAST(k + 1 AS DOUBLE)))
  FROM steps WHERE k + 1 <= ceil(rate + 10 * sqrt(rate) + 20)),
drawn AS (SELECT *, (CAST(CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
          FROM documents),
counted AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM d.source AND s.below < d.u) AS n
            FROM drawn d)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(0, n)) AS INTEGER) AS copy FROM counted
"""
