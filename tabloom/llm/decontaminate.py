"""Benchmark decontamination over a distributed positional inverted index, in DataFrame functions alone.

The training documents are read once to count the benchmark's terms, and once to store postings: (term, document,
position, the words around it), with the position of an end mark as each document's length. Only the rarest terms of each phrase are stored, since a phrase is found from those:
their posting lists, shifted by the term's offset in the phrase, must meet in the same document and start. The words
kept beside the posting then confirm the whole phrase, or bound the span for proximity.

The phrases are a query set of their own. They are sent to the documents in blocks of at most `BLOCK_PHRASES`, so what
is broadcast never exceeds that, whatever the size of the benchmark. Postings are narrow, joins are on (document,
phrase, start), and no step gathers a whole list of a term in one task.

Defined cases: a null or empty text has no words and is never hit; documents are told apart by id and text, so a null
id is a document like any other and repeated rows get equal results; an item without words gives no phrase; with an
empty benchmark nothing is hit; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabloom.operators.core import checkpointed

PHRASE_WORDS = 13
#: Phrases that are broadcast at once: some MB.
BLOCK_PHRASES = 50_000
#: Contaminated documents whose keys are broadcast: some MB.
BROADCAST_DOCUMENTS = 200_000
#: Rarest terms of a phrase whose postings are intersected.
RAREST = 2

#: The term that ends every document in the index: no word, so no phrase holds it.
END = ""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words of a text whose A-Z are still capitals.
_BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def raw_words(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(text, _BETWEEN_WORDS, -1), ""), F.array().cast("array<string>"))


def lower_word(word: Column) -> Column:
    """A-Z lowered, other letters as they are; `lower` does that for words of ASCII alone, and faster."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def phrases_of(items: DataFrame, key: str = "item_id", text: str = "text", width: int = PHRASE_WORDS) -> tuple[DataFrame, DataFrame]:
    """(phrase_id, words) of every `width` consecutive words of an item, all of a shorter one; and (phrase_id, item)."""
    words = raw_words(F.translate(F.col(text), _UPPER, _LOWER))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    each = (
        items.select(F.col(key).cast("string").alias("item"), words.alias("words"))
        .filter(F.size("words") > 0)
        .select("item", "words", F.explode(starts).alias("i"))
        .select("item", F.slice("words", F.col("i"), F.lit(width)).alias("words"))
        .select(F.xxhash64("words").alias("phrase_id"), "item", "words")
    )
    phrases = each.groupBy("phrase_id").agg(F.first("words").alias("words"))
    return phrases, each.select("phrase_id", "item").distinct()


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc"), F.coalesce(F.xxhash64(F.col(text)), F.lit(0)).alias("text_hash"), raw_words(F.col(text)).alias("words"))


def _tokens(documents: DataFrame) -> DataFrame:
    return documents.select("doc", "text_hash", "words", F.posexplode("words").alias("pos", "word")).withColumn("term", lower_word(F.col("word")))


def term_counts(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """How often each of the terms (at most a block's) occurs in all documents."""
    tokens = _tokens(_documents(docs, key, text)).select("term")
    return tokens.join(F.broadcast(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def build_index(docs: DataFrame, terms: DataFrame, reach: int = PHRASE_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings of the terms (at most a block's) and of each document's end: term, doc, text_hash, pos, and the
    `reach` - 1 words on either side.

    `before` is how many of them stand before the term. The join is a broadcast one inside the stage that splits the
    text, so a document's words are cut into context only where a term of the index occurs.
    """
    ended = _documents(docs, key, text).withColumn("words", F.concat("words", F.array(F.lit(END))))
    wanted = terms.select("term").union(docs.sparkSession.range(1).select(F.lit(END)))
    found = _tokens(ended).join(F.broadcast(wanted), "term")
    before = F.least(F.col("pos"), F.lit(reach - 1))
    return found.select("term", "doc", "text_hash", "pos", before.alias("before"), F.slice("words", F.col("pos") - before + 1, before + reach).alias("context")).withColumn(
        "context", F.transform("context", lower_word)
    )


def rarest_terms(phrases: DataFrame, counts: DataFrame, keep: int = RAREST) -> DataFrame:
    """(phrase_id, words, term, offset, rank): the rarest terms of each phrase whose terms all occur."""
    spread = phrases.select("phrase_id", "words", F.posexplode("words").alias("offset", "term")).join(counts, "term", "left")
    whole = Window.partitionBy("phrase_id")
    rank = F.row_number().over(whole.orderBy("n", "term", "offset"))
    complete = F.count("n").over(whole) == F.size("words")
    ranked = spread.select("phrase_id", "words", "term", "offset", rank.alias("rank"), complete.alias("complete"))
    return ranked.filter(F.col("complete") & (F.col("rank") <= keep)).drop("complete")


def phrase_matches(index: DataFrame, rare: DataFrame) -> DataFrame:
    """(doc, text_hash, phrase_id, start, length) of every exact occurrence: offset-adjusted lists are intersected
    from the rarest term on, and the context confirms the words between."""
    place = F.col("pos") - F.col("offset")
    # at most RAREST rows for each phrase of a block: broadcast, so that a term that very many texts have stays dealt out
    from_rarest = index.join(F.broadcast(rare.filter("rank = 1")), "term").filter(place >= 0)
    inside = F.slice("context", F.col("before") - F.col("offset") + 1, F.size("words"))
    exact = from_rarest.filter((F.col("before") >= F.col("offset")) & (inside == F.col("words")))
    first = exact.select("doc", "text_hash", "phrase_id", place.alias("start"), F.size("words").alias("length"))
    second = index.join(F.broadcast(rare.filter("rank = 2")), "term").filter(place >= 0).select("doc", "text_hash", "phrase_id", place.alias("start"))
    second = second.distinct().alias("s")
    first = first.distinct().alias("f")
    same = F.col("f.doc").eqNullSafe(F.col("s.doc")) & (F.col("f.text_hash") == F.col("s.text_hash")) & (F.col("f.phrase_id") == F.col("s.phrase_id")) & (F.col("f.start") == F.col("s.start"))
    both = first.filter("length > 1").join(second, same, "left_semi")
    return both.unionByName(first.filter("length = 1"))


def proximity_matches(index: DataFrame, rare: DataFrame, slop: int) -> DataFrame:
    """(doc, text_hash, phrase_id, pos): places of a phrase's rarest term around which all its words lie within a
    span of its length + `slop`, in any order. The index must reach that far."""
    near = index.join(F.broadcast(rare.filter("rank = 1")), "term")
    span = F.size("words") + slop
    # every span of that width that holds the posting's own position
    spans = F.transform(
        F.sequence(F.greatest(F.col("before") - span + 2, F.lit(1)), F.col("before") + 1), lambda i: F.slice("context", i, span)
    )
    return near.filter(F.exists(spans, lambda s: F.size(F.array_except("words", s)) == 0)).select("doc", "text_hash", "phrase_id", "pos").distinct()


def document_lengths(index: DataFrame) -> DataFrame:
    """(doc, text_hash, n_words) of each row of the indexed documents."""
    return index.filter(F.col("term") == END).select("doc", "text_hash", F.col("pos").cast("long").alias("n_words"))


def find_matches(docs: DataFrame, phrases: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK_PHRASES) -> tuple[DataFrame, DataFrame]:
    """Every exact occurrence of every phrase, phrase block by phrase block, and the documents' lengths."""
    phrases = checkpointed(phrases)
    blocks = max(1, -(-phrases.count() // block))
    parts, lengths = [], None
    for b in range(blocks):
        own = phrases.filter(F.pmod("phrase_id", F.lit(blocks)) == b)
        vocabulary = own.select(F.explode("words").alias("term")).distinct()
        rare = checkpointed(rarest_terms(own, term_counts(docs, vocabulary, key, text)))
        index = checkpointed(build_index(docs, rare.select("term").distinct(), key=key, text=text))
        parts.append(phrase_matches(index, rare))
        lengths = document_lengths(index) if lengths is None else lengths
    return reduce(DataFrame.unionByName, parts), lengths


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc, text_hash, n_words, n_hit, n_items, items_sha256, contaminated, for each row of docs."""
    phrases, owners = phrases_of(items, item_key, item_text)
    matches, lengths = find_matches(docs, phrases, key, text)
    matches = checkpointed(matches)
    before = Window.partitionBy("doc", "text_hash").orderBy("start", F.desc("length"))
    reached = F.coalesce(F.max(F.col("start") + F.col("length")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("length") - F.greatest(F.col("start"), reached))
    hits = matches.groupBy("doc", "text_hash", "start").agg(F.max("length").alias("length")).withColumn("fresh", fresh)
    hits = hits.groupBy("doc", "text_hash").agg(F.sum("fresh").cast("long").alias("n_hit"))
    found = matches.select("doc", "text_hash", "phrase_id").distinct().join(owners, "phrase_id")
    found = found.groupBy("doc", "text_hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
    d, h, f = (x.alias(n) for x, n in ((lengths, "d"), (hits, "h"), (found, "f")))
    same = lambda a, b: F.col(f"{a}.doc").eqNullSafe(F.col(f"{b}.doc")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))
    hit = h.join(f, same("h", "f")).select("h.doc", "h.text_hash", "n_hit", "items").alias("x")
    n_hit = F.coalesce("n_hit", F.lit(0))
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return d.join(hit, same("d", "x"), "left").select(
        "d.doc",
        "d.text_hash",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, unchanged, that aren't contaminated by the items."""
    bad = checkpointed(contamination(docs, items, key, text).filter("contaminated").select("doc", "text_hash").distinct())
    # counted before it is broadcast; more of them are joined by a shuffle
    bad = (F.broadcast(bad) if bad.count() <= BROADCAST_DOCUMENTS else bad).alias("bad")
    same = F.col(f"row.{key}").eqNullSafe(F.col("bad.doc")) & (F.coalesce(F.xxhash64(F.col(f"row.{text}")), F.lit(0)) == F.col("bad.text_hash"))
    return docs.alias("row").join(bad, same, "left_anti")


CONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, w[i : i + 12] AS phrase, least(len(w), 13) AS size
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM p),
windows AS (SELECT doc_id, size, i, w[i : i + size - 1] AS phrase
            FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT doc_id, i, size, item_id FROM windows JOIN p USING (size, phrase)),
hits AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM m) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)
"""
