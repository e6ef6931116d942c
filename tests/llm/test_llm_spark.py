"""Operators on small tables: brute force, and nulls, empty and long texts, ties, repeated rows, empty tables, extra
columns whose names clash with the operators' own."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabloom.llm import components, decontaminate, fm_dedup, html_blocks, license_scan, mixing, nce_lm, quality_rules, repeats, signature_join, suffix_repeats, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, blob string, shard int, chunk long, word string, start int, `copy` int"
WHITE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Ids and texts with every awkward case."""
    rng = random.Random(1)
    passage, base = prose(rng, 90), prose(rng, 200)
    near = base.split()
    near[50], near[120] = "changed", "Ünders"
    rows = [
        (1, base),
        (2, base),
        (3, " ".join(near)),
        (4, prose(rng, 40) + " " + passage + " " + prose(rng, 40)),
        (5, prose(rng, 30) + "\n" + passage),
        (6, None),
        (7, ""),
        (8, " \n\t "),
        (9, "short"),
        (10, "short"),
        (11, "Short  text"),
        (12, "tést É ü " * 400),
        (13, prose(rng, 6000)),
        (None, base),
        (None, prose(rng, 10)),
        (14, prose(rng, 60)),
        (14, prose(rng, 60)),
        (15, passage),
        (15, passage),
        (16, passage.upper()),
        (17, "aaaa " * 300),
        (18, "a" * 500),
        (19, "x" + "a" * 300),
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i == 3 else "en", None if i == 5 else "s1", None, "b", 1, 2, "w", 3, 4) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def smaller(a, b):
    return a is not None and (b is None or a < b)


def without_repeats(rows, width, cut):
    """For each row, flags of the symbols of cut(text) in a window that a row of a smaller id has."""
    parts = [(i, cut(t or "")) for i, t in rows]
    first = {}
    for i, s in parts:
        for p in range(len(s) - width + 1):
            w = tuple(s[p : p + width])
            if w not in first or smaller(i, first[w]):
                first[w] = i
    for i, s in parts:
        flags = [False] * len(s)
        for p in range(len(s) - width + 1):
            if smaller(first[tuple(s[p : p + width])], i):
                flags[p : p + width] = [True] * width
        yield i, s, flags


@pytest.mark.parametrize("hot", [1, 1000])
def test_suffix_dedup(docs, texts, hot):
    expected = []
    for i, s, flags in without_repeats(texts, 50, lambda t: t.encode()):
        spans = sum(f and not (k and flags[k - 1]) for k, f in enumerate(flags))
        expected.append((i, len(s), sum(flags), spans, hashlib.sha256(bytes(b for b, f in zip(s, flags) if not f)).hexdigest()))
    assert order(suffix_repeats.repeat_digest(docs, hot=hot).collect()) == order(expected)


@pytest.mark.parametrize("hot", [1, 1000])
def test_fm_dedup(docs, texts, hot):
    expected = [
        (i, len(s), sum(flags), hashlib.sha256(" ".join(w for w, f in zip(s, flags) if not f).encode()).hexdigest())
        for i, s, flags in without_repeats(texts, 50, WHITE.findall)
    ]
    assert order(fm_dedup.word_repeat_digest(docs, hot=hot).collect()) == order(expected)


def test_dedup_keeps_other_columns_and_nulls(docs, texts):
    cut = suffix_repeats.cut_repeats(docs)
    assert cut.schema == docs.schema and cut.count() == len(texts)
    rows = {r.doc_id: r for r in cut.collect()}
    assert rows[6].text is None and rows[6].n_chars is None and rows[2].text == "" and rows[2].n_chars == 0 and rows[2].shard == 1
    words = fm_dedup.cut_repeated_words(docs)
    assert words.schema == docs.schema and {r.doc_id: r.text for r in words.collect()}[2] == ""


def shingles(text, k):
    words = WHITE.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def groups(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for a, (i, _) in enumerate(rows):
        r = root(a)
        least[r] = i if r not in least or smaller(i, least[r]) else least[r]
    return [(i, len(s), least[root(a)]) for a, ((i, _), s) in enumerate(zip(rows, sets))], [root(a) for a in range(len(rows))]


@pytest.mark.parametrize("percent,shingle,block", [(85, 4, 1500), (85, 4, 1), (80, 5, 2)])
def test_jaccard_join(docs, texts, percent, shingle, block):
    expected, _ = groups(texts, shingle, percent)
    got = signature_join.near_duplicate_classes(docs, percent=percent, shingle=shingle, block=block)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert order(got.collect()) == order(expected)


def test_one_of_each(docs, texts):
    _, roots = groups(texts, 5, 80)
    kept = signature_join.one_of_each(docs)
    assert kept.schema == docs.schema
    ids = [r.doc_id for r in kept.collect()]
    expected = []
    for r in set(roots):
        ids_of = [texts[a][0] for a in range(len(texts)) if roots[a] == r]
        expected.append(min(ids_of, key=lambda i: (i is None, i or 0)))
    assert order([(i,) for i in ids]) == order([(i,) for i in expected])


def test_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (102, 101), (7, 7)] + [(200, 200 + k) for k in range(1, 60)]
    rng.shuffle(links)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100, 102: 100, **{200 + k: 200 for k in range(60)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contaminated(rows, items):
    phrases = collections.defaultdict(set)
    for item, text in items:
        w = ITEM_WORD.findall((text or "").translate(LOWER))
        for p in range(max(1, len(w) - 12) if w else 0):
            phrases[tuple(w[p : p + 13])].add(str(item) if item is not None else None)
    for i, text in rows:
        w = ITEM_WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(p) for p in phrases}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in phrases:
                    hit |= set(range(p, p + n))
                    found |= phrases[tuple(w[p : p + n])]
        yield i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.fixture(scope="module")
def items(texts):
    base, passage = texts[0][1].split(), texts[17][1].split()
    return [
        (1, " ".join(base[10:40])),
        (2, " ".join(base[20:45]).upper()),
        (3, "short"),
        (10, None),
        (11, ""),
        (12, "... --"),
        (13, " ".join(passage[5:18])),
        (13, " ".join(passage[5:18])),
        (14, "tést É ü tést É ü tést"),
        (15, "never seen words"),
        (16, "aaaa " * 20),
    ]


@pytest.mark.parametrize("block", [50_000, 7])
def test_decontamination(spark, docs, texts, items, block, monkeypatch):
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, word string")
    monkeypatch.setattr(decontaminate.find_matches, "__defaults__", ("doc_id", "text", block))
    got = decontaminate.contamination(docs, table).drop("text_hash").collect()
    assert order(got) == order(contaminated(texts, items))


def test_decontamination_drops_rows_whole(spark, docs, texts, items):
    table = spark.createDataFrame(items, "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, table)
    assert kept.schema == docs.schema
    clean = [i for (i, *_, bad) in contaminated(texts, items) if not bad]
    assert order([(r.doc_id,) for r in kept.collect()]) == order([(i,) for i in clean])
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.drop_contaminated(docs, none).count() == len(texts)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b q c d"), (2, "d c x b a"), (3, "a b x y z c d")], "doc_id long, text string")
    phrases, _ = decontaminate.phrases_of(spark.createDataFrame([(1, "a b c d")], "item_id long, text string"))
    terms = phrases.select(F.explode("words").alias("term")).distinct()
    rare = decontaminate.rarest_terms(phrases, decontaminate.term_counts(docs, terms))
    index = decontaminate.build_index(docs, terms, reach=13)
    assert decontaminate.phrase_matches(index, rare).count() == 0
    near = lambda slop: sorted({r.doc for r in decontaminate.proximity_matches(index, rare, slop).collect()})
    assert near(0) == [] and near(1) == [1, 2] and near(3) == [1, 2, 3]


def test_language_model(docs, texts):
    got = nce_lm.score_documents(docs).collect()
    tokens = [(i, WHITE.findall((t or "").translate(LOWER)) + [None]) for i, t in texts]
    out = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in tokens]
    counts = collections.Counter(w for (_, ws), o in zip(tokens, out) if not o for w in ws)
    n, v = sum(counts.values()), len(counts)
    expected = [(i, o, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 4)) for (i, ws), o in zip(tokens, out)]
    assert order([(*tuple(r)[:5], round(r.base_score, 4)) for r in got]) == order(expected)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_held_out_score_beats_single_words(spark):
    rng, words, rows = random.Random(3), [f"w{i}{'abc'[i % 3]}" for i in range(600)], []
    for d in range(400):
        at, out = rng.randrange(600), []
        for _ in range(120):
            out.append(words[at])
            at = (at * 7 + 1) % 600 if rng.random() < 0.9 else rng.randrange(600)
        rows.append((d, " ".join(out)))
    held = nce_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_mixing_follows_the_rates(spark):
    rows = [(k, "abc", "big" if k % 4 else "small") for k in range(4000)] + [(None, "abc", "big"), (5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rates = {r.source: r.rate for r in mixing.source_rates(docs).collect()}
    assert rates[None] == 1.0 and 0 < rates["big"] < 1 < rates["small"]
    mixed = mixing.mix_sources(docs)
    n = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    for source, size in (("big", 3001), ("small", 1000)):
        assert abs(n[source] - rates[source] * size) < 5 * math.sqrt(rates[source] * size)
    assert order(mixed.collect()) == order(mixing.mix_sources(docs.repartition(7)).collect())
    per_doc = mixed.filter("source = 'small' and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("copy").alias("last"))
    assert per_doc.filter("n != last + 1").count() == 0


def test_quality(spark, docs, texts):
    labels = spark.createDataFrame([(i, 1 if i not in (17, 18) else 0) for i, _ in texts if i is not None] + [(None, 0), (99, None)], "doc_id long, quality int")
    trees = quality_rules.fit_quality(docs, labels)
    rows = quality_rules.quality_verdicts(docs, trees).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if r.n_words < 20:
            assert r.base_failed and not r.kept
    by_id = {r.doc_id: r for r in rows}
    assert by_id[17].base_failed and not by_id[1].base_failed and by_id[6].n_words == 0


def test_toxicity(spark, docs, texts):
    rng = random.Random(2)
    many = [(100 + k, prose(rng, 30) + (" vile filth " if k % 3 == 0 else " ") + prose(rng, 30), int(k % 3 == 0)) for k in range(300)]
    learnt = spark.createDataFrame([(i, t) for i, t, _ in many], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in many] + [(None, 1)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(learnt, labels)
    right = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(learnt, model).collect()}
    held = [(i, y) for i, _, y in many if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(right[i] == y for i, y in held) >= 0.95 * len(held)
    rows = toxicity.toxicity_scores(docs, model).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(1 - r.predicted for r in rows)


def test_licences(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."),
        ("a/b/c/x.txt", "code and more code\nnothing here"),
        ("a/b/LICENSE.txt", "\nLicensed under the Apache License, Version 2.0.\n"),
        ("a/d/y.txt", None),
        ("z/y.txt", ""),
        ("a/own.txt", "some words\nAll rights reserved.\nmore words"),
        ("top.txt", "words"),
        (None, "Licensed under CC BY-NC 4.0."),
        ("a/d/y.txt", None),
    ] + [(f"m/{k}.txt", "plain prose of the corpus under the sun " * 3) for k in range(50)]
    files = spark.createDataFrame([(p, t, "x") for p, t in rows], "path string, text string, directory string")
    got = collections.Counter((r.path, r.licence, r.found_in, r.inherited_from) for r in license_scan.scan_licences(files.drop("directory")).collect())
    assert got[("a/b/c/x.txt", "Apache-2.0", "inherited", "a/b")] == 1
    assert got[("a/d/y.txt", "MIT", "inherited", "a")] == 2
    assert got[("a/own.txt", "all-rights-reserved", "own", None)] == 1
    assert got[("z/y.txt", None, None, None)] == 1 and got[("top.txt", None, None, None)] == 1
    assert got[(None, "CC-BY-NC-4.0", "own", None)] == 1
    assert sum(got.values()) == len(rows)


GPL = """# fetch.py - part of Fetch
# Copyright (C) 2011 The Fetch authors
#
# Fetch is free software: you can redistribute it and/or
# modify it under the terms of the GNU {0}General
# Public License as published by the Free Software
# Foundation, either version {1} of the License, or (at
# your option) any later version.
#
# Fetch is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied
# warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
# PURPOSE.  See the GNU {0}General Public License for more
# details.
import os
"""
ISC_FILE = """ISC License

Copyright (c) 2020, Jane Roe

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND JANE ROE DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL JANE ROE BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""
BSD_FILE = """Copyright 2001-2004 The Example Project. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:
 * Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
 * Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
{0}
THIS SOFTWARE IS PROVIDED BY THE EXAMPLE PROJECT ``AS IS'' AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE EXAMPLE PROJECT OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
BSD_THIRD = """ * Neither the name of the project nor the names of its contributors may be
   used to endorse or promote products derived from this software without
   specific prior written permission.
"""
UNLICENSE = """This is free and unencumbered software released into
the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""


def test_wrapped_notices_and_whole_licence_files(spark):
    rows = {
        "MIT/LICENSE": "Released under the MIT License.",
        "MIT/gpl2.py": GPL.format("", "2"),
        "MIT/gpl3.py": GPL.format("", "3"),
        "MIT/lgpl3.py": GPL.format("Lesser ", "3"),
        "MIT/agpl3.py": GPL.format("Affero ", "3"),
        "isc/LICENSE": ISC_FILE,
        "isc/x.py": "import os",
        "MIT/bsd2": BSD_FILE.format(""),
        "MIT/bsd3": BSD_FILE.format(BSD_THIRD),
        "MIT/un": UNLICENSE,
        "MIT/two.py": GPL.format("", "2") + "x = 1\n" * 30 + ISC_FILE,
        "MIT/lines.py": "Licensed under CC BY-NC 4.0.\nwords between\nLicensed under the Apache License, Version 2.0.",
        "MIT/half.py": "any warranty of this software, in the hope that it will be useful for more details",
    } | {f"m/{k}.txt": "plain prose of the corpus under the sun " * 3 for k in range(50)}
    files = spark.createDataFrame(list(rows.items()), "path string, text string")
    got = {r.path: r for r in license_scan.scan_licences(files).collect()}
    first = {p: r.licence for p, r in got.items() if not p.startswith("m/")}
    assert first == {
        "MIT/LICENSE": "MIT", "MIT/gpl2.py": "GPL-2.0", "MIT/gpl3.py": "GPL-3.0", "MIT/lgpl3.py": "LGPL-3.0", "MIT/agpl3.py": "AGPL-3.0", "isc/LICENSE": "ISC",
        "isc/x.py": "ISC", "MIT/bsd2": "BSD-2-Clause", "MIT/bsd3": "BSD-3-Clause", "MIT/un": "Unlicense", "MIT/two.py": first["MIT/two.py"],
        "MIT/lines.py": first["MIT/lines.py"], "MIT/half.py": "MIT",
    }
    assert got["MIT/two.py"].licences == ["GPL-2.0", "ISC"] and got["MIT/lines.py"].licences == ["Apache-2.0", "CC-BY-NC-4.0"]
    assert got["isc/x.py"].licences == ["ISC"] and got["isc/x.py"].found_in == "inherited"
    assert got["MIT/gpl2.py"].licences == ["GPL-2.0"] and got["MIT/gpl2.py"].line == 3
    assert all(r.licences == [] and r.licence is None for p, r in got.items() if p.startswith("m/"))


def test_windows_against_plain_cosines():
    rng = np.random.default_rng(4)
    idf = rng.uniform(1, 9, license_scan.BUCKETS)
    notices = license_scan.Notices(idf, {"a": ["one two two three four"], "b": ["five six seven"]})
    used = np.flatnonzero(notices.place >= 0)
    words = rng.choice(np.append(used, [1, 2, 3]), 60)
    for k, length in enumerate(notices.lengths):
        got = notices.windows(words, k)
        for i in range(len(words)):
            counts = np.bincount(words[i : i + length], minlength=license_scan.BUCKETS) * idf
            whole = np.zeros(license_scan.BUCKETS)
            whole[used] = notices.vectors[k][notices.place[used]]
            assert abs(got[i] - counts @ whole / np.linalg.norm(counts)) < 1e-9


def test_pages(spark):
    pages = spark.createDataFrame([(1, None, "<p>é x</p>", "t"), (None, "u", None, "t"), (2, "u", "", "t"), (2, "u", "", "t")], "page_id long, url string, html string, text string")
    assert order(html_blocks.extract_pages(pages).collect()) == order([(1, None, "é x", 3), (None, "u", "", 0), (2, "u", "", 0), (2, "u", "", 0)])


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert suffix_repeats.repeat_digest(empty).count() == 0
    assert fm_dedup.word_repeat_digest(empty).count() == 0
    assert signature_join.near_duplicate_classes(empty).count() == 0
    assert signature_join.one_of_each(empty).count() == 0
    assert decontaminate.contamination(empty, items).count() == 0
    assert nce_lm.score_documents(empty).count() == 0
    assert mixing.mix_sources(empty).count() == 0
    assert quality_rules.quality_verdicts(empty, quality_rules.fit_quality(empty, labels)).count() == 0
    assert toxicity.toxicity_scores(empty, toxicity.fit_toxicity(empty, labels)).count() == 0
    assert license_scan.scan_licences(empty.select(F.lit("a").alias("path"), "text")).count() == 0
    assert html_blocks.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_stages_keep_the_columns(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == columns, name
        assert {r.doc_id for r in out.select("doc_id").collect()} <= ids
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "suffix_dedup", "decontaminate", "mixing"]


def test_pipeline_against_plain_code(spark):
    """The learnt first stage is taken as it is; the others are recomputed row by row from its result."""
    folder = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in corpus_pipeline.reject_toxic(spark, documents, folder).collect()}
    texts = sorted((i, r.text) for i, r in rows.items())
    _, roots = groups(texts, 5, 80)
    texts = [t for k, t in enumerate(texts) if k in set(roots)]
    cut = {}
    for i, s, flags in without_repeats(texts, 50, lambda t: t.encode()):
        cut[i] = bytes(b for b, f in zip(s, flags) if not f).decode("utf-8", "ignore")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = [i for (i, *_, bad) in contaminated(sorted(cut.items()), items) if not bad]
    sizes = collections.Counter()
    for i in clean:
        sizes[rows[i].source] += len(cut[i])
    total, weights = sum(sizes.values()), sum(math.sqrt(v) for v in sizes.values())
    expected = []
    for i in clean:
        size = sizes[rows[i].source]
        rate = math.sqrt(size) / weights * total / size if size else 1.0
        u = (int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        n, p, below = 0, math.exp(-rate), math.exp(-rate)
        while below < u:
            n, p = n + 1, p * rate / (n + 1)
            below += p
        expected += [(i, cut[i], rows[i].lang, rows[i].source, len(cut[i]), k) for k in range(n)]
    assert order(corpus_pipeline.run(spark, folder).collect()) == order(expected)


INTERNAL = "row id source of_source steps u n place copy doc text_hash _text_hash _n _u _place _source bad term pos words".split()


def clashing(spark, rows):
    """doc_id, text, source, and a column for every name that the operators use inside."""
    extra = [c for c in INTERNAL if c != "source"]
    return spark.createDataFrame([(*r, *[k] * len(extra)) for k, r in enumerate(rows)], "doc_id string, text string, source string, " + ", ".join(f"`{c}` int" for c in extra))


def test_mixing_keeps_columns_of_any_name(spark):
    docs = clashing(spark, [(f"d{k}", "some text " * k, None if k == 3 else "s") for k in range(30)])
    plain = mixing.mix_sources(docs.select("doc_id", "text", "source"))
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == [c for c in docs.columns if c != "copy"] + ["copy"]
    assert order(mixed.select("doc_id", "copy").collect()) == order(plain.select("doc_id", "copy").collect())
    of = {r.doc_id: r.steps for r in docs.collect()}
    assert all(r.steps == of[r.doc_id] == r.row and r.source == (None if r.doc_id == "d3" else "s") for r in mixed.collect())


def test_dropping_contaminated_keeps_columns_of_any_name(spark):
    passage = " ".join(f"word{k}" for k in range(20))
    docs = clashing(spark, [("a", passage, "s"), ("b", "clean text of its own", "s"), (None, passage, "s"), ("c", None, None)])
    kept = decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert kept.schema == docs.schema
    assert order(kept.collect()) == order(docs.filter("doc_id in ('b', 'c')").collect())


STATED = {
    "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": "CC-BY-ND-4.0",
    "Creative Commons Attribution 4.0 International License": "CC-BY-4.0",
    "This work is not licensed under the GNU General Public License, version 2.": None,
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
    "All rights are reserved for the hotel guests of the night.": None,
    "Copyright 2020 Jane Roe. All rights reserved.": "all-rights-reserved",
    "# SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "// SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0",
    "SPDX-License-Identifier: MIT": "MIT",
    "GNU GPL v3 or later": "GPL-3.0",
    "Licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
    "GNU General Public License, version 2 or 3": None,
    "Apache Spark 2.0 and later": None,
    "The rights of all guests are reserved to the hotel": None,
    "Released under the BSD 2-Clause License.": "BSD-2-Clause",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "MPL-2.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.": "MIT",
    "Redistribution and use in source and binary forms, with or without modification, are permitted.": "BSD-3-Clause",
}


@pytest.mark.parametrize("with_corpus", [False, True])
def test_lines_name_a_licence_by_what_tells_it_apart(spark, with_corpus):
    rows = [(f"d{k}/x.txt", line) for k, line in enumerate(STATED)]
    if with_corpus:
        rows += [(f"m{k}/y.txt", "plain prose of the corpus under the sun " * 3) for k in range(80)]
        rows += [(f"n{k}/z.txt", f"one line\n{line}\nand another") for k, line in enumerate(STATED)]
    files = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: r.licence for r in license_scan.scan_licences(files).collect()}
    wrong = {line: got[f"d{k}/x.txt"] for k, line in enumerate(STATED) if got[f"d{k}/x.txt"] != STATED[line]}
    if with_corpus:
        wrong |= {f"in text: {line}": got[f"n{k}/z.txt"] for k, line in enumerate(STATED) if got[f"n{k}/z.txt"] != STATED[line]}
    assert not wrong


def test_scores_do_not_follow_the_partitions(spark):
    rng = random.Random(12)
    vocabulary = [prose(rng, 1) for _ in range(300)]
    rows = [(k if k % 50 else None, " ".join(rng.choice(vocabulary[: rng.choice([20, 300])]) for _ in range(rng.randint(0, 60)))) for k in range(400)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string")
    a, b, c = ([tuple(r) for r in nce_lm.score_documents(d).collect()] for d in (docs, docs.repartition(7), docs.orderBy(F.desc("text")).coalesce(1)))
    for other in (b, c):
        for x, y in zip(order(a), order(other)):
            assert x[:5] == y[:5] and x[5] == pytest.approx(y[5], abs=1e-6) and x[6] == pytest.approx(y[6], abs=1e-6 * x[2])
