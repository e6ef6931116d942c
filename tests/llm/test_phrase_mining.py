"""Phrase mining against counting every phrase, for samples from everything to nothing, and awkward rows."""

import collections
import random
import re

import numpy as np
import pytest

from tabloom.llm import phrase_mining as pm

SCHEMA = "doc_id long, text string, lang string, phrase string, key long, n long, size int, lang_key long, chosen int, part int, `rank` int, a int, l int, r int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def all_counts(rows, longest):
    counts, totals = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    counts[lang, " ".join(words[i : i + size])] += 1
    return counts, {k: v for k, v in totals.items() if v}


def best(rows, least, longest, top):
    counts, totals = all_counts(rows, longest)
    f = {k: v for k, v in counts.items() if v >= least}
    candidates = {k: v for k, v in f.items() if " " in k[1]}
    by_lang = collections.defaultdict(list)
    for (lang, phrase), a in candidates.items():
        w = phrase.split(" ")
        cuts = []
        for k in range(1, len(w)):
            left, right = f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]
            cuts.append((2000000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        inside = any(g == lang and len(q.split(" ")) > len(w) and f" {phrase} " in f" {q} " and 100 * b >= 80 * a for (g, q), b in candidates.items())
        if not inside:
            by_lang[lang].append((-score, -a, phrase.encode(), left, right))
    out = []
    for lang, found in by_lang.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    words = ["the", "cat", "Sat", "on", "mat", "É", "x,y", "a.", "dog\n", "Öl", "#1"] + [f"w{k}" for k in range(30)]
    out = []
    for _ in range(60):
        n = rng.choice([0, 1, 3, 30, 60])
        text = rng.choice([" ", "  ", "\t"]).join(rng.choice(words[: rng.choice([8, 41])]) for _ in range(n))
        out.append((text + rng.choice([" The cat sat on", " new york city hall"]) * rng.choice([0, 1]), rng.choice(["en", "de", None, "und"])))
    out += [(None, "en"), ("", "fr"), ("one two three four " * 400, "es"), ("rare words here", "it")]
    return out + out[:5]


@pytest.fixture(scope="module")
def docs(spark, rows):
    made = [(None if k % 9 == 0 else k, t, g, "p", 1, 2, 3, 4, 5, 6, 7, 8, 9, 10) for k, (t, g) in enumerate(rows)]
    return spark.createDataFrame(made, SCHEMA).repartition(4)


@pytest.mark.parametrize(("share", "block"), [(1, 2 << 20), (3, 300), (10**9, 2 << 20)])
def test_every_sample_gives_all_phrases(docs, rows, share, block, monkeypatch):
    monkeypatch.setattr(pm, "BLOCK", block)
    passes = []
    phrases, totals = pm.mine_phrases(docs, least=3, longest=5, share=share, passes=passes)
    counts, n = all_counts(rows, 5)
    expected = {(*k, len(k[1].split(" ")), v) for k, v in counts.items() if v >= 3}
    got = [tuple(r) for r in phrases.collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert {tuple(r) for r in totals.collect()} == set(n.items())
    # a full sample proposes everything; with none each pass closes one length
    assert passes.count("count") == {1: 1, 10**9: 4}.get(share, passes.count("count"))


@pytest.mark.parametrize("top", [4, 2000])
def test_collocations(docs, rows, top):
    got = sorted(tuple(r) for r in pm.collocations(docs, least=3, longest=4, top=top, share=2).collect())
    assert got == best(rows, 3, 4, top)


def test_nothing(docs):
    assert pm.collocations(docs.limit(0)).count() == 0
    assert pm.collocations(docs.filter("lang = 'it'"), least=3).count() == 0
    one = pm.collocations(docs.filter("lang = 'it'").unionByName(docs.filter("lang = 'it'")), least=2)
    assert one.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert [tuple(r) for r in one.collect()] == [("it", 1, "rare words here", 2, 2, 2, 6, 1000000)]


def test_scores_pass_64_bits(spark):
    row = spark.sql("select 9000000000000000000L as a, 9000000000000000000L as l, 9100000000000000000L as r")
    score = "(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"
    assert row.selectExpr(score).first()[0] == 2000000 * 9 * 10**18 // (181 * 10**17)


def test_bits_set_by_chance_change_nothing(docs, rows):
    """A bitmap of 2048 bits lets in phrases that nobody proposed."""
    phrases, _ = pm.mine_phrases(docs, least=2, longest=3, filter_bits=11)
    counts, _ = all_counts(rows, 3)
    assert {(r.lang, r.phrase): r.n for r in phrases.collect()} == {k: v for k, v in counts.items() if v >= 2}
    bitmap = np.zeros(256, np.uint8)
    bitmap[5] = 1 << 3
    assert pm.bit_set(bitmap, np.array([43 << 53, (43 << 53) + 9, 44 << 53], np.uint64)).tolist() == [True, True, False]
