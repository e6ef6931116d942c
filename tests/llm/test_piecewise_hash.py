"""Piecewise hashing against plain code, likeness of edited texts, and awkward rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import piecewise_hash as ph
from tabloom.llm.arrays import mix

SCHEMA = "doc_id long, text string, id long, h long, salt long, part int, state int, next int, fingerprint string, n_chars int"
WORD = 1 << 32


def plain_fingerprint(text):
    """One byte after the other."""
    data = (text or "").encode()
    hashes = []
    for p in range(len(data)):
        h = 0
        for b in data[max(0, p - 7) : p + 1]:
            h = (h * 0x9E3779B1 + int(ph._BYTES[b])) % WORD
        h = (h ^ h >> 15) * 0x85EBCA6B % WORD
        hashes.append((h ^ h >> 13) * 0xC2B2AE35 % WORD)
    level = 0
    while 64 * 2 ** (level + 2) < len(data):
        level += 1
    leading = [32 - h.bit_length() for h in hashes]
    while sum(x >= level for x in leading[:-1]) > 63:
        level += 1
    parts = []
    for k in range(3):
        out, total = "", 0
        for p, h in enumerate(hashes):
            total += h
            if leading[p] >= level + k or p == len(data) - 1:
                symbol = int(mix(np.array([total], np.uint64))[0]) >> 52
                out += chr(ph.LETTERS[symbol >> 6]) + chr(ph.LETTERS[symbol & 63])
                total = 0
        parts.append(out)
    return ":".join([str(level), *parts])


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def plain_likeness(x, y):
    if x == y:
        return 1.0
    x, y = x.split(":"), y.split(":")
    level = max(int(x[0]), int(y[0]))
    if level - min(int(x[0]), int(y[0])) > 2:
        return 0.0
    a, b = x[level - int(x[0]) + 1], y[level - int(y[0]) + 1]
    a, b = ([s[k : k + 2] for k in range(0, len(s), 2)] for s in (a, b))
    return 1 - plain_distance(a, b) / max(len(a), len(b)) if a and b else 0.0


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijäé") for _ in range(rng.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    long = prose(rng, 5000)
    made = [prose(rng, n) for n in (1, 2, 8, 12, 40, 90, 300, 900, 2500)]
    return [None, "", "a", "éé", "ab" * 700, "a" * 3000, long, long, long[:9000] + "!" + long[9000:], *made, "", made[3]]


def test_fingerprints_equal_plain_code(texts, monkeypatch):
    expected = [plain_fingerprint(t) for t in texts]
    raw = [(t or "").encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    assert ph.fingerprints(data, offsets) == expected
    for strip in (5, 64, 1000):
        monkeypatch.setattr(ph, "STRIP", strip)
        assert ph.fingerprints(data, offsets) == expected
    pairs = [(a, b) for a in expected for b in expected]
    got = ph.likeness_of(*map(list, zip(*pairs)), step=7)
    assert got == pytest.approx([plain_likeness(*p) for p in pairs])


def test_edited_likeness(spark, texts):
    ids = [None, *range(3, len(texts) + 1), 3]
    rows = sorted(zip(ids, texts), key=repr)
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6, "f", 7) for i, t in rows], SCHEMA).repartition(5)
    h = {r.t: r.h for r in df.select(F.coalesce("text", F.lit("")).alias("t")).withColumn("h", F.xxhash64("t")).collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, h[r[1]]))
    expected = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, changed = plain_fingerprint(t), plain_fingerprint(edited)
        expected.append(
            (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), own, changed, plain_likeness(own, changed), plain_likeness(own, plain_fingerprint(after)))
        )
    got = [tuple(r) for r in ph.edited_likeness(df).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_one_document_and_none(spark):
    df = spark.createDataFrame([(1, "only one document here")], "doc_id long, text string")
    row = ph.edited_likeness(df).first()
    assert (row.near_next, row.n_chars) == (1.0, 22)
    assert ph.edited_likeness(df.limit(0)).count() == 0


def test_likeness_tells_edits_from_strangers():
    rng = random.Random(8)
    edited, strange = [], []
    for _ in range(200):
        n = rng.choice([30, 100, 400, 3000])
        a, b = prose(rng, n), prose(rng, n)
        raw = [x.encode() for x in (a, a[: len(a) // 2] + b[: len(a) // 2], b)]
        prints = ph.fingerprints(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
        edited.append(ph.likeness_of(prints[:1], prints[1:2])[0])
        strange.append(ph.likeness_of(prints[:1], prints[2:])[0])
    assert np.quantile(edited, 0.05) > 0.25 and np.median(edited) > 0.4 and np.quantile(strange, 0.95) < 0.1


def test_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, "some text", 1), (2, None, 2)], "doc_id long, text string, fingerprint int")
    out = ph.add_fingerprints(df)
    assert out.columns == ["doc_id", "text", "fingerprint"]
    assert {r.doc_id: r.fingerprint for r in out.collect()} == {1: plain_fingerprint("some text"), 2: "0:::"}
    pairs = out.select("fingerprint", F.when(F.col("doc_id") == 1, F.col("fingerprint")).alias("other"))
    assert sorted(pairs.select(ph.likeness("fingerprint", "other").alias("x")).collect(), key=repr) == [(1.0,), (None,)]
