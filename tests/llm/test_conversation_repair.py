"""Conversation repair against enumeration of all edits, and awkward rows."""

import hashlib
import random
import re
import zlib

import pytest

from tabloom.llm import conversation_repair as cr

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")
WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, segment long, pos long, digest string, part int, conv string"


def enumerated(rows):
    """(cost, audit, lines) of the best edits of rows (role, text, must_go, truncated), over all of them."""
    best = None

    def walk(k, cost, audit, lines):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if k == len(rows):
            for extra in range(3):
                for ends in ([], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]):
                    if len(ends) == extra:
                        out = lines + [(r, "") for r in ends]
                        if GRAMMAR.match("".join(r[:1] or " " for r, _ in out)):
                            found = cost + 3 * extra, audit + "I" * extra, out
                            if best is None or found[:2] < best[:2]:
                                best = found
            return
        role, text, must_go, truncated = rows[k]
        for before in ([], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]):
            c, a, out = cost + 3 * len(before), audit + "I" * len(before), lines + [(r, "") for r in before]
            walk(k + 1, c + 4, a + "D", out)
            if not must_go:
                c += 3 * truncated
                walk(k + 1, c, a + "K", out + [(role, text)])
                for other in ("user", "assistant"):
                    walk(k + 1, c + 3, a + "R", out + [(other, text)])

    walk(0, 0, "", [])
    return best


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest()


def expected(rows):
    """The audit of one conversation's rows (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(*r[1:])))
    seen, flagged, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        body = text.rstrip(WHITE)
        fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        flagged.append((role, text, fault in (0, 1), fault == 2))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, lines = enumerated(flagged)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return gaps, *counts, illegal, cost, audit, sha


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(4)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "u"]
    texts = ["Yes.", "No!", "cut", "", " \n", None, "More? ", "é.", "long text " * 40 + "."]
    out = {}
    for conv in [None, *range(40)]:
        n = rng.randint(1, 5)
        out[conv] = [(rng.choice([None, rng.randint(0, 6), k]), rng.choice(roles), rng.choice(texts)) for k in range(n)]
    out[50] = [(0, "user", "Hi.")] * 3
    return out


def frame(spark, conversations):
    rows = [(c, *r, 1, 2, "d", 3, "e") for c, rows in conversations.items() for r in rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("bits", [0, 1, 14])
def test_audits_equal_enumeration(spark, conversations, bits, monkeypatch):
    monkeypatch.setattr(cr, "SEGMENT_BITS", bits)
    got = {r[0]: tuple(r[1:]) for r in cr.audit_conversations(frame(spark, conversations)).collect()}
    assert got == {c: expected(rows) for c, rows in conversations.items()}


def test_repaired_rows(spark, conversations):
    found = {}
    for r in sorted(cr.repair_conversations(frame(spark, conversations)).collect(), key=lambda r: r.place):
        found.setdefault(r.conv_id, []).append(r)
    for conv, rows in conversations.items():
        lines = found.get(conv, [])
        assert [r.place for r in lines] == list(range(1, len(lines) + 1))
        assert GRAMMAR.match("".join(r.role[:1] for r in lines))
        sha = hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in lines).encode()).hexdigest()
        assert sha == expected(rows)[-1]


def test_damage(spark, conversations):
    rows = [(c, *r) for c, rows in conversations.items() for r in rows]
    out = []
    for c, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(c, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    got = [tuple(r) for r in cr.damage(frame(spark, conversations)).collect()]
    assert sorted(got, key=repr) == sorted(out, key=repr)


def test_damaged_audits_keep_every_conversation(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = cr.damaged_audits(frame(spark, {gone: [(0, "user", "Hi.")]})).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert cr.damaged_audits(frame(spark, {gone: [(0, "user", "Hi.")]}).limit(0)).count() == 0


def test_text_conversation_ids(spark):
    df = spark.createDataFrame([("a", 0, "user", "Hi."), ("b", 0, "assistant", "Well.")], "conv_id string, turn long, role string, text string")
    got = {r.conv_id: r.audit for r in cr.audit_conversations(df).collect()}
    assert got == {"a": "KI", "b": "IK"}


def test_one_long_conversation_in_many_segments(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(k, rng.choice(["user", "assistant"]), f"{rng.randint(0, 400)}.") for k in range(900)]
    whole = cr.audit_conversations(frame(spark, {1: rows})).first()
    monkeypatch.setattr(cr, "SEGMENT_BITS", 3)
    assert cr.audit_conversations(frame(spark, {1: rows})).first() == whole


def test_ties_by_common_prefix_and_collisions():
    nodes = cr.EditNodes()
    rng = random.Random(2)
    made = [0]
    for _ in range(600):
        made.append(nodes.add(rng.choice(made[-40:]), rng.choice("DIKR")))
    for flat in (False, True):
        if flat:  # every hash collides: each answer rests on the letters
            nodes.hash = [0] * len(nodes.hash)
        for _ in range(3000):
            a, b = rng.choice(made), rng.choice(made)
            assert nodes.less(a, b) == (nodes.string(a) < nodes.string(b))
