"""Conversation structure repair: the cheapest edits that give a conversation the roles `(s?(ua)+)?`.

A row is kept (K, free), given the other role (R, 3) or deleted (D, 4; required for blank rows and duplicates), and
empty user or assistant rows may be inserted anywhere (I, 3); a truncated row that stays adds 3. Of equally cheap edits
those whose initials are least in ASCII order win. Edit prefixes are linked nodes that share their beginnings, with
binary-lifting ancestors and rolling hashes: ties are decided at the longest common prefix, found by lifting both nodes,
and a prefix that hashes call equal is verified letter by letter. Two prefixes over the same rows in the same state
with equal cost are never one the beginning of the other (more letters would be more inserts), so the least prefix
stays least whatever follows.

How it runs. Rows without their texts are ordered by (conversation, turn, digest) over ranges, numbered, and cut into
segments of bounded size, so a conversation may have any number of rows. Whether a row was seen earlier comes from one
pre-aggregated minimum by content, joined back by row number. Each segment gives, for each conversation in it, the
cheapest edits from the state in which it starts to the one in which it ends (from all four states for the first, which
may go on from the segment before). Texts are shuffled once, by conversation, together with these spans: the stream of
one conversation begins with its spans, which settle the edits, and its rows follow in order, one batch at a time.
A hash of a whole conversation is sequential by its nature; nothing else is.

Defined cases: a null conversation is one of its own; null roles and texts are one space; null turns come first and
don't count for gaps; rows of one turn follow in order of the MD5 of role and text, equal rows are duplicates of the
first; a role that doesn't begin with s, u or a (or is empty) can't be kept; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.core import checkpointed

from .tables import shard_count

#: States of a repaired conversation: nothing yet, after system, after user, after assistant.
STATES = 4
FINAL = (0, 3)
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The state after a row of the role that must come next, and that role.
NEXT = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
LEGAL = ("su", "ua", "au")
#: Rows of a segment, as a power of two: they fit in one task with all their nodes.
SEGMENT_BITS = 14
WHITE = " \t\n\x0b\x0c\r"
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


class EditNodes:
    """Edit strings as a tree of letters: a node is its parent's string and one letter more."""

    def __init__(self):
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [[]]

    def add(self, parent: int, letter: str) -> int:
        node = len(self.letter)
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * _BASE + ord(letter)) % _PRIME)
        lifts, k = [parent], 0
        while k < len(self.up[lifts[k]]):
            lifts.append(self.up[lifts[k]][k])
            k += 1
        self.up.append(lifts)
        return node

    def ancestor(self, node: int, depth: int) -> int:
        """The node's beginning of `depth` letters."""
        rest = self.depth[node] - depth
        while rest:
            k = rest.bit_length() - 1
            node = self.up[node][k]
            rest -= 1 << k
        return node

    def first_difference(self, a: int, b: int) -> tuple[str, str] | None:
        """The first letters in which two strings of equal length differ, by a walk to where they join."""
        found = None
        while a != b:
            if self.letter[a] != self.letter[b]:
                found = self.letter[a], self.letter[b]
            a, b = self.up[a][0], self.up[b][0]
        return found

    def less(self, a: int, b: int) -> bool:
        """Whether a's string comes before b's."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if self.hash[x] == self.hash[y]:
            letters = self.first_difference(x, y)  # None, but for a collision
        else:
            end = x, y
            for k in reversed(range(len(self.up[x]))):
                if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                    x, y = self.up[x][k], self.up[y][k]
            letters = self.letter[x], self.letter[y]
            if self.first_difference(self.up[x][0], self.up[y][0]) is not None:  # a collision
                letters = self.first_difference(*end)
        return letters[0] < letters[1] if letters else self.depth[a] < self.depth[b]

    def string(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))


#: (cost, node) of the best prefix in each state, None where there is none.
Cells = list


def _offer(cells: Cells, state: int, cost: int, parent: int, letter: str, nodes: EditNodes) -> None:
    held = cells[state]
    if held is None or cost < held[0]:
        cells[state] = cost, nodes.add(parent, letter)
    elif cost == held[0]:
        node = nodes.add(parent, letter)
        if nodes.less(node, held[1]):
            cells[state] = cost, node


def _inserts(cells: Cells, nodes: EditNodes) -> None:
    """Inserted rows before the next one; two at most are ever worth it."""
    for a, b in ((0, 2), (1, 2), (3, 2), (2, 3)):
        if cells[a] is not None:
            _offer(cells, b, cells[a][0] + INSERT_COST, cells[a][1], "I", nodes)


def _consume(cells: Cells, initial: str, must_go: bool, truncated: bool, nodes: EditNodes) -> Cells:
    """The cells after one row more."""
    _inserts(cells, nodes)
    out: Cells = [None] * STATES
    stay = TRUNCATED_COST if truncated else 0
    for state, cell in enumerate(cells):
        if cell is None:
            continue
        cost, node = cell
        if not must_go:
            to = KEEP[state].get(initial)
            if to is not None:
                _offer(out, to, cost + stay, node, "K", nodes)
            _offer(out, NEXT[state], cost + stay + REROLE_COST, node, "R", nodes)
        _offer(out, state, cost + DELETE_COST, node, "D", nodes)
    return out


def span_edits(rows: list[tuple[str, bool, bool]], starts: tuple[int, ...]) -> tuple[list[int], list[str]]:
    """Costs (-1: none) and edits from each state to each, start by start, of rows (initial, must go, truncated)."""
    costs, edits = [-1] * STATES * STATES, [""] * STATES * STATES
    for start in starts:
        nodes = EditNodes()
        cells: Cells = [None] * STATES
        cells[start] = 0, 0
        for initial, must_go, truncated in rows:
            cells = _consume(cells, initial, must_go, truncated, nodes)
        for end, cell in enumerate(cells):
            if cell is not None:
                costs[STATES * start + end], edits[STATES * start + end] = cell[0], nodes.string(cell[1])
    return costs, edits


class _Pieces:
    """Edits of several spans as linked pieces; only what lies behind the common ones is compared."""

    __slots__ = ("parent", "piece", "depth")

    def __init__(self, parent: _Pieces | None, piece: str):
        self.parent, self.piece, self.depth = parent, piece, parent.depth + 1 if parent else 0

    def less(self, other: _Pieces) -> bool:
        a, b, mine, its = self, other, [], []
        while a is not b:
            if a.depth >= b.depth:
                mine.append(a.piece)
                a = a.parent
            else:
                its.append(b.piece)
                b = b.parent
        return "".join(reversed(mine)) < "".join(reversed(its))

    def string(self) -> str:
        out, at = [], self
        while at is not None:
            out.append(at.piece)
            at = at.parent
        return "".join(reversed(out))


def join_spans(spans: list[tuple[list[int], list[str]]]) -> tuple[int, str]:
    """(cost, edits) of a conversation from those of its spans in order."""

    def offer(cells, state, cost, parent, piece):
        made = cost, _Pieces(parent, piece)
        if cells[state] is None or cost < cells[state][0] or cost == cells[state][0] and made[1].less(cells[state][1]):
            cells[state] = made

    cells = [(0, _Pieces(None, "")), None, None, None]
    for costs, edits in spans:
        after = [None] * STATES
        for start, cell in enumerate(cells):
            for end in range(STATES):
                k = STATES * start + end
                if cell is not None and costs[k] >= 0:
                    offer(after, end, cell[0] + costs[k], cell[1], edits[k])
        cells = after
    for a, b in ((0, 2), (1, 2), (3, 2), (2, 3)):
        if cells[a] is not None:
            offer(cells, b, cells[a][0] + INSERT_COST, cells[a][1], "I")
    best = None
    for state in FINAL:
        cell = cells[state]
        if cell is not None and (best is None or cell[0] < best[0] or cell[0] == best[0] and cell[1].less(best[1])):
            best = cell
    return best[0], best[1].string()


class Repair:
    """The repaired rows of a conversation, from its edits and its rows in order."""

    def __init__(self, edits: str):
        self.edits, self.at, self.state = edits, 0, 0

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            role = ROLE[self.state]
            self.at, self.state = self.at + 1, NEXT[self.state]
            yield "I", role, ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the rows inserted before this one, and of this one unless it goes."""
        yield from self.inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "D":
            return
        if edit == "K":
            self.state = KEEP[self.state][role[:1]]
        else:
            role, self.state = ROLE[self.state], NEXT[self.state]
        yield edit, role, text


def _rows(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, digest) with nulls as spaces."""
    said = df.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
    )
    return said.withColumn("digest", F.md5(F.concat_ws(":", F.char_length("role").cast("string"), "role", "text")))


def spans(rows: DataFrame) -> DataFrame:
    """(conv, segment, facts, costs, edits) of the conversations in each segment of the ordered rows."""
    trimmed = F.rtrim("text", F.lit(WHITE))
    light = rows.select(
        "conv", "turn", "digest", F.substring("role", 1, 1).alias("initial"), (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("truncated")
    )
    shards = shard_count(rows.sparkSession)
    # equal rows may be very many: the number of the row lets ranges cut among them
    light = light.withColumn("salt", F.monotonically_increasing_id())
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("salt")]
    light = light.repartitionByRange(shards, *order).sortWithinPartitions(*order).drop("salt")
    light = checkpointed(light.withColumn("pos", F.monotonically_increasing_id()))
    first = light.groupBy("conv", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    flagged = light.drop("digest").join(first, "pos", "left").withColumn("segment", F.shiftright("pos", SEGMENT_BITS))
    kind = rows.schema["conv"].dataType.simpleString()
    return flagged.groupBy("segment").applyInArrow(_segment_spans, f"conv {kind}, segment long, facts array<long>, costs array<long>, edits array<string>")


def _segment_spans(table: pa.Table) -> pa.Table:
    table = table.sort_by("pos")
    conv, turn, initial = (table[c].to_pylist() for c in ("conv", "turn", "initial"))
    blank, truncated = table["blank"].to_pylist(), table["truncated"].to_pylist()
    duplicate = [x is None for x in table["first"].to_pylist()]
    out: list[tuple] = []
    a = 0
    while a < len(conv):
        b = a + 1
        while b < len(conv) and conv[b] == conv[a]:
            b += 1
        run = range(a, b)
        given = [t for t in turn[a:b] if t is not None]
        facts = [
            sum(blank[a:b]),
            sum(duplicate[k] and not blank[k] for k in run),
            sum(truncated[k] and not duplicate[k] and not blank[k] for k in run),
            sum(initial[k] + initial[k + 1] not in LEGAL for k in range(a, b - 1)),
            ord(initial[a] or "\0"),
            ord(initial[b - 1] or "\0"),
            len(set(given)),
            min(given, default=None),
            max(given, default=None),
        ]
        rows = [(initial[k], blank[k] or duplicate[k], truncated[k]) for k in run]
        costs, edits = span_edits(rows, (0,) if a else tuple(range(STATES)))
        out.append((facts, costs, edits))
        a = b
    starts = [k for k in range(len(conv)) if k == 0 or conv[k] != conv[k - 1]]
    return pa.Table.from_arrays(
        [
            table["conv"].take(pa.array(starts, pa.int64())),
            pa.array([table["segment"][0].as_py()] * len(out), pa.int64()),
            *(pa.array([x[k] for x in out], pa.list_(t)) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))),
        ],
        names=["conv", "segment", "facts", "costs", "edits"],
    )


def _totals(facts: list[list]) -> list[int]:
    """gaps, blank, duplicate, truncated, illegal of a conversation from the facts of its spans."""
    blank, duplicate, truncated, illegal, distinct = (sum(f[k] for f in facts) for k in (0, 1, 2, 3, 6))
    for f, g in zip(facts, facts[1:]):
        illegal += (chr(f[5]) + chr(g[4])).replace("\0", "") not in LEGAL
    last = None
    for f in facts:  # a turn cut by a border of segments counts once
        distinct -= last is not None and f[7] == last
        last = f[8] if f[8] is not None else last
    low, high = (pick((f[k] for f in facts if f[k] is not None), default=None) for pick, k in ((min, 7), (max, 8)))
    gaps = 0 if low is None else high - low + 1 - distinct
    return [gaps, blank, duplicate, truncated, illegal]


class Settled:
    """What the spans of one conversation say: totals, cost and edits."""

    def __init__(self, parts: list[tuple[list, list, list]]):
        self.totals = _totals([p[0] for p in parts])
        self.cost, self.edits = join_spans([(p[1], p[2]) for p in parts])


#: Takes (conversation, its settled edits, its rows in order) and yields result rows; it must use up the rows.
Consumer = Callable[[object, Settled, Iterator[tuple[str, str]]], Iterator[tuple]]


def _stream(rows: DataFrame, consumer: Consumer, names: list[str], types: list[pa.DataType], schema: str) -> DataFrame:
    """Every conversation through `consumer`: one shuffle of the texts by conversation."""
    nothing = F.lit(None)
    said = rows.select(
        "conv", F.lit(1).alias("part"), nothing.cast("long").alias("segment"), "turn", "digest", "role", "text",
        nothing.cast("array<long>").alias("facts"), nothing.cast("array<long>").alias("costs"), nothing.cast("array<string>").alias("edits"),
    )
    found = spans(rows).select(
        "conv", F.lit(0).alias("part"), "segment", *[nothing.cast(t).alias(c) for c, t in (("turn", "long"), ("digest", "string"), ("role", "string"), ("text", "string"))],
        "facts", "costs", "edits",
    )
    order = [F.col("conv").asc_nulls_first(), F.col("part"), F.col("segment"), F.col("turn").asc_nulls_first(), F.col("digest")]
    both = said.unionByName(found).repartition(shard_count(rows.sparkSession), "conv").sortWithinPartitions(*order)
    columns = ("conv", "part", "role", "text", "facts", "costs", "edits")

    def records(batches) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns))

    def walk(batches):
        stream = records(batches)
        ahead = [next(stream, None)]

        def take(conv, part):
            while ahead[0] is not None and ahead[0][0] == conv and ahead[0][1] == part:
                row, ahead[0] = ahead[0], next(stream, None)
                yield row

        made: list[tuple] = []
        size = 0
        while ahead[0] is not None:
            conv = ahead[0][0]
            settled = Settled([r[4:7] for r in take(conv, 0)])
            for row in consumer(conv, settled, (r[2:4] for r in take(conv, 1))):
                made.append(row)
                size += sum(len(x) for x in row if isinstance(x, str))
                if len(made) >= 4096 or size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names=names)
                    made, size = [], 0
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names=names)

    return both.mapInArrow(walk, schema)


def _conv_type(rows: DataFrame) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["conv"].dataType
    return kind.simpleString(), to_arrow_type(kind)


def repair_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, place, edit, role, text): the repaired rows, numbered from 1; edit is K, R or I."""
    rows = _rows(df, conv, turn, role, text)
    kind, arrow = _conv_type(rows)

    def consumer(name, settled, said):
        repair, place = Repair(settled.edits), 0
        for one in said:
            for edit, its_role, its_text in repair.row(*one):
                place += 1
                yield name, place, edit, its_role, its_text
        for edit, its_role, its_text in repair.inserted():
            place += 1
            yield name, place, edit, its_role, its_text

    out = _stream(rows, consumer, ["conv", "place", "edit", "role", "text"], [arrow, pa.int64(), pa.string(), pa.string(), pa.string()], f"conv {kind}, place long, edit string, role string, text string")
    return out.withColumnRenamed("conv", conv)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audit_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: gaps, faults, illegal neighbours, cost, audit (edits' initials), SHA-256 of the repair."""
    rows = _rows(df, conv, turn, role, text)
    kind, arrow = _conv_type(rows)

    def consumer(name, settled, said):
        repair, digest, begun = Repair(settled.edits), hashlib.sha256(), False

        def put(lines):
            nonlocal begun
            for _, its_role, its_text in lines:
                digest.update((("\n" if begun else "") + its_role + ":" + its_text).encode())
                begun = True

        for one in said:
            put(repair.row(*one))
        put(repair.inserted())
        yield name, *settled.totals, settled.cost, settled.edits, digest.hexdigest()

    names = ["conv", *COUNTS, "audit", "repaired_sha256"]
    schema = f"conv {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
    out = _stream(rows, consumer, names, [arrow, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()], schema)
    return out.withColumnRenamed("conv", conv)


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with planted faults, drawn by the CRC of `conversation:turn`."""

    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn)).cast("binary")) % 20
    drawn = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), kind.alias("kind")).filter("kind != 0")
    said = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = drawn.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), "kind")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("kind", "copy")


def damaged_audits(df: DataFrame) -> DataFrame:
    """The audit of every conversation after `damage`; one that has lost all rows has zeros and an empty repair."""
    ids = df.select(F.col("conv_id").alias("conv")).distinct()
    found = audit_conversations(damage(df))
    joined = ids.join(found, F.col("conv").eqNullSafe(F.col("conv_id")), "left")
    return joined.select(
        F.col("conv").alias("conv_id"),
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


REPAIR_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)) bytes),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
drawn AS (SELECT conv_id, turn, role, text,
                 xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(k) + 1), lambda i: CAST(ord(k[i]) AS BIGINT))),
                                 lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 20 AS kind
          FROM named, crc_table),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
            FROM drawn WHERE kind <> 0),
ordered AS (SELECT conv_id, turn, role, text, left(role, 1) AS initial, rtrim(text, E' \t\n\x0b\x0c\r') AS trimmed,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || ':' || text)) AS i
            FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM ordered),
facts AS (SELECT *, trimmed = '' AS blank, trimmed <> '' AND again AS duplicate, trimmed <> '' AND NOT again AND right(trimmed, 1) NOT IN ('.', '!', '?') AS truncated,
                 lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal
          FROM seen),
totals AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count_if(blank) AS blank,
                  count_if(duplicate) AS duplicate, count_if(truncated) AS truncated, count_if(illegal) AS illegal, count(*) AS n
           FROM facts GROUP BY conv_id),
inserts(a, b, price, letters, lines) AS (VALUES
  (0, 0, 0, '', []), (0, 2, 3, 'I', ['user:']), (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []), (1, 2, 3, 'I', ['user:']),
  (1, 3, 6, 'II', ['user:', 'assistant:']), (2, 2, 0, '', []), (2, 3, 3, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 3, 'I', ['user:'])),
edits(b, initial, c, price, letter, role) AS (VALUES
  (0, 's', 1, 0, 'K', ''), (0, 'u', 2, 0, 'K', ''), (1, 'u', 2, 0, 'K', ''), (2, 'a', 3, 0, 'K', ''), (3, 'u', 2, 0, 'K', ''),
  (0, NULL, 2, 3, 'R', 'user'), (1, NULL, 2, 3, 'R', 'user'), (2, NULL, 3, 3, 'R', 'assistant'), (3, NULL, 2, 3, 'R', 'user'),
  (0, NULL, 0, 4, 'D', NULL), (1, NULL, 1, 4, 'D', NULL), (2, NULL, 2, 4, 'D', NULL), (3, NULL, 3, 4, 'D', NULL)),
walked AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM totals
  UNION ALL
  SELECT conv_id, i, state, cost, audit, lines FROM (
    SELECT w.conv_id, f.i, e.c AS state,
           w.cost + n.price + e.price + CASE WHEN f.truncated AND e.letter <> 'D' THEN 3 ELSE 0 END AS cost, w.audit || n.letters || e.letter AS audit,
           list_concat(w.lines, n.lines, CASE e.letter WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [e.role || ':' || f.text] END) AS lines
    FROM walked w JOIN inserts n ON n.a = w.state JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
    JOIN edits e ON e.b = n.b AND (e.initial IS NULL OR e.initial = f.initial) AND (e.letter = 'D' OR NOT (f.blank OR f.duplicate))
    QUALIFY row_number() OVER (PARTITION BY w.conv_id, f.i, e.c ORDER BY w.cost + n.price + e.price + CASE WHEN f.truncated AND e.letter <> 'D' THEN 3 ELSE 0 END,
                                                                            w.audit || n.letters || e.letter) = 1) best),
ended AS (SELECT w.conv_id, w.cost + n.price AS cost, w.audit || n.letters AS audit, list_concat(w.lines, n.lines) AS lines
          FROM walked w JOIN totals t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.i JOIN inserts n ON n.a = w.state WHERE n.b IN (0, 3)
          QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + n.price, w.audit || n.letters) = 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN totals t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
