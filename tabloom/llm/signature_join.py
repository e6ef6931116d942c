"""N-gram Jaccard join with signature trees: near-duplicate groups that lose no link.

A document's set holds the hashes of its distinct word shingles. Which shingles other documents have, and how many
about, is counted over the whole corpus (sorted key lists by chunk and shard, see `repeats`). With shingles ordered
from rare to frequent, two sets of the wanted similarity share one of their first n - ceil(t n) + 1 shingles; sets
whose prefix holds only shingles of their own have no link and take no further part. This cuts nothing: the order only
decides which shingles are looked at.

Sets that share a prefix shingle meet in the group of that shingle's smallest set. There a signature tree is walked
against itself: nodes hold OR-combined bitmaps and size ranges, a pair of nodes is dropped when the largest overlap that
bitmaps and sizes allow is too small for any two sets below, and surviving pairs of sets that are not linked already
are compared exactly. Groups with more sets than a block are cut into blocks, and every two blocks meet in a task of
their own; equal sets are one set all the way. Links then give components (`components`).

Defined cases: a null or empty text has an empty set and is linked with nothing; a null id counts as the largest, and
its group of one has a null component; repeated rows are linked to each other; an empty table gives no rows; the
result replaces input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.core import checkpointed

from .arrays import SpanHasher, Words, mix, ranges, spans_inside, text_bytes
from .components import components
from .repeats import KEY_BITS, NO_ID, _ROWS, _table, expand, expand_sorted, id_values, join_parts, key_lists, pack_chunks, split_parts, squeeze, squeeze_sorted, unpack
from .tables import shard_count

#: Similarity in percent and words of a shingle, unless the caller says otherwise.
PERCENT = 80
SHINGLE = 5
#: Sets of a group that one task compares with as many others.
BLOCK_SETS = 1500
#: Bits of a shingle's hash by which two sets are compared.
SET_BITS = 48
FANOUT = 8
MAX_SIGNATURE_BITS = 1 << 14


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each document, cuts between documents)."""
    words = Words(data, offsets)
    hasher = SpanHasher(words.hashes(lower=True))
    begin, owner = spans_inside(words.cuts, shingle)
    short = np.flatnonzero((words.per_document > 0) & (words.per_document < shingle))
    hashes = np.concatenate([hasher.spans(begin, begin + shingle), hasher.spans(words.cuts[short], words.cuts[short + 1])])
    owner = np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(offsets)))


def needed_prefix(size: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return size - (percent * size + 99) // 100 + 1


class SignatureForest:
    """A tree of bitmaps over the sets of each group; leaves are sets, inner nodes have up to FANOUT children."""

    def __init__(self, tokens: np.ndarray, cuts: np.ndarray, group: np.ndarray):
        sizes = np.diff(cuts)
        bits = min(MAX_SIGNATURE_BITS, max(64, 1 << int(2 * max(1, np.median(sizes))).bit_length()))
        # like sets next to each other: by group, size and a hash of the set
        low = np.minimum.reduceat(tokens, cuts[:-1]) if len(sizes) else sizes
        self.leaf_order = np.lexsort((low, sizes, group))
        rank = np.empty(len(sizes), np.int64)
        rank[self.leaf_order] = np.arange(len(sizes))
        owner = rank[np.repeat(np.arange(len(sizes)), sizes)]
        bit = (mix(tokens) % np.uint64(bits)).astype(np.int64)
        maps = np.zeros((len(sizes), bits // 64), np.uint64)
        np.bitwise_or.at(maps, (owner, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        level = {
            "maps": maps,
            "low": sizes[self.leaf_order],
            "high": sizes[self.leaf_order],
            "hidden": sizes[self.leaf_order] - np.bitwise_count(maps).sum(axis=1).astype(np.int64),
            "group": group[self.leaf_order],
        }
        self.levels = [level]
        while True:
            below = self.levels[-1]
            start = np.flatnonzero(np.append(True, below["group"][1:] != below["group"][:-1]))
            count = np.diff(np.append(start, len(below["group"])))
            if count.max() == 1:
                break
            nodes = -(-count // FANOUT)
            child = np.repeat(start, nodes) + FANOUT * ranges(np.zeros(len(start), np.int64), nodes)
            self.levels.append(
                {
                    "maps": np.bitwise_or.reduceat(below["maps"], child, axis=0),
                    "low": np.minimum.reduceat(below["low"], child),
                    "high": np.maximum.reduceat(below["high"], child),
                    "hidden": np.maximum.reduceat(below["hidden"], child),
                    "group": below["group"][child],
                    "child": child,
                    "children": np.diff(np.append(child, len(below["group"]))),
                }
            )
        self.roots = dict(zip(self.levels[-1]["group"].tolist(), range(len(self.levels[-1]["group"]))))

    def bound(self, level: dict, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether any set below node a may be similar enough to any below node b."""
        small_high, large_low = np.minimum(level["high"][a], level["high"][b]), np.maximum(level["low"][a], level["low"][b])
        fine = 100 * small_high >= percent * large_low
        at = np.flatnonzero(fine)
        for piece in np.array_split(at, max(1, len(at) * level["maps"].shape[1] // (1 << 21))):
            x, y = a[piece], b[piece]
            common = np.bitwise_count(level["maps"][x] & level["maps"][y]).sum(axis=1).astype(np.int64)
            most = np.minimum(common + np.minimum(level["hidden"][x], level["hidden"][y]), small_high[piece])
            fine[piece] = (100 + percent) * most >= percent * (level["low"][x] + level["low"][y])
        return fine

    def candidates(self, first: np.ndarray, second: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves (numbers of sets) that no bound excludes; starts from pairs of roots (first, second)."""
        stack = [(len(self.levels) - 1, first, second)]
        while stack:
            depth, a, b = stack.pop()
            keep = self.bound(self.levels[depth], a, b, percent)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if depth == 0:
                leaf = a != b
                yield self.leaf_order[a[leaf]], self.leaf_order[b[leaf]]
                continue
            level = self.levels[depth]
            for s in range(0, len(a), 1 << 14):  # pairs of children stay a bounded frontier
                x, y = a[s : s + (1 << 14)], b[s : s + (1 << 14)]
                n, m = level["children"][x], level["children"][y]
                pair = np.repeat(np.arange(len(x)), n * m)
                inner = ranges(np.zeros(len(x), np.int64), n * m)
                left, right = level["child"][x][pair] + inner // m[pair], level["child"][y][pair] + inner % m[pair]
                once = (x != y)[pair] | (left <= right)
                stack.append((depth - 1, left[once], right[once]))


class Links:
    """Union-find over numbers 0 .. n - 1."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: int) -> int:
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def roots(self, which: np.ndarray) -> np.ndarray:
        out = self.parent[which]
        while True:
            up = self.parent[out]
            if (up == out).all():
                return out
            out = up


def similar_sets(tokens: np.ndarray, cuts: np.ndarray, group: np.ndarray, node: np.ndarray, starts: list[tuple[int, int]], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (a, b) between entries of groups that connect all sets of the wanted similarity. `node` numbers equal
    sets alike; `starts` lists the pairs of groups to walk against each other."""
    forest = SignatureForest(tokens, cuts, group)
    sizes = np.diff(cuts)
    local = np.unique(tokens, return_inverse=True)[1]
    mark = np.zeros(int(local.max()) + 1 if len(local) else 0, bool)
    joined = Links(int(node.max()) + 1)
    links = []
    first = np.array([forest.roots[a] for a, _ in starts])
    second = np.array([forest.roots[b] for _, b in starts])
    for a, b in forest.candidates(first, second, percent):
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        at = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else a
        for s, e in zip(at.tolist(), [*at[1:].tolist(), len(a)]):
            x, others = int(a[s]), b[s:e]
            others = others[joined.roots(node[others]) != joined.find(int(node[x]))]
            if not len(others):
                continue
            own = local[cuts[x] : cuts[x + 1]]
            mark[own] = True
            hit = mark[local[ranges(cuts[others], sizes[others])]]
            overlap = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes[others]) - sizes[others])
            mark[own] = False
            for y in others[(100 + percent) * overlap >= percent * (sizes[x] + sizes[others])].tolist():
                p, q = joined.find(int(node[x])), joined.find(int(node[y]))
                if p != q:
                    joined.parent[max(p, q)] = min(p, q)
                    links.append((x, y))
    return links


def _frequency_classes(blobs: list[bytes]) -> list[bytes]:
    """For the key lists of one shard: 0 for a key of one document, else the logarithm of how many have it."""
    lists = [split_parts(b) for b in blobs]
    keys = [expand_sorted(x[0]) for x in lists]
    docs = np.concatenate([expand(x[1], np.uint8) for x in lists]).astype(np.int64)
    _, where = np.unique(np.concatenate(keys), return_inverse=True)
    level = np.log2(np.bincount(where, docs)).astype(np.uint8)[where]
    return [squeeze(part) for part in np.split(level, np.cumsum([len(k) for k in keys])[:-1])]


def _group_name(leader: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return mix(leader + i.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + j.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def document_sets(chunks: DataFrame, key: str, text: str, percent: int, shingle: int, shards: int) -> DataFrame:
    """(chunk, row, doc, n, set_id, prefix, tokens) of every row; the last three are null where no link is possible."""

    def listed(batches):
        for batch in batches:
            for chunk, blob in zip(batch["chunk"].to_pylist(), batch["blob"]):
                hashes, cuts = shingle_sets(*text_bytes(unpack(blob.as_buffer())[text]), shingle)
                owner = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
                yield _table(list(key_lists(chunk, hashes >> np.uint64(64 - KEY_BITS), owner, shards, 0)))

    def answered(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        made = _frequency_classes(table["blob"].to_pylist())
        return table.set_column(3, "blob", pa.array(made, pa.binary()))

    def ordered(batches):
        for batch in batches:
            for chunk, blob, answers in zip(batch["chunk"].to_pylist(), batch["blob"], batch["answers"].to_pylist()):
                docs = unpack(blob.as_buffer())
                hashes, cuts = shingle_sets(*text_bytes(docs[text]), shingle)
                size = np.diff(cuts)
                keys = hashes >> np.uint64(64 - KEY_BITS)
                if answers:
                    level = np.concatenate([expand(b, np.uint8) for _, b in sorted((a["shard"], a["blob"]) for a in answers)])
                    level = level[np.unique(keys, return_inverse=True)[1]]
                else:
                    level = np.zeros(0, np.uint8)
                owner = np.repeat(np.arange(len(size)), size)
                own = np.bincount(owner[level == 0], minlength=len(size))
                prefix = needed_prefix(size, percent) - own
                rows = {"set_id": [None] * len(size), "prefix": [None] * len(size), "tokens": [None] * len(size)}
                for d in np.flatnonzero((size > 0) & (prefix > 0)).tolist():
                    part = slice(cuts[d], cuts[d + 1])
                    h, lv = hashes[part], level[part]
                    order = np.lexsort((h, lv))[own[d] :]
                    rows["set_id"][d] = int(mix(np.array([mix(h).sum(dtype=np.uint64) + np.uint64(len(h))], np.uint64)).view(np.int64)[0])
                    rows["prefix"][d] = h[order[: prefix[d]]].tobytes()
                    rows["tokens"][d] = squeeze_sorted(h[lv > 0] >> np.uint64(64 - SET_BITS))
                yield pa.RecordBatch.from_pydict(
                    {
                        "chunk": pa.array([chunk] * len(size), pa.int64()),
                        "row": pa.array(np.arange(len(size)), pa.int32()),
                        "doc": pa.array(id_values(docs[key]), pa.int64()),
                        "n": pa.array(size, pa.int64()),
                        "set_id": pa.array(rows["set_id"], pa.int64()),
                        "prefix": pa.array(rows["prefix"], pa.binary()),
                        "tokens": pa.array(rows["tokens"], pa.binary()),
                    }
                )

    lists = chunks.mapInArrow(listed, _ROWS).groupBy("shard").applyInArrow(answered, _ROWS)
    per_chunk = lists.groupBy("chunk").agg(F.collect_list(F.struct("shard", "blob")).alias("answers"))
    both = chunks.join(per_chunk, "chunk", "left").select("chunk", "blob", "answers")
    return checkpointed(both.mapInArrow(ordered, "chunk long, row int, doc long, n long, set_id long, prefix binary, tokens binary"))


def meeting_groups(sets: DataFrame) -> DataFrame:
    """(leader, member): sets that share a prefix shingle, by the smallest set that has it; each pair once.

    The smallest set of a shingle is pre-aggregated, and the join back may be split: a shingle that very many sets have
    fills no task.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = [np.frombuffer(p.as_buffer(), np.int64) for p in batch["prefix"]]
            if not prefix:
                continue
            member = np.repeat(batch["set_id"].to_numpy(zero_copy_only=False), [len(p) for p in prefix])
            # equal sets of a batch once
            rows = np.unique(np.stack([np.concatenate(prefix), member]), axis=1)
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(rows[0]), "member": pa.array(rows[1])})

    rows = sets.select("set_id", "prefix").mapInArrow(listed, "shingle long, member long")
    leaders = rows.groupBy("shingle").agg(F.min("member").alias("leader"), F.max("member").alias("last"))
    leaders = leaders.filter("leader < last").select("shingle", "leader")
    return rows.join(leaders, "shingle").select("leader", "member").distinct()


def set_links(sets: DataFrame, groups: DataFrame, percent: int, shards: int, block: int = BLOCK_SETS) -> DataFrame:
    """(a, b): links that connect all similar sets."""
    groups = checkpointed(groups)
    # groups of more than one block: their number of blocks, for the tasks in which a member takes part
    big = groups.groupBy("leader").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > block)
    big = big.select("leader", F.ceil(F.col("members") / block).cast("int").alias("blocks"))
    placed = groups.join(big, "leader", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.struct(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    placed = placed.select("leader", "member", "own", task.alias("task")).select("leader", "member", "own", "task.i", "task.j")
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("leader", "i", "j"), F.lit(shards)).cast("int"))
    full = placed.join(sets.select(F.col("set_id").alias("member"), "n", "tokens").dropDuplicates(["member"]), "member")
    full = full.select("shard", "leader", "member", "own", "i", "j", "n", "tokens")

    def walked(table: pa.Table) -> pa.Table:
        column = {c: table[c].combine_chunks() for c in table.column_names}
        leader, member = (column[c].to_numpy(zero_copy_only=False).view(np.uint64) for c in ("leader", "member"))
        i, j, own = (column[c].to_numpy(zero_copy_only=False) for c in ("i", "j", "own"))
        lists = [expand_sorted(t.as_buffer()) for t in column["tokens"]]
        # a set's shingles that no other document has: they count for its size alone
        lone = column["n"].to_numpy(zero_copy_only=False) - np.array([len(x) for x in lists])
        node, numbers = np.unique(member, return_inverse=True)
        name = _group_name(leader, i, j) + own.astype(np.uint64)
        names, group = np.unique(name, return_inverse=True)
        of_task: dict[tuple, set[int]] = {}
        for t, g in zip(zip(leader.tolist(), i.tolist(), j.tolist()), group.tolist()):
            of_task.setdefault(t, set()).add(g)
        starts = []
        for (_, a, b), held in of_task.items():
            gs = sorted(held)
            starts += [(g, g) for g in gs] if a == b else [(gs[0], gs[1])] if len(gs) == 2 else []
        if not starts:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        # lone shingles become values that no other set has
        filler = [np.arange(k, dtype=np.uint64) + (np.uint64(1) << np.uint64(63)) + np.uint64(n) * np.uint64(1 << 32) for n, k in zip(numbers, lone)]
        tokens = np.concatenate([x for pair in zip(lists, filler) for x in pair])
        cuts = np.concatenate([[0], np.cumsum(column["n"].to_numpy(zero_copy_only=False))])
        found = similar_sets(tokens, cuts, group, numbers, starts, percent)
        pairs = np.array(found, np.int64).reshape(-1, 2)
        signed = member.view(np.int64)
        return pa.table({"a": pa.array(signed[pairs[:, 0]], pa.int64()), "b": pa.array(signed[pairs[:, 1]], pa.int64())})

    return full.groupBy("shard").applyInArrow(walked, "a long, b long")


def near_duplicate_rows(chunks: DataFrame, key: str, text: str, percent: int = PERCENT, shingle: int = SHINGLE, block: int = BLOCK_SETS) -> DataFrame:
    """(chunk, row, doc, n, component, member): of every row of the chunks; component is the smallest id of its group,
    member the group's number, null for a row without links."""
    shards = shard_count(chunks.sparkSession)
    rows = document_sets(chunks, key, text, percent, shingle, shards)
    sets = rows.filter(F.col("set_id").isNotNull())
    links = set_links(sets, meeting_groups(sets), percent, shards, block)
    of_set = components(links).withColumnRenamed("node", "set_id")
    narrow = rows.select("chunk", "row", "doc", "n", "set_id")
    # rows without a possible link need no join: they would all have the same null key
    lone = narrow.filter(F.col("set_id").isNull()).select("chunk", "row", "doc", "n", F.col("set_id").alias("member"), F.col("doc").alias("component"))
    named = narrow.filter(F.col("set_id").isNotNull()).join(of_set, "set_id", "left")
    named = named.withColumn("member", F.coalesce("component", "set_id")).drop("component")
    least = named.groupBy("member").agg(F.min("doc").alias("component"))
    return named.join(least, "member").select("chunk", "row", "doc", "n", "member", "component").unionByName(lone)


def near_duplicate_classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE, block: int = BLOCK_SETS
) -> DataFrame:
    """(key, n_shingles, component_id) of every row."""
    chunks = pack_chunks(docs.select(key, text), text)
    found = near_duplicate_rows(chunks, key, text, percent, shingle, block)
    whole = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select(whole("doc").alias(key), F.col("n").alias("n_shingles"), whole("component").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """The rows, unchanged, without those of which a near-duplicate with a smaller id stays; of repeated rows one."""
    chunks = pack_chunks(docs, text)
    found = near_duplicate_rows(chunks, key, text, percent, shingle)
    linked, lone = found.filter(F.col("member").isNotNull()), found.filter(F.col("member").isNull())
    first = linked.groupBy("member").agg(F.min(F.struct("doc", "chunk", "row")).alias("first"))
    stays = lone.select("chunk", "row").unionByName(first.select("first.chunk", "first.row"))
    kept = stays.groupBy("chunk").agg(F.collect_list("row").alias("kept"))

    def read(batches):
        for batch in batches:
            for blob, rows in zip(batch["blob"], batch["kept"].to_pylist()):
                yield unpack(blob.as_buffer()).take(pa.array(sorted(rows), pa.int64()))

    return chunks.join(kept, "chunk").select("blob", "kept").mapInArrow(read, docs.schema)


NEAR_DUPLICATE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
twoway AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM twoway UNION SELECT reach.doc_id, twoway.b FROM reach JOIN twoway ON twoway.a = reach.other),
least AS (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(least, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""
