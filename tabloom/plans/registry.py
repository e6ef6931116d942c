"""Registered queries and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.tables import table

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Views over the given tables, written in SQL that Spark and DuckDB both read.
FIXTURES = {
    "fx_txn": """
        SELECT o_orderkey AS id, o_custkey AS customer_id, o_totalprice AS amount, o_orderdate AS txn_dt FROM orders""",
    "fx_miss": """
        SELECT o_orderkey AS id,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS x,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS c,
               CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
               o_totalprice AS w,
               CASE WHEN o_orderkey % 10 < 7 THEN 'train' ELSE 'test' END AS split
        FROM orders""",
    "fx_label": """
        SELECT p_partkey AS id, p_brand AS label, p_type AS label2, p_retailprice AS y, p_size AS size,
               CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS yb,
               CASE WHEN p_partkey % 10 < 7 AND p_brand <> 'Brand#7' THEN 'train' ELSE 'test' END AS split
        FROM part""",
    "fx_num": """
        SELECT id, q, p, n, d, CASE WHEN p > 150000 THEN 1 ELSE 0 END AS y, p AS yr,
               CASE WHEN id % 10 < 7 THEN 'train' ELSE 'test' END AS split
        FROM (SELECT o_orderkey AS id, sum(l_quantity) AS q, sum(l_extendedprice) AS p,
                     CAST(count(*) AS DOUBLE) AS n, avg(l_discount) AS d
              FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey) per_order""",
    "fx_sel": """
        SELECT id, q, p, n, d, y, split, CAST(1 AS DOUBLE) AS const,
               CASE WHEN id % 1000 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS quasi,
               q AS dup_q, p * 2 + n AS corr_p
        FROM fx_num""",
    # means of an order's lines differ in their last digits from engine to engine; trees cut between distinct values
    "fx_tree": "SELECT id, q, n, round(d, 6) AS d, quasi, y, p AS yr, split FROM fx_sel",
    "fx_mixed": """
        SELECT c_custkey AS id,
               CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS STRING)
                    WHEN c_custkey % 3 = 1 THEN 'A/5 ' || CAST(c_custkey AS STRING) ELSE 'PC' END AS ticket,
               'C' || CAST(c_custkey % 50 AS STRING) AS cabin, c_name AS name, c_mktsegment AS segment
        FROM customer""",
    "fx_geo": """
        SELECT c_custkey AS id, CAST(13 AS DOUBLE) + CAST(c_custkey % 1000 AS DOUBLE) / 1000 AS lat,
               CAST(100 AS DOUBLE) + CAST(c_custkey % 777 AS DOUBLE) / 777 AS lon
        FROM customer""",
    "fx_poi": """
        SELECT r_name AS place, CAST(13 AS DOUBLE) + CAST(r_regionkey AS DOUBLE) / 5 AS latitude,
               CAST(101 AS DOUBLE) - CAST(r_regionkey AS DOUBLE) / 5 AS longitude
        FROM region""",
    "fx_series": """
        SELECT event_type AS series, date_trunc('day', ts) AS day, avg(value) AS v, CAST(count(*) AS DOUBLE) AS n
        FROM events GROUP BY event_type, date_trunc('day', ts)""",
    "fx_score": "SELECT id, d AS s, y FROM fx_num",
    "fx_even": "SELECT o_orderkey AS id, o_totalprice AS price, o_orderpriority AS priority FROM orders WHERE o_orderkey % 2 = 0",
    "fx_odd": "SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey % 2 = 1",
}

def rnd(c, digits: int = 4) -> Column:
    """Round for comparison. The small shift keeps exact decimal ties, which engines
    round differently, away from the rounding boundary."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(3e-4 * 10.0**-digits), digits)


def expand_rnd(sql: str) -> str:
    """RND(x) and RND<digits>(x) in a SQL twin become the form `rnd` uses."""
    while (m := re.search(r"\bRND(\d*)\(", sql)) is not None:
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        digits = int(m.group(1) or 4)
        inner = sql[m.end() : end - 1]
        sql = f"{sql[: m.start()]}(round(({inner}) + 3e-{digits + 4}, {digits}) + 0.0){sql[end:]}"
    return sql


def hash_sql(seed: int, *columns: str) -> str:
    """`ordered.hash_number` in DuckDB's words."""
    parts = ", ".join(f"CAST({c} AS VARCHAR)" for c in columns)
    return f"CAST('0x' || substr(md5(concat_ws(':', '{seed}', {parts})), 1, 13) AS BIGINT)"


def tree_sql(name: str, source: str, x: str, y: str, depth: int) -> str:
    """Common table expressions that grow a tree on one column; `<name>_leaves` has (position, hi, value, n)."""
    parts = [
        f"{name}_v AS (SELECT CAST({x} AS DOUBLE) AS x, count(*) AS n, CAST(sum({y}) AS DOUBLE) AS s FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1)",
        f"{name}_0 AS (SELECT CAST('-Infinity' AS DOUBLE) AS lo, CAST('Infinity' AS DOUBLE) AS hi)",
    ]
    for level in range(depth):
        parts += [
            f"""{name}_c{level} AS (
                SELECT lo, hi, x, sum(n) OVER w AS ln, sum(s) OVER w AS ls, sum(n) OVER p AS tn, sum(s) OVER p AS ts, lead(x) OVER (PARTITION BY lo ORDER BY x) AS nx
                FROM {name}_v JOIN {name}_{level} ON x > lo AND x <= hi WINDOW w AS (PARTITION BY lo ORDER BY x), p AS (PARTITION BY lo))""",
            f"""{name}_b{level} AS (
                SELECT lo, (x + nx) / 2 AS cut FROM {name}_c{level} WHERE nx IS NOT NULL AND ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) > ts * ts / tn + 1e-9
                QUALIFY row_number() OVER (PARTITION BY lo ORDER BY ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) DESC, x) = 1)""",
            f"""{name}_{level + 1} AS (
                SELECT n.lo, coalesce(cut, hi) AS hi FROM {name}_{level} n LEFT JOIN {name}_b{level} b ON n.lo = b.lo
                UNION ALL SELECT cut, hi FROM {name}_{level} n JOIN {name}_b{level} b ON n.lo = b.lo)""",
        ]
    parts.append(
        f"""{name}_leaves AS (SELECT row_number() OVER (ORDER BY hi) - 1 AS position, lo, hi, sum(s) / sum(n) AS value, CAST(sum(n) AS BIGINT) AS n
            FROM {name}_v JOIN {name}_{depth} ON x > lo AND x <= hi GROUP BY lo, hi)"""
    )
    return ", ".join(parts)


def auc_sql(score: str, src: str) -> str:
    """Rank form of the AUC over (score, y) rows."""
    return f"""SELECT sum(pos * (below + neg / 2.0)) / (sum(pos) * CAST(sum(neg) AS DOUBLE)) FROM (
        SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM (SELECT {score} AS s, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg FROM {src} GROUP BY 1) g) r"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def fixture(spark: SparkSession, folder: str, name: str, merge: bool = False) -> DataFrame:
    text = FIXTURES[name]
    used: dict[str, DataFrame] = {}

    def mark(match: re.Match) -> str:
        word = match.group(0)
        if word not in used:
            used[word] = fixture(spark, folder, word, merge) if word in FIXTURES else table(spark, folder, word)
            if merge and " JOIN " in text:
                # the few bytes of a key column pass for a small table: a broadcast of it holds all keys at the driver
                used[word] = used[word].hint("merge")
        return "{" + word + "}"

    names = "|".join([*BASE_TABLES, *FIXTURES])
    return spark.sql(re.sub(rf"(?<=FROM |JOIN )(?:{names})\b", mark, text), **used)


def with_fixtures(sql: str) -> str:
    """Put the fixture views a statement uses in front of it."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in FIXTURES:
            if re.search(rf"\b{name}\b", text) and name not in order:
                visit(FIXTURES[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    if not order:
        return sql
    views = ", ".join(f"{n} AS ({FIXTURES[n]})" for n in order)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {views}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {views}, {body[5:]}"
    return f"WITH {views} {body}"


def query(name: str, sql: str | None = None):
    """Register a query under its inventory id, with its SQL twin where SQL can say it."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_fixtures(expand_rnd(sql))
        return fn

    return keep
