"""Compare registered queries with their SQL twins in DuckDB.

usage: python -m tests.parity [sf folder] [name prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return ("dec", str(v))
    if isinstance(v, float):
        return None if math.isnan(v) else ("f", repr(v))
    if isinstance(v, datetime.datetime):
        return ("ts", v.replace(tzinfo=None).isoformat())
    if isinstance(v, datetime.date):
        return ("d", v.isoformat())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql) -> str:
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} != {len(theirs[1])}"
    bad = [(a, b) for a, b in zip(*[mine[1], theirs[1]]) if a != b]
    return "" if not bad else f"{len(bad)} of {len(mine[1])} rows differ, first {bad[0]}"


def main(argv: list[str]) -> int:
    from tabloom.session import local_session
    import __spark_entry__ as entry

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session(memory="16g")
    con = oracle(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if len(argv) > 1 and not any(name.startswith(p) for p in argv[1:]):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in sqls:
                note = compare(df, con, sqls[name])
            else:
                rows = df.collect()
                note = "" if rows else "no rows"
        except Exception as e:  # report and go on with the next query
            note = f"{type(e).__name__}: {str(e)[:600]}"
        failed += bool(note)
        mark = "FAIL" if note else ("ok  " if name in sqls else "rows")
        print(f"{mark} {name:32s} {time.time() - start:6.2f}s {note}", flush=True)
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
