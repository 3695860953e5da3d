"""Compare registered queries with their SQL on one scale's tables.

    python -m tests.oracle [sf] [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

ROOT = "/root/testdata"
NAMES = ("region nation customer supplier part orders lineitem events documents embeddings "
         "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, str)):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, datetime.date):
        return datetime.datetime(v.year, v.month, v.day)
    return tuple(v) if isinstance(v, list) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(entry, tables, con) -> str | None:
    """None when equal, else a short description."""
    df = entry.run(tables)
    got = rows_of(df.columns, df.collect())
    if entry.sql is None:
        return None if got else "no rows"
    rel = con.sql(entry.sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    if not want:
        return "expected result is empty"
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        only_a, only_b = sorted(a - b)[:3], sorted(b - a)[:3]
        clip = lambda xs: [x[:400] for x in xs]
        return f"{len(got)} vs {len(want)} rows; only spark {len(a - b)} {clip(only_a)}; only sql {len(b - a)} {clip(only_b)}"
    return None


def main(argv):
    from newsloom.catalog import REGISTRY, Tables
    from newsloom.session import local_session

    sf = argv[0] if argv else "sf0.001"
    wanted = argv[1:] or list(REGISTRY)
    wanted = [n for n in REGISTRY if any(n == w or (w.endswith("*") and n.startswith(w[:-1])) or
                                         REGISTRY[n].run.__module__.endswith("." + w) for w in wanted)]
    spark = local_session()
    con = connect(f"{ROOT}/{sf}")
    tables = Tables(spark, f"{ROOT}/{sf}")
    bad = 0
    for name in wanted:
        t = time.time()
        try:
            problem = differences(REGISTRY[name], tables, con)
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - t:.2f}s {problem or ''}", flush=True)
    print(f"{len(wanted) - bad}/{len(wanted)} equal")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
