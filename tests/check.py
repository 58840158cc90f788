"""Compare registered queries with their SQL in DuckDB: python tests/check.py [--sf DIR] [names...]."""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return db


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, int):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_df, db, sql) -> str | None:
    mine = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = db.execute(sql)
    theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} vs {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} vs {len(theirs[1])}"
    bad = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    if bad:
        from collections import Counter
        a, b = Counter(mine[1]), Counter(theirs[1])
        return f"{len(bad)} differ; {mine[0]}; only ours {list((a - b))[:4]}; only sql {list((b - a))[:4]}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from attestra.session import build_session
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark, db = build_session(master="local[8]"), connect(args.sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in args.names or queries:
        started = time.time()
        try:
            df = queries[name](spark, args.sf)
            if name in oracle:
                problem = compare(df, db, oracle[name])
                label = "ok  " if problem is None else "FAIL"
            else:
                problem, label = None, f"rows {len(df.collect())}"
        except Exception as exc:  # report and continue with the next query
            problem, label = f"{type(exc).__name__}: {str(exc)[:600]}", "ERR "
        failed += problem is not None
        print(f"{label} {name} {time.time() - started:.1f}s {problem or ''}", flush=True)
    print(f"{failed} problems")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
