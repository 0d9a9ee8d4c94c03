"""Run registered queries in Spark and their SQL in DuckDB, and compare rows.

    python tests/compare.py [--sf sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
DATA = Path("/root/testdata")


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.10g}") + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


# Plans that compare every row with every other.
ALL_PAIRS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def difference(query, spark, con, folder: str) -> str | None:
    df = query.build(spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    if any(name in plan for name in ALL_PAIRS):
        return "pairs all rows"
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if query.sql is None:
        return None if got[1] else "no rows"
    cursor = con.execute(query.sql)
    want = table([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        only = [r for r in got[1] if r not in set(want[1])][:3]
        missing = [r for r in want[1] if r not in set(got[1])][:3]
        return f"{len(got[1])} rows, expected {len(want[1])}; extra {only}; missing {missing}"
    kinds = [(type(a), type(b)) for g, w in zip(got[1], want[1]) for a, b in zip(g, w) if type(a) is not type(b)]
    return f"types differ {kinds[:2]}" if kinds else None


def main() -> int:
    from tidemark.queries import REGISTRY
    from tidemark.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = str(DATA / args.sf)
    spark, con = local_session(8), duck(folder)
    bad = 0
    for name, q in REGISTRY.items():
        if args.names and not any(n in name for n in args.names):
            continue
        started = time.time()
        try:
            problem = difference(q, spark, con, folder)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        rows = "" if q.sql else " (rows only)"
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - started:.1f}s{rows} {problem or ''}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(main())
