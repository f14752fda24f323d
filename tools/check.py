"""Run registered queries against their check SQL in DuckDB and compare the rows.

    python tools/check.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from secflow.catalog import load  # noqa: E402
from secflow.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(norm(v) for v in value) + "]"
    return f"{type(value).__name__ if isinstance(value, bool) else ''}{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    queries, oracles = load()
    spark = build_session(f"local[{os.cpu_count()}]", 8, extra={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{args.sf}/{name}.parquet'")
    failed = 0
    for name, fn in queries.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            df = fn(spark, args.sf)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - start
            if name not in oracles:
                print(f"rows {name} {len(got)} rows {took:.1f}s", flush=True)
                continue
            start = time.time()
            cur = db.execute(oracles[name])
            cols = [d[0] for d in cur.description]
            want = rows_of(cols, cur.fetchall())
            sql_s = time.time() - start
            same = got == want and sorted(cols) == sorted(df.columns)
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name} {type(exc).__name__}: {str(exc)[:1500]}", flush=True)
            failed += 1
            continue
        print(f"{'ok  ' if same else 'FAIL'} {name} {len(got)} rows {took:.1f}s (sql {sql_s:.1f}s)", flush=True)
        if not same:
            failed += 1
            print("  columns", sorted(df.columns), sorted(cols))
            g, w = set(got), set(want)
            print("  spark only", len(g - w), sorted(g - w)[:3])
            print("  sql only  ", len(w - g), sorted(w - g)[:3])
    print("failed", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
