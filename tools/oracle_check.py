"""Run registered queries in Spark and their SQL oracles in DuckDB, compare results.

Usage: python tools/oracle_check.py [--sf /root/testdata/sf0.01] [key ...]
Prints one line per key and exits non-zero when any key mismatches.
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from flowsieve.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [tuple(_norm(r[i]) for i in order) for r in rows], sorted(columns)


def duck(sf_dir: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    return cols, res.fetchall()


def compare(spark, sf_dir: str, key: str, fn, sql: str | None):
    t0 = time.time()
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return "rows-only", len(s_rows), None, t1 - t0
    d_cols, d_rows = duck(sf_dir, sql)
    a, ac = rows_of(s_cols, s_rows)
    b, bc = rows_of(d_cols, d_rows)
    if ac != bc:
        return f"COLUMNS spark={ac} duck={bc}", len(s_rows), len(d_rows), t1 - t0
    if len(a) != len(b):
        return "ROWCOUNT", len(s_rows), len(d_rows), t1 - t0
    ca, cb = Counter(a), Counter(b)
    if ca != cb:
        only_a = list((ca - cb).elements())[:3]
        only_b = list((cb - ca).elements())[:3]
        return f"VALUES spark-only={only_a} duck-only={only_b}", len(a), len(b), t1 - t0
    return "ok", len(a), len(b), t1 - t0


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args()
    from flowsieve.plans import catalog
    from flowsieve.session import build_session
    spark = build_session()
    keys = args.keys or list(catalog.QUERIES)
    bad = 0
    for k in keys:
        try:
            status, n1, n2, sec = compare(spark, args.sf, k, catalog.QUERIES[k], catalog.ORACLES.get(k))
        except Exception as e:  # report and continue with the next key
            status, n1, n2, sec = f"ERROR {type(e).__name__}: {str(e)[:400]}", None, None, 0
        if status not in ("ok", "rows-only"):
            bad += 1
        print(f"{k:34s} {status[:600]} spark={n1} duck={n2} {sec:.1f}s", flush=True)
    spark.stop()
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
