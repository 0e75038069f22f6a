"""Local correctness check: run each registered query in Spark and its oracle in DuckDB.

Usage: python tests/oracle_check.py [sf_dir] [query ...]
Compares row count, column names and an order-insensitive multiset of rows.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from sitelens.sources.feeds import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, con, sf_dir, name, verbose=True):
    q = entry.queries()[name]
    sql = entry.oracle_sql().get(name)
    t0 = time.time()
    sdf = q(spark, sf_dir)
    cols = sdf.columns
    srows = [tuple(_norm(x) for x in r) for r in sdf.collect()]
    ts = time.time() - t0
    if sql is None:
        print(f"{name}: spark rows={len(srows)} (no oracle) {ts:.1f}s")
        return True
    t0 = time.time()
    res = con.execute(sql)
    ocols = [d[0] for d in res.description]
    orows = [tuple(_norm(x) for x in r) for r in res.fetchall()]
    to = time.time() - t0
    ok_cols = sorted(cols) == sorted(ocols)
    if ok_cols:
        idx = [ocols.index(c) for c in cols]
        orows = [tuple(r[i] for i in idx) for r in orows]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    ok = ok_cols and sorted(srows, key=key) == sorted(orows, key=key)
    print(f"{name}: {'OK' if ok else 'MISMATCH'} spark={len(srows)} oracle={len(orows)} "
          f"({ts:.1f}s / {to:.1f}s)")
    if not ok and verbose:
        if not ok_cols:
            print("  spark cols ", cols)
            print("  oracle cols", ocols)
        else:
            s_set, o_set = set(srows), set(orows)
            for r in sorted(s_set - o_set, key=key)[:5]:
                print("  spark only :", r)
            for r in sorted(o_set - s_set, key=key)[:5]:
                print("  oracle only:", r)
    return ok


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    from sitelens.session import get_spark
    spark = get_spark("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = [n for n in names if not compare(spark, con, sf_dir, n)]
    print("FAILED:", bad if bad else "none")


if __name__ == "__main__":
    main()
