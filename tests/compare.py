"""Run registered queries against their SQL: ``python tests/compare.py [sf] [name-part ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from caderneta.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return f"{v:.6g}" if abs(v) < 1e-3 else f"{round(v, 6):.10g}"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def check(spark, con, sf_dir, name, plan, sql):
    start = time.time()
    df = plan(spark, sf_dir)
    cols = sorted(df.columns)
    rows = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    took = time.time() - start
    if sql is None:
        return True, f"rows-only {sum(rows.values())} rows", took
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return False, f"columns {cols} != {sorted(names)}", took
    idx = [names.index(c) for c in cols]
    want = Counter(tuple(norm(r[i]) for i in idx) for r in res.fetchall())
    types = dict(df.dtypes)
    if rows == want:
        return True, f"{sum(rows.values())} rows {types}", took
    return False, (
        f"spark {sum(rows.values())} sql {sum(want.values())}\n   cols {cols}\n   only spark "
        f"{list((rows - want).items())[:3]}\n   only sql {list((want - rows).items())[:3]}"
    ), took


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql = E.oracle_sql()
    bad = []
    for name, plan in E.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, note, took = check(spark, con, sf_dir, name, plan, sql.get(name))
        except Exception as exc:  # noqa: BLE001
            ok, note, took = False, f"{type(exc).__name__}: {str(exc)[:1500]}", 0.0
        print(f"{'ok  ' if ok else 'FAIL'} {name} {took:.1f}s {note}", flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)
    return len(bad)


if __name__ == "__main__":
    sys.exit(main())
