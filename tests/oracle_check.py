"""Compare registered queries with their SQL on DuckDB.

Usage: python tests/oracle_check.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return ("nan",) if math.isnan(v) else (float(v) + 0.0)
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    if sql is None:
        return len(got), "rows-only"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return len(got), f"COLUMNS {cols} vs {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = [tuple(norm(r[i]) for i in at) for r in rel.fetchall()]
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    got.sort(key=key)
    want.sort(key=key)
    if got == want:
        kinds = {c: (type(a).__name__, type(b).__name__) for g, w in zip(got[:50], want[:50])
                 for c, a, b in zip(cols, g, w) if type(a) is not type(b)}
        return len(got), "ok" + (f" TYPES {kinds}" if kinds else "")
    gs, ws = set(map(str, got)), set(map(str, want))
    only_g = [r for r in got if str(r) not in ws][:3]
    only_w = [r for r in want if str(r) not in gs][:3]
    return len(got), f"DIFF spark={len(got)} sql={len(want)} cols={cols}\n   spark {only_g}\n   sql   {only_w}"


def main(argv):
    from tallyforge.plans.registry import ORACLES, QUERIES, load_all
    from tallyforge.session import local_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    load_all()
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    bad = 0
    for name, fn in QUERIES.items():
        if len(argv) > 1 and not any(a in name for a in argv[1:]):
            continue
        t0 = time.time()
        try:
            n, verdict = compare(spark, con, name, fn, ORACLES.get(name), sf)
        except Exception as e:  # report and go on with the next query
            n, verdict = -1, f"ERROR {type(e).__name__}: {str(e)[:600]}"
        good = verdict.startswith("ok") or verdict == "rows-only"
        bad += not good
        print(f"{name}: rows={n} {time.time() - t0:.2f}s {verdict}", flush=True)
    print("FAILED", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
