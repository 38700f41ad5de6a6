"""Run registered queries on both engines and report differences and times.

usage: python tools/check_oracles.py [--sf 0.01] [name-substring ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v, digits=None):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "isoformat"):
        return str(v).replace("+00:00", "")
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if digits is not None:
            v = round(v, digits)
        return repr(v + 0.0)
    return str(v)


def rows(cols, data, digits=None):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i], digits) for i in order) for r in data)


def compare(df, con, sql):
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(cols)}"
    if len(got) != len(want):
        return f"ROWS {len(got)} vs {len(want)}"
    a, b = rows(df.columns, got), rows(cols, want)
    if a == b:
        dt = {c: t for c, t in df.dtypes}
        bad = []
        for d in cur.description:
            t = str(d[1]).upper()
            s = dt[d[0]]
            fam = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
            if s in fam and fam[s] != t:
                bad.append((d[0], s, t))
            if s in ("bigint", "int", "boolean") and any(r[df.columns.index(d[0])] is None for r in got):
                bad.append((d[0], "nullable", s))
        return f"ok n={len(a)}" + (f" TYPES {bad}" if bad else "")
    a2, b2 = rows(df.columns, got, 6), rows(cols, want, 6)
    if a2 == b2:
        return f"approx n={len(a)}"
    diff = [(x, y) for x, y in zip(a2, b2) if x != y]
    return f"VALUES {len(diff)} of {len(a)}; first:\n   spark {diff[0][0]}\n   duck  {diff[0][1]}"


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from lumenlog.catalog import load
    from lumenlog.session import build_session

    queries, oracles = load()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    con = connect(sf_dir)
    bad = 0
    for name, fn in queries.items():
        if args.names and not any(n in name for n in args.names):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                msg = compare(df, con, oracles[name])
            else:
                msg = f"rows-only n={df.count()}"
        except Exception as e:  # noqa: BLE001
            msg = f"ERROR {type(e).__name__} {str(e)[:600]}"
        if not msg.startswith(("ok", "rows-only", "approx")) or msg.endswith("n=0") or "TYPES" in msg:
            bad += not msg.startswith(("ok", "rows-only", "approx"))
            msg = "!! " + msg
        print(f"{name:36s} {time.time() - t0:6.2f}s {msg}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
