"""Run registered queries in Spark and their oracle SQL in DuckDB, and compare.

Mirrors the driver's correctness gate: row count, column names, and an
order-insensitive comparison of values (columns sorted by name).

    python -m tests.oracle_compare --sf /root/testdata/sf0.01 [key ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if math.isinf(v):
            return v
        return round(v, int(os.environ.get("FLOWLAB_CMP_DIGITS", "5")))
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except (ValueError, AttributeError):
            pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare_one(spark, con, key, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    s_cols, s_vals = rows_of(sdf.columns, s_rows)
    if sql is None:
        return dict(key=key, ok=None, rows=len(s_rows), spark_s=round(t1 - t0, 2), note="no oracle")
    res = con.execute(sql)
    o_cols_raw = [d[0] for d in res.description]
    o_rows = res.fetchall()
    o_cols, o_vals = rows_of(o_cols_raw, o_rows)
    ok = s_cols == o_cols and s_vals == o_vals
    info = dict(key=key, ok=ok, rows=len(s_rows), oracle_rows=len(o_rows), spark_s=round(t1 - t0, 2))
    if not ok:
        info["spark_cols"], info["oracle_cols"] = s_cols, o_cols
        diff_s = [r for r in s_vals if r not in set(o_vals)][:3]
        diff_o = [r for r in o_vals if r not in set(s_vals)][:3]
        info["spark_only"], info["oracle_only"] = diff_s, diff_o
    return info


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args(argv)
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from flowlab.session import get_spark
    spark = get_spark(master="local[8]", shuffle_partitions=8)
    qs, sqls = entry.queries(), entry.oracle_sql()
    keys = args.keys or [k for k in qs if k in sqls]
    con = duck(args.sf)
    bad = 0
    for k in keys:
        try:
            info = compare_one(spark, con, k, qs[k], sqls.get(k), args.sf)
        except Exception as exc:  # report and continue
            info = dict(key=k, ok=False, error=f"{type(exc).__name__}: {str(exc)[:400]}")
        if info.get("ok") is False:
            bad += 1
        print(info, flush=True)
    print(f"{len(keys) - bad}/{len(keys)} ok", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
