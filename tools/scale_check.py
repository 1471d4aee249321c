"""Scaling and skew check on a flow table derived from a scale factor.

    python tools/scale_check.py --sf /root/testdata/sf0.1 --copies 20 --hot-copies 200

Replicates the scale factor's flows ``copies`` times (fresh flow ids) and the
flows of one host ``hot-copies`` times more, so that host holds well over a
third of all rows; stores the result as a flow table in the checkpoint
folder; times the skew-sensitive operators; and checks a few of them against
DuckDB on the same Parquet files. Prints one JSON object.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("--copies", type=int, default=20)
    ap.add_argument("--hot-copies", type=int, default=200)
    ap.add_argument("--hot", default="192.168.109.9")
    args = ap.parse_args()

    import duckdb
    from pyspark.sql import functions as F

    from flowlab.operators import detectors as R
    from flowlab.operators import joins as J
    from flowlab.operators import quantiles as Q
    from flowlab.operators import rangejoin as RJ
    from flowlab.operators import windows as E
    from flowlab.session import ensure_checkpoint_dir, get_spark
    from flowlab.sources import fixture_geo_ranges, load_flows
    from flowlab.sources.flows import write_flows
    from flowlab.sources.store import read_flow_table

    spark = get_spark(app="flowlab-scale", master="local[8]", shuffle_partitions=32,
                      extra={"spark.driver.memory": "16g"})
    base = load_flows(spark, args.sf)
    n_base = base.count()
    span = n_base * (args.copies + args.hot_copies)

    def replicate(df, k, offset):
        r = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_r")
        out = df.select("*", r)
        return out.withColumn("flow_id", F.col("flow_id") + (F.col("_r").cast("bigint") + offset) * span).drop("_r")

    big = replicate(base, args.copies, 0).unionByName(
        replicate(base.where(F.col("src_ip") == args.hot), args.hot_copies, args.copies))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/flowlab-scale/flows-{uuid.uuid4().hex[:8]}"
    t = time.perf_counter()
    write_flows(big.repartition(32), path)
    timings = {"write": time.perf_counter() - t}
    flows = read_flow_table(spark, path)
    total = flows.count()
    hot_rows = flows.where(F.col("src_ip") == args.hot).count()
    geo = fixture_geo_ranges(spark)

    def run(name, fn):
        t0 = time.perf_counter()
        out = fn()
        timings[name] = round(time.perf_counter() - t0, 2)
        return out

    gaps = run("flow_gap", lambda: flows.transform(E.flow_gap)
               .agg(F.count(F.lit(1)).alias("n"), F.sum("gap").alias("s")).first())
    avg_gap = run("avg_flow_gap", lambda: {(r.period, r.src_ip): r.avg_gap for r in E.avg_flow_gap(flows).collect()})
    quart = run("exact_quartiles", lambda: Q.exact_quantiles(flows, "up_bytes", (0.25, 0.5, 0.75)))
    run("host_profile", lambda: R.D.host_profile(flows).collect())
    run("host_activity", lambda: J.host_activity(flows).collect())
    exfil = run("detect_exfiltration", lambda: sorted(r.src_ip for r in R.detect_exfiltration(flows).collect()))
    run("geo_per_flow", lambda: RJ.geo_country(flows, geo).groupBy("dst_cc").count().collect())
    run("geo_per_edge", lambda: RJ.country_edges(flows, geo, measures=("up_bytes",)).groupBy("dst_cc").sum("flow_count").collect())
    run("alerts", lambda: R.alerts(flows, geo).collect())

    con = duckdb.connect()
    con.execute(f"CREATE VIEW f AS SELECT * FROM read_parquet('{path}/*/*.parquet', hive_partitioning=true)")
    d_gap = con.execute("""SELECT count(*), sum(g) FROM (SELECT coalesce(timestamp - lag(timestamp) OVER
                           (PARTITION BY period, src_ip ORDER BY flow_id), 0) AS g FROM f)""").fetchone()
    d_avg = {(p, s): g for p, s, g in con.execute(
        """SELECT period, src_ip, avg(g) FROM (SELECT period, src_ip, coalesce(timestamp - lag(timestamp)
           OVER (PARTITION BY period, src_ip ORDER BY flow_id), 0) AS g FROM f) GROUP BY ALL""").fetchall()}
    d_q = con.execute("SELECT quantile_cont(up_bytes, [0.25, 0.5, 0.75]) FROM f").fetchone()[0]
    checks = {
        "flow_gap": (gaps.n, gaps.s) == tuple(d_gap),
        "avg_flow_gap": all(abs(avg_gap[k] - d_avg[k]) < 1e-6 for k in d_avg) and avg_gap.keys() == d_avg.keys(),
        "exact_quartiles": all(abs(quart[p] - v) < 1e-6 for p, v in zip((0.25, 0.5, 0.75), d_q)),
        "exfiltration_hosts": exfil,
    }
    print(json.dumps({"rows": total, "hot_host_rows": hot_rows, "hot_share": round(hot_rows / total, 3),
                      "seconds": {k: round(v, 2) for k, v in timings.items()}, "checks": checks}))


if __name__ == "__main__":
    main()
