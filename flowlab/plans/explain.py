"""Inspect the physical plans of registered queries.

    python -m flowlab.plans.explain --sf /root/testdata/sf0.01 detect_exfiltration geo_country
    python -m flowlab.plans.explain --sf /root/testdata/sf0.01 --summary > PLANS.md

``--summary`` prints one markdown row per query: shuffles, joins, windows,
scans with their pushed and partition filters and the number of columns read.
"""

from __future__ import annotations

import argparse
import os
import re
import sys


def plan_facts(plan: str) -> dict:
    scans = re.findall(r"FileScan parquet \[([^\]]*)\].*?PartitionFilters: \[([^\]]*)\], "
                       r"PushedFilters: \[([^\]]*)\]", plan)
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan)),
        "single": "SinglePartition" in plan,
        "joins": sorted(set(re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|"
                                        r"BroadcastNestedLoopJoin|CartesianProduct)", plan))),
        "window": "Window" in plan,
        "scans": len(scans),
        "cols": sorted({len(c.split(",")) for c, _, _ in scans}),
        "pruned": any("period" in p for _, p, _ in scans),
        "pushed": sorted({f for _, _, pf in scans for f in re.findall(r"(\w+)\(", pf) if f != "IsNotNull"}),
    }


def main(argv=None) -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--mode", default="formatted")
    ap.add_argument("--summary", action="store_true")
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args(argv)
    sys.path.insert(0, os.getcwd())
    from flowlab.plans.catalog import QUERIES
    from flowlab.session import get_spark
    spark = get_spark(app="flowlab-explain")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    keys = args.keys or list(QUERIES)
    if not args.summary:
        for key in keys:
            print(f"===== {key}")
            QUERIES[key](spark, args.sf).explain(args.mode)
        return
    print("| query | shuffles | joins | window | scans | cols read | period pruned | pushed filters |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- |")
    for key in keys:
        plan = QUERIES[key](spark, args.sf)._jdf.queryExecution().executedPlan().toString()
        f = plan_facts(plan)
        shuffles = f"{f['shuffles']}" + (" (1 to a single partition)" if f["single"] else "")
        print(f"| `{key}` | {shuffles} | {' '.join(f['joins']) or '-'} | {'yes' if f['window'] else '-'} "
              f"| {f['scans']} | {','.join(map(str, f['cols']))} | {'yes' if f['pruned'] else '-'} "
              f"| {' '.join(f['pushed']) or '-'} |")


if __name__ == "__main__":
    main()
