"""Run any operator or detector on your own flow files.

    python -m flowlab.cli list
    python -m flowlab.cli run detect_exfiltration --baseline data.parquet --test test.parquet
    python -m flowlab.cli run rule_many_countries --baseline b.parquet --test t.parquet \\
        --geo geo_ranges.parquet --param threshold=5 --csv out/many_countries
    python -m flowlab.cli run detect_c2_growth --flows stored_flows/ --param include_new_hosts=True

Operators whose first argument is ``flows_cc`` get flows enriched with the
destination country (``--geo``); ``--net``/``--cidr`` set the internal
network. Results are shown (``--show``) or written as CSV (``--csv``).
"""

from __future__ import annotations

import argparse
import ast
import inspect

from .operators import aggregates, detectors, filters, joins, quantiles, rangejoin, setops, sorts, windows

MODULES = (detectors, aggregates, joins, windows, sorts, setops, filters, rangejoin)


def address_blocklist(flows, geo):
    """Every address that a detector names, with its reasons."""
    from .sources import blocklist
    return blocklist(detectors.address_detections(detectors.alerts(flows, geo)))


def describe(flows, cols=("up_bytes", "down_bytes")):
    """Count, mean, std, min, quartiles and max of columns."""
    return quantiles.describe(flows, cols)


def operators() -> dict:
    """Public DataFrame operators taking flows (or flows with countries) first."""
    found = {"address_blocklist": address_blocklist, "describe": describe}
    for mod in MODULES:
        for name, fn in inspect.getmembers(mod, inspect.isfunction):
            if name.startswith("_") or fn.__module__ != mod.__name__:
                continue
            params = list(inspect.signature(fn).parameters)
            if params and params[0] in ("flows", "flows_cc"):
                found.setdefault(name, fn)
    return found


def _value(text: str):
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="flowlab")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("operator")
    run.add_argument("--flows", help="stored flow dataset (partitioned by period)")
    run.add_argument("--baseline", help="baseline period file(s)")
    run.add_argument("--test", help="test period file(s)")
    run.add_argument("--geo", help="country ranges (lo, hi, cc), parquet or .csv")
    run.add_argument("--asn", help="organisation ranges (lo, hi, org), parquet or .csv")
    run.add_argument("--hosts", help="a table of hosts (candidates, servers), parquet or .csv with a header")
    run.add_argument("--net", help="internal prefix, e.g. 10.1.2.")
    run.add_argument("--cidr", help="internal block, e.g. 10.1.2.0/24")
    run.add_argument("--param", action="append", default=[], help="key=value keyword argument")
    run.add_argument("--show", type=int, default=50)
    run.add_argument("--csv", help="write the result here instead of showing it")
    args = ap.parse_args(argv)

    ops = operators()
    if args.cmd == "list":
        for name in sorted(ops):
            doc = (inspect.getdoc(ops[name]) or "").split("\n")[0]
            print(f"{name:32s} {doc}")
        return

    from .session import get_spark
    from .sources import read_asn, read_flows, read_geo, read_periods, write_csv

    fn = ops[args.operator]
    spark = get_spark(app=f"flowlab-{args.operator}")
    if args.flows:
        flows = read_flows(spark, args.flows)
    elif args.baseline and args.test:
        flows = read_periods(spark, args.baseline, args.test)
    else:
        raise SystemExit("give --flows, or --baseline and --test")

    def table(path, reader):
        return reader(spark, path, fmt="csv" if path.endswith(".csv") else "parquet")

    kwargs = dict(p.split("=", 1) for p in args.param)
    kwargs = {k: _value(v) for k, v in kwargs.items()}
    params = inspect.signature(fn).parameters
    for name, value in (("net_prefix", args.net), ("cidr", args.cidr)):
        if value and name in params:
            kwargs[name] = value
    if args.asn and "asn" in params:
        kwargs["asn"] = table(args.asn, read_asn)
    if args.hosts:
        reader = spark.read.option("header", True).csv if args.hosts.endswith(".csv") else spark.read.parquet
        hosts = reader(args.hosts)
        kwargs.update({name: hosts for name in ("candidates", "hosts", "servers") if name in params})
    if args.geo and "geo" in params:
        kwargs["geo"] = table(args.geo, read_geo)
    first = next(iter(params))
    if first == "flows_cc":
        if not args.geo:
            raise SystemExit(f"{args.operator} needs --geo")
        cc_kw = {"cidr": args.cidr} if args.cidr else {}
        flows = rangejoin.country_edges(flows, table(args.geo, read_geo), measures=("up_bytes", "down_bytes"), **cc_kw)
    result = fn(flows, **kwargs)
    if args.csv:
        write_csv(result, args.csv)
    else:
        result.show(args.show, truncate=False)


if __name__ == "__main__":
    main()
