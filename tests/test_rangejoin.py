"""Range lookup by sweep (J6, J7) and flat range tables (A3, A4), against brute force."""

import ipaddress
import random
import tempfile

import pytest

from flowlab.functions.net import cidr_bounds
from flowlab.operators import aggregates as D
from flowlab.operators import detectors as R
from flowlab.operators import rangejoin as RJ
from flowlab.operators import setops as G
from flowlab.sources import (derived_range_files, fixture_geo_ranges, load_flows, ranges_from_cidrs, read_asn,
                             read_geo)
from tests.conftest import SF_SMALL
from tests.plan_text import executed, scans

CIDRS = [("20.0.0.0/8", "W8"), ("21.5.0.0/16", "N16"), ("21.6.7.0/24", "N24"),
         ("64.0.0.0/6", "WIDE"), ("100.200.0.0/15", "N15"), ("21.6.8.0/22", "N22")]
NESTED = [*((*cidr_bounds(c), v) for c, v in CIDRS),
          *((*cidr_bounds(c), v) for c, v in [("20.1.0.0/16", "in8"), ("20.1.2.0/24", "in16"), ("20.1.2.3/32", "one"), ("66.0.0.0/8", "inwide"),
                                              ("66.1.2.0/22", None), ("0.0.0.0/5", "low"), ("255.255.255.255/32", "last")]),
          (cidr_bounds("20.1.2.0/24")[0] + 5, cidr_bounds("20.1.2.0/24")[0] + 7, "odd"),       # unaligned, inside a /24
          (cidr_bounds("101.0.0.0/8")[0] + 3, cidr_bounds("103.0.0.0/8")[0] + 77777, "long"),  # over many blocks
          (cidr_bounds("102.3.0.0/16")[0] - 9, cidr_bounds("102.3.0.0/16")[0] + 9, "edge")]    # across a block edge


def brute(num, ranges):
    held = [(hi - lo, v) for lo, hi, v in ranges if lo <= num <= hi]
    return min(held, key=lambda x: x[0])[1] if held else None


def table(spark, ranges):
    return spark.createDataFrame(ranges, "lo bigint, hi bigint, cc string").repartition(3)


def addresses(ranges, n=400, seed=7):
    rnd = random.Random(seed)
    out = [0, 2 ** 32 - 1]
    for lo, hi, _ in ranges:
        out += [x for x in (lo - 1, lo, hi, hi + 1, (lo + hi) // 2) if 0 <= x < 2 ** 32]
    out += [rnd.randrange(2 ** 32) for _ in range(n)]
    out += [lo + rnd.randrange(hi - lo + 1) for lo, hi, _ in rnd.choices(ranges, k=n)]
    return [str(ipaddress.IPv4Address(x)) for x in out] + ["x.y", "", None, "01.2.3.4"]


@pytest.mark.parametrize("ranges", [[(*cidr_bounds(c), v) for c, v in CIDRS], NESTED])
def test_lookup_matches_brute_force(spark, ranges):
    asked = addresses(ranges)
    df = spark.createDataFrame([(i, a, "kept") for i, a in enumerate(asked)], "id int, ip string, cc string").repartition(4)
    out = RJ.range_lookup(df.drop("cc"), "ip", table(spark, ranges), "cc", "cc")
    got = {r.id: r.cc for r in out.collect()}
    want = {i: None if a in ("x.y", "", None, "01.2.3.4") else brute(int(ipaddress.IPv4Address(a)), ranges) for i, a in enumerate(asked)}
    assert got == want and out.count() == len(asked)
    # a column of the result's name is replaced
    again = RJ.range_lookup(df, "ip", table(spark, ranges), "cc", "cc")
    assert {r.id: r.cc for r in again.collect()} == want


def test_flat_table_is_disjoint_and_agrees(spark):
    flat = sorted((r.lo, r.hi, r.cc) for r in RJ.flatten(table(spark, NESTED), "cc").collect())
    assert all(a[1] < b[0] for a, b in zip(flat, flat[1:]))
    for ip in addresses(NESTED)[:-4]:
        num = int(ipaddress.IPv4Address(ip))
        assert brute(num, flat) == brute(num, NESTED)
    # no longer than need be: neighbours come from different ranges
    assert len(flat) == len({c for lo, hi, _ in NESTED for c in (lo, hi + 1)} - {2 ** 32}) - sum(
        1 for c in {c for lo, hi, _ in NESTED for c in (lo, hi + 1)} - {2 ** 32} if not any(lo <= c <= hi for lo, hi, _ in NESTED))
    assert RJ.flatten(table(spark, NESTED).limit(0), "cc").count() == 0


def test_equal_ranges_give_one_answer(spark):
    ranges = table(spark, [(10, 20, "B"), (10, 20, "A"), (10, 20, None)])
    df = spark.createDataFrame([("0.0.0.15",)], "ip string")
    assert [r.cc for r in RJ.range_lookup(df, "ip", ranges, "cc", "cc").collect()] == ["A"]


@pytest.mark.parametrize("bad", [
    [(10, 20, "A"), (15, 25, "B")],                        # cross
    [(10, 20, "A"), (20, 25, "B")],                        # share one address
    [(10, 5, "X")],                                        # inverted
    [(10, 9, "X")],
    [(0, 2 ** 32, "X")], [(-1, 5, "X")],                   # out of bounds
    [(0, 1 << 20, "A"), ((1 << 19) + 5, (1 << 20) + 5, "B")],  # cross, far from the lookups
])
def test_bad_ranges_stop_the_query(spark, bad):
    df = spark.createDataFrame([("0.0.0.15",)], "ip string")
    RJ.range_lookup(df, "ip", table(spark, bad), "cc", "cc")  # building it runs nothing
    with pytest.raises(Exception, match="range table"):
        RJ.range_lookup(df, "ip", table(spark, bad), "cc", "cc").collect()
    with pytest.raises(Exception, match="range table"):
        RJ.check_ranges(table(spark, bad))


def test_plan_has_no_hint_no_nested_loop_and_bounded_windows(spark):
    df = spark.createDataFrame([(1, "21.5.1.1")], "id int, ip string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = executed(RJ.range_lookup(df, "ip", ranges_from_cidrs(spark, CIDRS), "cc", "cc"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "BroadcastExchange" not in plan
    windows = [line for line in plan.split("\n") if " Window " in line]
    assert len(windows) == 2 and all("block#" in line for line in windows)


def test_range_tables_from_csv_and_parquet(spark, flows_of):
    d = tempfile.mkdtemp(prefix="flowlab-ranges-")
    with open(f"{d}/geo.csv", "w") as fh:
        fh.write("lo,hi,cc\n335544320,352321535,US\n352321536,369098751,\n369098752,369164287,\\N\n")
    geo = read_geo(spark, f"{d}/geo.csv", fmt="csv")
    spark.createDataFrame([(335544320, 352321535, "AS20 X")], "lo bigint, hi bigint, org string").write.parquet(f"{d}/asn")
    asn = read_asn(spark, f"{d}/asn")
    f = flows_of([dict(dst_ip="20.1.1.1"), dict(dst_ip="21.0.0.1"), dict(dst_ip="22.0.0.5"), dict(dst_ip="9.9.9.9"), dict(dst_ip="bad"),
                  dict(dst_ip="192.168.109.9"), dict(dst_ip=None)])
    want = {"20.1.1.1": "US", "21.0.0.1": "", "22.0.0.5": "", "9.9.9.9": "", "bad": "", "192.168.109.9": None, None: ""}
    # a range whose code is '' or null still reads as unknown external: ''
    assert {r.dst_ip: r.dst_cc for r in RJ.geo_country(f, geo).collect()} == want
    assert {r.dst_ip: r.dst_cc for r in RJ.country_edges(f, geo).collect()} == {k: v for k, v in want.items() if v is not None}
    org = {r.dst_ip: r.dst_org for r in RJ.geo_org(f, asn).collect()}
    assert org == {k: "AS20 X" if k == "20.1.1.1" else None for k in want}


def test_derived_range_files_hold_every_kind(spark):
    geo, asn = derived_range_files(spark, SF_SMALL)
    rows = [(r.lo, r.hi) for r in read_geo(spark, geo).collect()]
    widths = {hi - lo + 1 for lo, hi in rows}
    assert {1 << 24, 1 << 10, 1 << 8, 2, 1} <= widths and any(lo % 2 and hi - lo == 1 for lo, hi in rows)
    assert read_asn(spark, asn).count() == len(rows) and derived_range_files(spark, SF_SMALL) == (geo, asn)


def test_edges_give_what_flows_give(spark):
    flows, geo = load_flows(spark, SF_SMALL), fixture_geo_ranges(spark)
    per_flow = RJ.geo_country(flows, geo)
    edges = RJ.country_edges(flows, geo, measures=("up_bytes", "down_bytes"))
    for fn in (D.country_fanout, D.country_bytes, D.distinct_countries, D.country_count, G.new_countries, G.new_country_flows,
               G.new_country_source_ips, R.rule_many_countries, R.rule_country_transfer, R.many_countries_bytes, R.detect_new_countries):
        assert sorted(fn(edges).collect()) == sorted(fn(per_flow).collect()), fn.__name__
    assert sorted(D.distinct_countries(RJ.destination_countries(flows, geo)).collect()) == sorted(D.distinct_countries(per_flow).collect())


@pytest.mark.parametrize("key", ["country_fanout", "country_bytes", "new_countries", "new_country_flows", "country_frequency", "rule_many_countries",
                                 "rule_country_transfer", "many_countries_bytes", "detect_new_countries", "country_list_diff", "distinct_countries",
                                 "country_count", "distinct_orgs"])
def test_country_queries_scan_flows_once_and_prune_internal(spark, key):
    from flowlab.plans.catalog import QUERIES
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = executed(QUERIES[key](spark, SF_SMALL))
    assert scans(plan) == 1
    if key != "distinct_orgs":  # organisations of all destinations are asked for
        assert "Or(Or(IsNull(dst_ip_num),LessThan(dst_ip_num," in plan
    # what the sweep sees are distinct destinations
    assert "HashAggregate(keys=[num#" in plan
