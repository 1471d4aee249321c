import ipaddress

import pytest

from flowlab.functions import arith, net, timeparts

ADDRS = ["10.1.1.1", "100.64.0.1", "192.0.0.9", "192.0.0.10", "192.0.0.11", "203.0.113.1",
         "12.168.109.227", "192.168.109.227", "8.8.8.8", "224.0.0.1", "255.255.255.255",
         "127.0.0.1", "172.31.255.255", "172.32.0.1", "198.19.0.1", "192.0.0.170", "192.0.0.172"]


def test_ip_to_num_and_malformed(spark):
    df = spark.createDataFrame([(a,) for a in ADDRS + ["x.y", "1.2.3", "1.2.3.256", "01.2.3.4", "1.2.3.4.5", " 1.2.3.4", "", None]], "ip string")
    rows = df.select("ip", net.ip_to_num("ip").alias("n")).collect()
    for r in rows:
        if r.ip in ADDRS:
            assert r.n == int(ipaddress.IPv4Address(r.ip))
        else:
            assert r.n is None  # Q12: malformed -> null, never an error


def test_is_private_matches_cpython(spark):
    df = spark.createDataFrame([(a,) for a in ADDRS], "ip string")
    got = {r.ip: r.p for r in df.select("ip", net.is_private("ip").alias("p")).collect()}
    for a in ADDRS:
        assert got[a] == ipaddress.IPv4Address(a).is_private, a


def test_internal_predicates(spark):
    df = spark.createDataFrame([("192.168.109.5",), ("12.168.109.227",), ("x.y",), ("10.0.0.1",)], "ip string")
    rows = {r.ip: r for r in df.select(
        "ip", net.in_cidr("ip").alias("n1"), net.in_prefix("ip").alias("n2"),
        net.startswith_any("ip").alias("n3"), net.is_public("ip").alias("pub")).collect()}
    assert rows["192.168.109.5"].n1 and rows["192.168.109.5"].n2 and not rows["192.168.109.5"].pub
    assert not rows["12.168.109.227"].n1 and not rows["12.168.109.227"].n2 and rows["12.168.109.227"].pub
    assert rows["x.y"].n1 is None and rows["x.y"].n2 is False and rows["x.y"].pub  # Q12
    assert rows["10.0.0.1"].n3 and not rows["10.0.0.1"].n2


def test_ptr_name(spark):
    df = spark.createDataFrame([("193.136.172.20",)], "ip string")
    assert df.select(net.ptr_name("ip")).first()[0] == "20.172.136.193.in-addr.arpa"


def test_time_parts(spark):
    # Q8: 8,764,200 ticks = 87,642 s: unwrapped 24:20:42, wrapped hour 00
    df = spark.createDataFrame([(8764200,), (12345,), (36000000,)], "ts bigint")
    rows = df.select(timeparts.ts_to_hours("ts").alias("h1"), timeparts.hour_of_day("ts").alias("h2"),
                     timeparts.minute_of_day("ts").alias("h3"), timeparts.ts_seconds("ts").alias("h4")).collect()
    assert tuple(rows[0]) == ("24:20:42", "00", "00:20", 87642)
    assert tuple(rows[1]) == ("00:02:03", "00", "00:02", 123)
    assert rows[2].h1 == "100:00:00"  # three-digit hours are not truncated


def test_safe_ratio_and_increase(spark):
    # x/0 = inf, 0/0 = null (pandas NaN), never an ANSI error
    df = spark.createDataFrame([(10, 0), (0, 0), (5, 10), (-3, 0)], "a bigint, b bigint")
    rows = df.select(arith.safe_ratio("a", "b").alias("r"), arith.pct_increase("b", "a").alias("inc")).collect()
    assert rows[0].r == float("inf") and rows[1].r is None and rows[2].r == 0.5 and rows[3].r == float("-inf")
    assert rows[1].inc is None  # 0 -> 0: NaN in pandas
    nan_cmp = df.select((arith.safe_ratio("a", "b") > 1).alias("c")).collect()
    assert nan_cmp[1].c is None  # null compares as unknown, filters drop it like pandas NaN > x


@pytest.mark.parametrize("cidr,lo,hi", [("192.168.109.0/24", 3232263424, 3232263679),
                                        ("10.0.0.0/8", 167772160, 184549375)])
def test_cidr_bounds(cidr, lo, hi):
    assert net.cidr_bounds(cidr) == (lo, hi)
