import tempfile

from pyspark.sql import functions as F

from flowlab.schema import GEO_SCHEMA
from flowlab.sources import blocklist, detections, read_csv_result, read_periods, write_csv, write_flows
from flowlab.sources.flows import read_flows
from tests.conftest import make_flows


def test_read_periods_and_partitioned_layout(spark):
    d = tempfile.mkdtemp(prefix="flowlab-src-")
    base = make_flows(spark, [dict(flow_id=1, period="baseline"), dict(flow_id=2, period="baseline")])
    test = make_flows(spark, [dict(flow_id=3), dict(flow_id=4), dict(flow_id=5)])
    base.drop("period").write.parquet(f"{d}/base")
    test.drop("period").write.parquet(f"{d}/test")
    both = read_periods(spark, f"{d}/base", f"{d}/test")
    assert {r.period: r["count"] for r in both.groupBy("period").count().collect()} == {"baseline": 2, "test": 3}
    write_flows(both, f"{d}/part")
    stored = read_flows(spark, f"{d}/part")
    assert {"src_ip_num", "dst_ip_num"} <= set(stored.columns)  # parsed at ingest, kept on read
    plan = stored.where(F.col("period") == "test")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "period" in plan
    assert stored.where(F.col("period") == "test").count() == 3


def test_csv_roundtrip_keeps_empty_null_and_na(spark):
    d = tempfile.mkdtemp(prefix="flowlab-csv-")
    df = spark.createDataFrame([(1, 2, ""), (3, 4, None), (5, 6, "NA")], GEO_SCHEMA)
    write_csv(df, f"{d}/out")
    back = {r.lo: r.cc for r in read_csv_result(spark, f"{d}/out", GEO_SCHEMA).collect()}
    assert back == {1: "", 3: None, 5: "NA"}


def test_blocklist_merge_is_idempotent(spark, flows_of):
    a = spark.createDataFrame([("1.1.1.1",), ("2.2.2.2",)], "src_ip string")
    b = spark.createDataFrame([("1.1.1.1",)], "src_ip string")
    first = blocklist(detections(a, "exfiltration"), detections(b, "botnet"))
    again = blocklist(detections(a, "exfiltration"), existing=first)
    rows = {r.ip: r.reasons for r in again.collect()}
    assert rows == {"1.1.1.1": ["botnet", "exfiltration"], "2.2.2.2": ["exfiltration"]}


def test_flow_table_from_a_directory_source(spark):
    import os

    from flowlab.sources.store import flows_table
    d = tempfile.mkdtemp(prefix="flowlab-evdir-")
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ev.repartition(3).write.parquet(f"{d}/events.parquet")
    assert os.path.isdir(f"{d}/events.parquet")
    a = flows_table(spark, d)
    b = flows_table(spark, "/root/testdata/sf0.001")
    cols = ["flow_id", "period", "timestamp", "src_ip", "dst_ip", "proto", "port", "up_bytes", "down_bytes"]
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


def test_pandas_written_flow_files(spark):
    """Files as the reference's pandas scripts hold them: no flow_id, a row
    index (named or not), int64 ports."""
    import pandas as pd

    d = tempfile.mkdtemp(prefix="flowlab-pd-")
    pdf = pd.DataFrame({"timestamp": [500, 100, 900], "src_ip": ["192.168.109.1"] * 3,
                        "dst_ip": ["8.8.8.8", "192.168.109.224", "8.8.4.4"], "proto": ["udp", "tcp", "udp"],
                        "port": [53, 443, 53], "up_bytes": [10, 20, 30], "down_bytes": [40, 50, 60]},
                       index=[946563, 946564, 946565])
    pdf.to_parquet(f"{d}/with_index.parquet")                       # stored as __index_level_0__
    pdf.reset_index().to_parquet(f"{d}/index_col.parquet", index=False)   # stored as "index"
    pdf.reset_index(drop=True).to_parquet(f"{d}/no_index.parquet", index=False)
    for name, ids in (("with_index", [946563, 946564, 946565]), ("index_col", [946563, 946564, 946565])):
        got = read_flows(spark, f"{d}/{name}.parquet", "test").orderBy("flow_id").collect()
        assert [r.flow_id for r in got] == ids and [r.timestamp for r in got] == [500, 100, 900]
    got = read_flows(spark, f"{d}/no_index.parquet", "test").orderBy("flow_id").collect()
    assert [r.timestamp for r in got] == [500, 100, 900]  # file order kept
    assert got[0].port == 53 and got[0].period == "test"


def test_cli_runs_detectors_on_period_files(spark, capsys):
    from flowlab import cli
    from flowlab.sources import load_flows

    d = tempfile.mkdtemp(prefix="flowlab-cli-")
    flows = load_flows(spark, "/root/testdata/sf0.01")
    for p in ("baseline", "test"):
        flows.where(F.col("period") == p).drop("period", "src_ip_num", "dst_ip_num").toPandas() \
            .set_index("flow_id").to_parquet(f"{d}/{p}.parquet")
    spark.createDataFrame([(o << 24, ((o + 1) << 24) - 1, cc) for o, cc in ((20, "US"), (30, "CN"), (31, "RU"))],
                          "lo bigint, hi bigint, cc string").write.parquet(f"{d}/geo")
    cli.main(["run", "detect_exfiltration", "--baseline", f"{d}/baseline.parquet", "--test", f"{d}/test.parquet"])
    out = capsys.readouterr().out
    assert "192.168.109.6" in out and "192.168.109.15" in out and "192.168.109.8" in out
    cli.main(["run", "rule_country_transfer", "--baseline", f"{d}/baseline.parquet", "--test",
              f"{d}/test.parquet", "--geo", f"{d}/geo", "--param", "threshold=1000000",
              "--csv", f"{d}/transfer"])
    back = spark.read.option("header", True).csv(f"{d}/transfer").collect()
    assert [(r.src_ip, r.up_bytes) for r in back] == [("192.168.109.15", "2559700")]
    from flowlab.sources.store import flows_table_path
    cli.main(["run", "detect_c2_growth", "--flows", flows_table_path(spark, "/root/testdata/sf0.01")])
    assert "192.168.109.8" in capsys.readouterr().out


def test_file_order_does_not_depend_on_splits(spark):
    """Several files without ids: numbered through in order of files and rows,
    whatever the scan's splits, and also when they change after the query is built."""
    import pandas as pd

    d = tempfile.mkdtemp(prefix="flowlab-order-")
    n = 0
    for i, size in enumerate((700, 1, 0, 1300, 250)):
        rows = pd.DataFrame({"timestamp": range(n, n + size), "src_ip": "192.168.109.1", "dst_ip": "8.8.8.8", "proto": "udp", "port": 53,
                             "up_bytes": 1, "down_bytes": 2})
        rows = rows.astype({c: "int64" for c in ("timestamp", "port", "up_bytes", "down_bytes")})
        for c in ("src_ip", "dst_ip", "proto"):
            rows[c] = rows[c].astype("string")
        rows.to_parquet(f"{d}/part-{i}.parquet", row_group_size=100)
        n += size
    df = read_flows(spark, d, "test")
    for parts, cost in (("1", str(4 << 20)), ("16", "1"), ("64", "1"), ("3", "1000")):
        spark.conf.set("spark.sql.files.minPartitionNum", parts)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
        try:
            for frame in (df, read_flows(spark, d, "test")):
                got = frame.select("flow_id", "timestamp").collect()
                assert sorted(r.flow_id for r in got) == list(range(n)) and all(r.flow_id == r.timestamp for r in got)
        finally:
            spark.conf.unset("spark.sql.files.minPartitionNum")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    # a partitioned dataset is numbered within each period
    df.withColumn("period", F.when(F.col("flow_id") % 2 == 0, "baseline").otherwise("test")).coalesce(1).sortWithinPartitions("period", "flow_id").drop("flow_id") \
        .write.partitionBy("period").parquet(f"{d}-parts")
    both = read_flows(spark, f"{d}-parts").collect()
    for p in ("baseline", "test"):
        mine = sorted((r.flow_id, r.timestamp) for r in both if r.period == p)
        assert [i for i, _ in mine] == list(range(len(mine))) and [t for _, t in mine] == sorted(t for _, t in mine)


def test_ptr_cache_hits_misses_and_known_absences(spark):
    from flowlab.operators import joins as J
    from flowlab.sources import read_dns_cache
    d = tempfile.mkdtemp(prefix="flowlab-ptr-")
    with open(f"{d}/cache.csv", "w") as fh:
        fh.write("ptr_name,host\n4.3.2.1.in-addr.arpa,b.example\n4.3.2.1.in-addr.arpa,a.example\n5.3.2.1.in-addr.arpa,\\N\n9.9.9.9.in-addr.arpa,unasked\n")
    cache = read_dns_cache(spark, f"{d}/cache.csv", fmt="csv")
    ips = spark.createDataFrame([("1.2.3.4",), ("1.2.3.5",), ("1.2.3.6",), ("1.2.3.6",), (None,)], "ip string")
    assert {r.ip: r.host for r in J.reverse_dns(ips, cache).collect()} == {"1.2.3.4": "a.example", "1.2.3.5": None, "1.2.3.6": None}
    assert [tuple(r) for r in J.dns_misses(ips, cache).collect()] == [("1.2.3.6", "6.3.2.1.in-addr.arpa")]
    assert J.dns_misses(ips, cache.limit(0)).count() == 3 and J.reverse_dns(ips.limit(0), cache).count() == 0


def test_cli_takes_hosts_and_ranges(spark, capsys):
    from flowlab import cli
    from flowlab.sources.store import flows_table_path
    d = tempfile.mkdtemp(prefix="flowlab-cli2-")
    stored = flows_table_path(spark, "/root/testdata/sf0.001")
    spark.createDataFrame([("192.168.109.6",)], "src_ip string").write.parquet(f"{d}/hosts")
    spark.createDataFrame([(20 << 24, (21 << 24) - 1, "ORG")], "lo bigint, hi bigint, org string").write.parquet(f"{d}/asn")
    spark.createDataFrame([(20 << 24, (21 << 24) - 1, "US")], "lo bigint, hi bigint, cc string").write.parquet(f"{d}/geo")
    cli.main(["run", "candidate_bytes", "--flows", stored, "--hosts", f"{d}/hosts"])
    out = capsys.readouterr().out
    assert "192.168.109.6" in out and "192.168.109.7" not in out
    cli.main(["run", "flows_to_known_hosts", "--flows", stored, "--hosts", f"{d}/hosts", "--param", "host_col='src_ip'", "--param", "by=()"])
    capsys.readouterr()
    cli.main(["run", "geo_org", "--flows", stored, "--asn", f"{d}/asn", "--show", "2000"])
    assert "ORG" in capsys.readouterr().out
    cli.main(["run", "describe", "--flows", stored, "--param", "cols=['up_bytes']"])
    assert "50%" in capsys.readouterr().out
    cli.main(["run", "address_blocklist", "--flows", stored, "--geo", f"{d}/geo"])
    assert "exfiltration" in capsys.readouterr().out
    cli.main(["list"])
    listed = capsys.readouterr().out
    assert all(name in listed for name in ("geo_org", "describe", "address_blocklist", "candidate_bytes"))
