"""The streaming exfiltration detector equals its batch form on the same files."""

import tempfile

from pyspark.sql import functions as F

from flowlab.operators import filters as B
from flowlab.sources import load_flows
from flowlab.streaming import baseline_profile, flag_windows, live_exfiltration, windowed_host_rates
from tests.conftest import SF_SMALL

START = "2024-01-16 00:00:00"


def test_stream_matches_batch(spark):
    flows = load_flows(spark, SF_SMALL)
    d = tempfile.mkdtemp(prefix="flowlab-stream-")
    test = B.in_period(flows, "test").drop("period", "src_ip_num", "dst_ip_num")
    test.repartition(4).write.parquet(f"{d}/test")
    q = live_exfiltration(spark, f"{d}/test", flows, START, f"{d}/out", window="1 hour",
                          watermark="1 hour", available_now=True, checkpoint=f"{d}/ckpt")
    q.awaitTermination(300)
    got = {(r.window_start, r.src_ip) for r in spark.read.parquet(f"{d}/out").collect()}
    batch = flag_windows(windowed_host_rates(B.in_period(flows, "test"), START, "1 hour", "1 hour"),
                         baseline_profile(flows))
    expected = {(r.window_start, r.window_end, r.src_ip) for r in batch.collect()}
    # the final watermark is the latest event time minus the 1 hour delay; every
    # window ending at or before it is final and must have been emitted, exactly
    timed = F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.lit(START))) + F.col("timestamp") / 100)
    latest = B.in_period(flows, "test").agg(F.max(timed)).first()[0]
    import datetime
    watermark = latest - datetime.timedelta(hours=1)
    closed = {(s, src) for s, e, src in expected if e <= watermark}
    assert closed and closed <= got
    assert got <= {(s, src) for s, e, src in expected}


def _closed(expected, watermark):
    return {(s, src) for s, e, src in expected if e <= watermark}


def test_stream_c2_growth_and_fanout_match_batch(spark):
    import datetime

    from flowlab.streaming import (baseline_contact_rate, flag_contact_growth, live_c2_growth,
                                   live_fanout, windowed_fanout, windowed_internal_contacts)
    flows = load_flows(spark, "/root/testdata/sf0.01")
    d = tempfile.mkdtemp(prefix="flowlab-stream2-")
    test = B.in_period(flows, "test")
    test.drop("period", "src_ip_num", "dst_ip_num").repartition(4).write.parquet(f"{d}/test")
    timed = F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.lit(START))) + F.col("timestamp") / 100)
    watermark = test.agg(F.max(timed)).first()[0] - datetime.timedelta(hours=1)

    q1 = live_c2_growth(spark, f"{d}/test", flows, START, f"{d}/o1", window_seconds=3600,
                        watermark="1 hour", min_increase=100, min_baseline=10, available_now=True,
                        checkpoint=f"{d}/c1")
    q2 = live_fanout(spark, f"{d}/test", START, f"{d}/o2", min_fanout=4, window="1 day",
                     watermark="1 hour", available_now=True, checkpoint=f"{d}/c2")
    q1.awaitTermination(300)
    q2.awaitTermination(300)

    batch_c2 = flag_contact_growth(windowed_internal_contacts(test, START, "3600 seconds", "1 hour"),
                                   baseline_contact_rate(flows), 3600, 100, 10)
    exp_c2 = {(r.window_start, r.window_end, r.src_ip) for r in batch_c2.collect()}
    got_c2 = {(r.window_start, r.src_ip) for r in spark.read.parquet(f"{d}/o1").collect()}
    assert _closed(exp_c2, watermark) <= got_c2 <= {(s, src) for s, e, src in exp_c2}
    assert got_c2

    batch_fan = windowed_fanout(test, START, "1 day", "1 hour").where(F.col("n_peers") > 4)
    exp_fan = {(r.window_start, r.window_end, r.src_ip) for r in batch_fan.collect()}
    got_fan = {(r.window_start, r.src_ip) for r in spark.read.parquet(f"{d}/o2").collect()}
    assert _closed(exp_fan, watermark) <= got_fan <= {(s, src) for s, e, src in exp_fan}
    assert got_fan and {src for _, src in got_fan} <= {"192.168.109.4", "192.168.109.12", "192.168.109.18"}


def test_stream_to_parquet_files(spark):
    from flowlab.streaming import live_fanout
    flows = load_flows(spark, "/root/testdata/sf0.01")
    d = tempfile.mkdtemp(prefix="flowlab-stream3-")
    B.in_period(flows, "test").drop("period", "src_ip_num", "dst_ip_num").write.parquet(f"{d}/test")
    q = live_fanout(spark, f"{d}/test", START, f"{d}/out", min_fanout=4, window="1 day", watermark="1 hour",
                    available_now=True, checkpoint=f"{d}/ck")
    q.awaitTermination(300)
    rows = spark.read.parquet(f"{d}/out").collect()
    assert rows and {r.src_ip for r in rows} <= {"192.168.109.4", "192.168.109.12", "192.168.109.18"}


def test_live_blocklist_replays_change_nothing(spark):
    from flowlab.streaming import live_blocklist, live_exfiltration, live_fanout, merge_batch, read_blocklist
    flows = load_flows(spark, "/root/testdata/sf0.01")
    d = tempfile.mkdtemp(prefix="flowlab-stream4-")
    B.in_period(flows, "test").drop("period", "src_ip_num", "dst_ip_num").repartition(3).write.parquet(f"{d}/test")
    live_fanout(spark, f"{d}/test", START, f"{d}/fan", min_fanout=4, window="1 day", watermark="1 hour", available_now=True,
                checkpoint=f"{d}/c1").awaitTermination(300)
    live_exfiltration(spark, f"{d}/test", flows, START, f"{d}/exfil", window="1 day", watermark="1 hour", available_now=True,
                      checkpoint=f"{d}/c2").awaitTermination(300)
    # what is listed already stays
    merge_batch(spark.createDataFrame([("9.9.9.9", "by hand"), ("192.168.109.4", "by hand")], "ip string, reason string"), -1, f"{d}/list")
    live_blocklist(spark, {"fanout": f"{d}/fan", "exfiltration": f"{d}/exfil"}, f"{d}/list", checkpoint=f"{d}/c3",
                   available_now=True).awaitTermination(300)

    def rows():
        return {r.ip: r.reasons for r in read_blocklist(spark, f"{d}/list").collect()}

    want = {"9.9.9.9": ["by hand"], "192.168.109.4": ["by hand"]}
    for reason, folder in (("fanout", "fan"), ("exfiltration", "exfil")):
        for r in spark.read.parquet(f"{d}/{folder}").select("src_ip").distinct().collect():
            want[r.src_ip] = sorted({*want.get(r.src_ip, []), reason})
    assert rows() == want and len(want) > 4
    # a batch run again, even with part of it written before, gives the same list
    again = spark.createDataFrame([("1.2.3.4", "late"), ("1.2.3.4", "late"), (None, "late")], "ip string, reason string").where("ip is not null")
    for _ in range(3):
        merge_batch(again, 7, f"{d}/list")
        assert rows() == {**want, "1.2.3.4": ["late"]}
    merge_batch(again.limit(0), 8, f"{d}/list")
    assert rows() == {**want, "1.2.3.4": ["late"]}
    import os
    assert len([x for x in os.listdir(f"{d}/list") if x.startswith("batch=")]) == 2  # older lists are dropped
