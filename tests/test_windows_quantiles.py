import random

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlab.operators import quantiles as Q
from flowlab.operators import windows as E
from tests.conftest import make_flows


def _random_flows(spark, n=3000, seed=3):
    rnd = random.Random(seed)
    ids = list(range(n))
    rnd.shuffle(ids)
    rows = [dict(flow_id=i, src_ip=f"h{rnd.randrange(6)}", timestamp=rnd.randrange(10_000)) for i in ids]
    # one hot host holding a third of the flows
    rows += [dict(flow_id=n + i, src_ip="hot", timestamp=rnd.randrange(10_000)) for i in range(n // 2)]
    return make_flows(spark, rows)


def test_bucketed_gap_equals_plain_window(spark):
    f = _random_flows(spark)
    w = Window.partitionBy("src_ip").orderBy("flow_id")
    plain = {r.flow_id: r.gap for r in f.select(
        "flow_id", F.coalesce(F.col("timestamp") - F.lag("timestamp").over(w), F.lit(0)).alias("gap")).collect()}
    for bucket in (7, 64, 1 << 20):
        got = {r.flow_id: r.gap for r in E.flow_gap(f, bucket_size=bucket).collect()}
        assert got == plain


def test_telescoped_avg_gap_equals_window_avg(spark):
    f = _random_flows(spark)
    a = {r.src_ip: r.avg_gap for r in E.avg_flow_gap(f).collect()}
    b = {r.src_ip: r.avg_gap for r in E.avg_flow_gap_window(f).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert abs(a[k] - b[k]) < 1e-9


def test_avg_gap_needs_no_window(spark):
    plan = E.avg_flow_gap(_random_flows(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_exact_quantiles_match_pandas(spark):
    rnd = random.Random(11)
    vals = [rnd.choice([5, 5, 5, 17, 40]) if i % 3 else rnd.randrange(1000) for i in range(2001)]
    df = spark.createDataFrame([(v,) for v in vals], "v bigint")
    got = Q.exact_quantiles(df, "v", (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0))
    s = pd.Series(vals)
    for p, v in got.items():
        assert abs(v - s.quantile(p)) < 1e-9, p


def test_describe_matches_pandas(spark, flows_of):
    rnd = random.Random(5)
    rows = [dict(up_bytes=rnd.randrange(50), down_bytes=rnd.randrange(7)) for _ in range(101)]
    f = flows_of(rows)
    got = {r.stat: (r.up_bytes, r.down_bytes) for r in Q.describe(f, ["up_bytes", "down_bytes"]).collect()}
    pdf = pd.DataFrame(rows)[["up_bytes", "down_bytes"]].describe()
    for stat in pdf.index:
        for j, c in enumerate(("up_bytes", "down_bytes")):
            assert abs(got[stat][j] - pdf.loc[stat, c]) < 1e-9


def test_quantiles_are_exact_beyond_53_bits(spark):
    rnd = random.Random(8)
    for vals in ([2 ** 60 + i for i in range(101)], [-2 ** 63, 2 ** 63 - 1, 0, -1, 1], [7], [5] * 9, [-3, -3, 2 ** 40, 2 ** 40 + 1],
                 [rnd.randrange(-2 ** 63, 2 ** 63) for _ in range(500)], [rnd.randrange(300) for _ in range(500)]):
        df = spark.createDataFrame([(v,) for v in [*vals, None]], "v bigint").repartition(5)
        probs = (0.0, 0.25, 0.37, 0.5, 0.75, 1.0)
        ordered, n = sorted(vals), len(vals)
        got = {r.p: (r.lower, r.upper) for r in Q.order_statistics(df, ["v"], probs).collect()}
        assert got == {p: (ordered[int(p * (n - 1))], ordered[min(int(p * (n - 1)) + 1, n - 1)]) for p in probs}


def test_quantiles_of_fractions_and_gaps(spark):
    rnd = random.Random(9)
    vals = [rnd.gauss(0, 1e9) for _ in range(301)] + [0.0, -0.0, 1e-300, -1e-300, None, float("nan"), 5e-324, 1.5, 1.5, 1e100]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(vals)], "v double, i int").repartition(3)
    s = pd.Series([v for v in vals if v is not None]).dropna()
    probs = (0.0, 0.01, 0.25, 0.5, 0.505, 0.75, 0.99, 1.0)
    for p, v in Q.exact_quantiles(df, "v", probs).items():
        assert abs(v - s.quantile(p)) <= 1e-9 * max(1.0, abs(v)), p
    both = {(r.series, r.p): r.value for r in Q.order_statistics(df, ["v", "i"], (0.5,)).collect()}
    assert both[("i", 0.5)] == (len(vals) - 1) / 2 and abs(both[("v", 0.5)] - s.quantile(0.5)) < 1e-6
    got = {r.stat: r.v for r in Q.describe(df, ["v"]).collect()}
    for stat, want in s.describe().items():
        assert abs(got[stat] - want) <= 1e-9 * max(1.0, abs(want)) or got[stat] == want, stat
    assert Q.exact_quantiles(df.limit(0), "v", (0.5,)) == {0.5: None}


def test_gap_exchanges_flows_once(spark):
    p = E.flow_gap(_random_flows(spark), bucket_size=64)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in p
    # the flows themselves, and summaries that are aggregated before they are shuffled
    rows = [x for x in p.split("\n") if "Exchange hashpartitioning(period" in x]
    partial = p.count("partial_max_by")
    assert len(rows) == 3 and partial == 1


def test_bucketed_gap_in_time_order_equals_plain_window(spark):
    f = _random_flows(spark)
    w = Window.partitionBy("src_ip").orderBy("timestamp", "flow_id")
    plain = {r.flow_id: r.gap for r in f.select(
        "flow_id", F.coalesce(F.col("timestamp") - F.lag("timestamp").over(w), F.lit(0)).alias("gap")).collect()}
    for bucket in (3, 100, None):
        got = {r.flow_id: r.gap for r in E.flow_gap(f, order_by="timestamp", bucket_size=bucket).collect()}
        assert got == plain


def test_quantiles_do_not_rely_on_exchange_reuse(spark):
    df = spark.range(120_000).select((F.xxhash64("id") % 50_000).alias("v"))
    expected = df.agg(F.expr("percentile(v, array(0.25, 0.5, 0.75))")).first()[0]
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        for _ in range(3):
            assert list(Q.exact_quantiles(df, "v", (0.25, 0.5, 0.75)).values()) == expected
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_gaps_stay_within_a_period(flows_of):
    f = flows_of([dict(flow_id=0, period=p, timestamp=t) for p, t in (("baseline", 900), ("test", 5))]
                 + [dict(flow_id=1, period=p, timestamp=t) for p, t in (("baseline", 950), ("test", 7))])
    assert {(r.period, r.flow_id): r.gap for r in E.flow_gap(f).collect()} == {
        ("baseline", 0): 0, ("baseline", 1): 50, ("test", 0): 0, ("test", 1): 2}
    assert {r.period: r.avg_gap for r in E.avg_flow_gap(f).collect()} == {"baseline": 25.0, "test": 1.0}


def test_peers_of_a_wide_network(flows_of):
    from flowlab.operators import aggregates as D
    from flowlab.operators import detectors as R
    f = flows_of([dict(src_ip="10.0.0.1", dst_ip=f"10.{i}.0.9") for i in (1, 2, 2, 3)] + [dict(src_ip="10.0.0.2", dst_ip="10.9.9.9"),
                                                                                        dict(src_ip="10.0.0.2", dst_ip="11.9.9.9")])
    peers = {("10.0.0.1", f"10.{i}.0.9") for i in (1, 2, 3)}
    assert {tuple(r) for r in D.internal_peers(f, "10.0.0.0/8").collect()} == peers | {("10.0.0.2", "10.9.9.9")}
    assert {tuple(r) for r in R.botnet_peers(f, "10.0.0.0/8", min_fanout=2).collect()} == peers


def test_flow_files_with_wider_integers(spark, flows_of, tmp_path):
    from flowlab.sources import read_flows
    flows_of([dict(port=53)]).withColumn("port", F.col("port").cast("bigint")).drop("period").write.parquet(f"{tmp_path}/f")
    assert dict(read_flows(spark, f"{tmp_path}/f", "test").dtypes)["port"] == "int"
    assert read_flows(spark, f"{tmp_path}/f", "test").first().port == 53
