"""Properties from the survey's test plan: equivalence with the reference's
join forms, and invariance to row order and partitioning."""


from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowlab.operators import detectors as R
from flowlab.operators import joins as J
from flowlab.sources import load_flows
from tests.conftest import make_flows

SF = "/root/testdata/sf0.01"


def test_host_activity_equals_full_outer_join_form(spark):
    f = load_flows(spark, SF)
    net = "192.168.109."
    src = f.where(F.col("src_ip").startswith(net)).groupBy(F.col("src_ip").alias("ip")).count() \
        .withColumnRenamed("count", "a")
    dst = f.where(F.col("dst_ip").startswith(net)).groupBy(F.col("dst_ip").alias("ip")).count() \
        .withColumnRenamed("count", "b")
    outer = src.join(dst, "ip", "full").select(
        "ip", (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("flows"))
    assert sorted(map(tuple, outer.collect())) == sorted(map(tuple, J.host_activity(f, by=()).collect()))


def test_exfiltration_invariant_to_order_and_partitioning(spark):
    f = load_flows(spark, SF)
    base = sorted(map(tuple, R.detect_exfiltration(f).collect()))
    for parts in (1, 3, 17):
        shuffled = f.orderBy(F.rand(seed=parts)).repartition(parts)
        assert sorted(map(tuple, R.detect_exfiltration(shuffled).collect())) == base


ADDR = st.sampled_from(["192.168.109.1", "192.168.109.2", "192.168.109.9", "8.8.8.8", "20.1.2.3"])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(ADDR, ADDR, st.sampled_from(["baseline", "test"]),
                          st.integers(0, 10_000), st.integers(1, 10_000)), min_size=1, max_size=40))
def test_growth_matches_python_model(spark, rows):
    f = make_flows(spark, [dict(src_ip=s, dst_ip=d, period=p, up_bytes=u, down_bytes=dn)
                           for s, d, p, u, dn in rows])
    got = {r.src_ip: (r.counts, r.counts_test, r.increase) for r in J.server_contact_growth(f).collect()}
    model = {}
    for s, d, p, _u, _d in rows:
        if d.startswith("192.168.109."):
            b, t = model.get(s, (0, 0))
            model[s] = (b + (p == "baseline"), t + (p == "test"))
    assert set(got) == set(model)
    for s, (b, t) in model.items():
        inc = (t - b) / b * 100 if b else (float("inf") if t > b else None)
        gb, gt, gi = got[s]
        assert (gb, gt) == (b, t)
        assert (gi is None and inc is None) or abs(gi - inc) < 1e-9 or gi == inc


def test_growth_top_k_matches_brute_force(spark):
    from pyspark.sql import functions as F
    f = load_flows(spark, SF)
    rows = f.select("period", "src_ip", "dst_ip").collect()
    net = "192.168.109."
    # brute force: per period, the k busiest internal endpoints (ties by address)
    k = 3
    top = {}
    for p in ("baseline", "test"):
        counts = {}
        for r in rows:
            if r.period != p:
                continue
            for ip in (r.src_ip, r.dst_ip):
                if ip.startswith(net):
                    counts[ip] = counts.get(ip, 0) + 1
        top[p] = {ip for ip, _ in sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:k]}
    model = {}
    for r in rows:
        if r.dst_ip in top[r.period]:
            b, t = model.get(r.src_ip, (0, 0))
            model[r.src_ip] = (b + (r.period == "baseline"), t + (r.period == "test"))
    got = {r.src_ip: (r.counts, r.counts_test) for r in J.server_contact_growth(f, top_k=k).collect()}
    assert got == model
    assert J.server_contact_growth(f, top_k=k).where(F.col("counts") < 0).count() == 0
