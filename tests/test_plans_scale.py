"""The scale claims of the README, checked on physical plans."""

import re

import pytest

from flowlab.operators import aggregates as D
from flowlab.operators import detectors as R
from flowlab.operators import filters as B
from flowlab.operators import joins as J
from flowlab.operators import quantiles as Q
from flowlab.operators import windows as E
from flowlab.operators.summary import edge_summary
from flowlab.sources import fixture_geo_ranges, load_flows
from tests.conftest import SF_SMALL
from tests.plan_text import executed, scans


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(p):
    return re.findall(r"Exchange (hashpartitioning\([^)]*\)|rangepartitioning|SinglePartition|RoundRobin)", p)


@pytest.fixture(scope="module")
def flows(spark):
    return load_flows(spark, SF_SMALL)


@pytest.mark.parametrize("fn", [J.period_compare, J.server_contact_growth, R.detect_exfiltration,
                                R.detect_c2_growth])
def test_period_comparison_is_one_shuffle(flows, fn):
    ex = exchanges(plan(fn(flows)))
    assert len(ex) == 1 and ex[0].startswith("hashpartitioning(src_ip")


def test_host_activity_one_aggregate_shuffle(flows):
    ex = exchanges(plan(J.host_activity(flows)))
    # one hash exchange for the aggregate, one range exchange for the ordering
    assert sum(e.startswith("hashpartitioning") for e in ex) == 1


def test_windows_are_bounded(flows):
    assert "Window" not in plan(E.avg_flow_gap(flows))
    p = plan(E.flow_gap(flows))
    # the per-flow window is partitioned by period, source and flow-id bucket; only the
    # per-bucket summary (one row per source and bucket) is windowed by source
    windows = [line for line in p.split("\n") if "Window [lag(timestamp" in line]
    assert windows and all(re.search(r"\[period#\d+, src_ip#\d+, _b#\d+L?\]", line) for line in windows)


def test_quantiles_shuffle_counts_not_values(flows):
    df = Q.order_statistics(flows, ["up_bytes", "down_bytes"], (0.25, 0.5, 0.75))
    p = plan(df)
    # every shuffle of a round is the final half of a partial count by 16 bits
    assert p.count("partial_count(1)") >= 4 and "SinglePartition" not in p
    assert "rangepartitioning" not in p and "SortMergeJoin" not in p


@pytest.mark.parametrize("fn", [D.up443_histogram, D.upload_histogram_time, lambda f: Q.describe(f, ["up_bytes", "down_bytes"])])
def test_statistics_are_lazy(spark, flows, fn):
    spark.sparkContext.setJobGroup("statistics", "")
    df = fn(flows)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("statistics")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert df.count() > 0


@pytest.mark.parametrize("fn", [D.up443_histogram, D.upload_histogram_time])
def test_histograms_aggregate_flows_once(flows, fn):
    p = executed(fn(flows))
    assert scans(p) == 1 and "ReusedExchange" in p


def test_alerts_is_lazy_and_scans_flows_once(spark, flows):
    assert exchanges(plan(edge_summary(flows)))[0].startswith("hashpartitioning(period")
    report = R.alerts(flows, fixture_geo_ranges(spark))
    p = executed(report)
    text = plan(report)
    assert "Expand" in text and "spark_grouping_id" in text
    # every reader but the first takes the edges from an exchange that exists
    assert p.count("ReusedExchange") >= 2
    spark.sparkContext.setJobGroup("build", "")
    R.alerts(flows, fixture_geo_ranges(spark))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("build")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("fn", [R.detect_dns_c2, R.detect_dns_exfil, R.detect_tcp_exfil])
def test_detectors_with_means_or_second_looks_scan_once(flows, fn):
    p = executed(fn(flows))
    assert p.count("ReusedExchange") >= 1 and "Scan ExistingRDD" not in p


def test_cidr_filters_reach_the_scan(spark, flows):
    host = ["192.168.109.4"]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # show the filters in full
    for df in (B.host_or_chain(flows, host), D.internal_dst_count(flows), D.internal_fanout(flows), D.internal_peers(flows),
               R.detect_botnet(flows), R.botnet_peers(flows)):
        pushed = re.findall(r"PushedFilters: \[[^\]]*\]", df._jdf.queryExecution().executedPlan().toString())
        assert pushed and all("dst_ip_num" in x for x in pushed)
