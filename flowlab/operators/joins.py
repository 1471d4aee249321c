"""Joins (J1-J5, J8-J10).

The reference joins per-period aggregates with pandas ``merge`` and
index-aligned ``add``. Most of these collapse into one conditional aggregate
over the single flows frame: one shuffle, and the outer-join "missing side is
0" semantics come for free.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..defaults import TOP_HOSTS
from ..functions import arith, net
from ..schema import BASELINE, TEST
from . import filters as B
from .summary import WEIGHT, is_summary, n_flows, n_flows_if


def _is_base():
    return F.col("period") == BASELINE


def _is_test():
    return F.col("period") == TEST


def _endpoints(flows: DataFrame, net_prefix: str, extra=()) -> DataFrame:
    """One row per internal endpoint of a flow: its source if internal, its
    destination if internal (a flow inside the network yields both)."""
    src = F.when(net.in_prefix("src_ip", net_prefix), F.col("src_ip"))
    dst = F.when(net.in_prefix("dst_ip", net_prefix), F.col("dst_ip"))
    weight = [WEIGHT] if is_summary(flows) else []
    return (flows.select(F.explode(F.array(src, dst)).alias("ip"), *extra, *weight)
            .where(F.col("ip").isNotNull()))


def host_activity(flows: DataFrame, net_prefix: str = net.DEFAULT_NET, by=("period",)) -> DataFrame:
    """Flows per period and internal address as source plus as destination.

    Equals the reference's full outer join of the two counts with missing
    sides 0, in one aggregate instead of two aggregates and a join.
    """
    return (_endpoints(flows, net_prefix, extra=by).groupBy(*by, "ip").agg(n_flows(flows).alias("flows"))
            .orderBy(*by, F.col("flows").desc(), "ip"))


def host_activity_by_period(flows: DataFrame, net_prefix: str = net.DEFAULT_NET) -> DataFrame:
    ep = _endpoints(flows, net_prefix, extra=["period"])
    return ep.groupBy("ip").agg(
        n_flows_if(flows, _is_base()).alias("counts_normal"), n_flows_if(flows, _is_test()).alias("counts_test"))


def top_hosts_compare(flows: DataFrame, net_prefix: str = net.DEFAULT_NET, k: int = TOP_HOSTS) -> DataFrame:
    """Baseline activity of the test period's top-k hosts (inner join:
    hosts absent from the baseline drop out)."""
    per = host_activity_by_period(flows, net_prefix)
    top = per.where(F.col("counts_test") > 0).orderBy(F.col("counts_test").desc(), "ip").limit(k)
    return top.where(F.col("counts_normal") > 0).select("ip", "counts_normal", "counts_test")


def flows_to_known_hosts(flows: DataFrame, hosts: DataFrame, host_col: str = "ip",
                         name: str = "counts", by=("period",)) -> DataFrame:
    """Flows whose destination is in a computed host set, per source; with
    ``by`` each period has its own set (``hosts`` then has those columns too).

    A left semi join; AQE turns it into a broadcast only if the host set's
    measured size allows.
    """
    h = hosts.select(*by, F.col(host_col).alias("dst_ip")).distinct()
    return (flows.join(h, [*by, "dst_ip"], "left_semi").groupBy(*by, "src_ip")
            .agg(n_flows(flows).alias(name)))


def top_hosts_by_period(flows: DataFrame, k: int, net_prefix: str = net.DEFAULT_NET) -> DataFrame:
    """``(period, ip)``: the k most active internal addresses of each period
    (2k rows at most)."""
    from pyspark.sql import Window
    per = (_endpoints(flows, net_prefix, extra=["period"]).groupBy("period", "ip")
           .agg(n_flows(flows).alias("n")))
    rank = F.row_number().over(Window.partitionBy("period").orderBy(F.col("n").desc(), "ip"))
    return per.withColumn("_r", rank).where(F.col("_r") <= k).select("period", "ip")


def server_contact_growth(flows: DataFrame, net_prefix: str = net.DEFAULT_NET,
                          top_k: int | None = None) -> DataFrame:
    """Per source, flows to internal hosts in each period and % increase.

    The reference's host set for a period is every internal address seen as
    source or destination in that period; a destination is in that set exactly
    when it carries the network prefix, so the semi join of J4 reduces to a
    pushed-down prefix filter here. Sources with flows in either period are
    kept (outer join), missing side 0. ``top_k`` restricts the hosts to each
    period's k busiest (a 2k-row broadcast), as the survey's option for Q4.
    """
    inside = flows.where(net.in_prefix("dst_ip", net_prefix))
    if top_k is not None:
        # Q4 option: only each period's k busiest internal hosts count as servers
        top = top_hosts_by_period(flows, top_k, net_prefix).withColumnRenamed("ip", "dst_ip")
        inside = inside.join(F.broadcast(top), ["period", "dst_ip"], "left_semi")
    agg = inside.groupBy("src_ip").agg(
        n_flows_if(flows, _is_base()).alias("counts"), n_flows_if(flows, _is_test()).alias("counts_test"))
    return agg.withColumn("increase", arith.pct_increase("counts", "counts_test"))


def bytes_with_counts(flows: DataFrame, net_prefix: str = net.DEFAULT_NET, by=("period",)) -> DataFrame:
    """Bytes and flow counts to the internet per period and source, with averages."""
    agg = B.to_internet_flows(flows, net_prefix).groupBy(*by, "src_ip").agg(
        F.sum("up_bytes").alias("up_bytes"), F.sum("down_bytes").alias("down_bytes"),
        n_flows(flows).alias("counts"))
    return agg.select("*", arith.per_flow("up_bytes", "counts").alias("avg_up_bytes"),
                      arith.per_flow("down_bytes", "counts").alias("avg_down_bytes"))


def candidate_bytes(flows: DataFrame, candidates: DataFrame, net_prefix: str = net.DEFAULT_NET,
                    period: str | None = TEST) -> DataFrame:
    """Internet bytes of candidate sources only (semi join on src_ip)."""
    sel = B.to_internet_flows(B.in_period(flows, period), net_prefix)
    cand = candidates.select("src_ip").distinct()
    return (sel.join(cand, "src_ip", "left_semi").groupBy("src_ip")
            .agg(F.sum("up_bytes").alias("up_bytes"), F.sum("down_bytes").alias("down_bytes")))


def period_compare(flows: DataFrame, net_prefix: str = net.DEFAULT_NET) -> DataFrame:
    """Per source, average internet bytes per flow in each period; sources
    present in both periods only (the reference's inner merge, Q18)."""
    return period_internet_totals(flows, net_prefix).select(*PERIOD_AVERAGES)


PERIOD_AVERAGES = ["src_ip", "avg_up_bytes_normal", "avg_down_bytes_normal",
                   "avg_up_bytes_test", "avg_down_bytes_test"]


def period_internet_totals(flows: DataFrame, net_prefix: str = net.DEFAULT_NET) -> DataFrame:
    """J9's single conditional aggregate: per source present in both periods,
    internet flow counts and byte sums of each period and the averages."""
    agg = B.to_internet_flows(flows, net_prefix).groupBy("src_ip").agg(
        n_flows_if(flows, _is_base()).alias("counts_normal"), n_flows_if(flows, _is_test()).alias("counts_test"),
        F.sum(F.when(_is_base(), F.col("up_bytes"))).alias("up_normal"),
        F.sum(F.when(_is_base(), F.col("down_bytes"))).alias("down_normal"),
        F.sum(F.when(_is_test(), F.col("up_bytes"))).alias("up_test"),
        F.sum(F.when(_is_test(), F.col("down_bytes"))).alias("down_test"))
    both = agg.where((F.col("counts_normal") > 0) & (F.col("counts_test") > 0))
    return both.select(
        "*",
        arith.per_flow("up_normal", "counts_normal").alias("avg_up_bytes_normal"),
        arith.per_flow("down_normal", "counts_normal").alias("avg_down_bytes_normal"),
        arith.per_flow("up_test", "counts_test").alias("avg_up_bytes_test"),
        arith.per_flow("down_test", "counts_test").alias("avg_down_bytes_test"))


def _asked(ips: DataFrame, ip_col: str) -> DataFrame:
    return ips.select(F.col(ip_col).alias("ip")).where(F.col("ip").isNotNull()).distinct().withColumn("ptr_name", net.ptr_name("ip"))


def _one_per_name(dns_cache: DataFrame) -> DataFrame:
    """A cache appended to over time may hold a name twice: the smallest host counts,
    a host before none."""
    return dns_cache.groupBy("ptr_name").agg(F.min("host").alias("host"))


def reverse_dns(ips: DataFrame, dns_cache: DataFrame, ip_col: str = "ip") -> DataFrame:
    """Every distinct address with the PTR host a cached lookup table has for
    it (left join on H6); null where the cache has none, or knows there is none."""
    return _asked(ips, ip_col).join(_one_per_name(dns_cache), "ptr_name", "left").select("ip", "host")


def dns_misses(ips: DataFrame, dns_cache: DataFrame, ip_col: str = "ip") -> DataFrame:
    """The distinct addresses still to be resolved, ``(ip, ptr_name)``: not in
    the cache (a name the cache knows to have no host is not asked again). An
    anti join; Spark's runtime filters apply where they are enabled."""
    return _asked(ips, ip_col).join(dns_cache.select("ptr_name"), "ptr_name", "left_anti").select("ip", "ptr_name")
