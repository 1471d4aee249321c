"""The registered queries: one per operator of the inventory, each over the
whole flows table derived from a scale factor's ``events``.

Output conventions shared with the SQL oracle: sums and counts BIGINT,
averages and ratios DOUBLE rounded to 6 decimals, lists joined with ','.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import defaults as K
from ..functions import arith, net, timeparts
from ..operators import aggregates as D
from ..operators import detectors as R
from ..operators import filters as B
from ..operators import joins as J
from ..operators import quantiles as Q
from ..operators import rangejoin as RJ
from ..operators import setops as G
from ..operators import sorts as S
from ..operators import windows as E
from ..schema import BASELINE, NUM_COLUMNS, TEST
from ..sources import (blocklist, derived_dns_cache, derived_flow_files, derived_range_files, detections,
                       fixture_asn_ranges, fixture_geo_ranges, load_flows, read_asn, read_dns_cache, read_flows, read_geo,
                       read_periods)
from ..sources.store import flows_table_path

# Fixed parameters of the registered queries (the reference picks hosts by eye).
PEER_SUSPECTS = ("192.168.109.4", "192.168.109.12", "192.168.109.18")
DNS_SUSPECTS = ("192.168.109.8", "192.168.109.10")
TCP_SUSPECTS = ("192.168.109.6", "192.168.109.15")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def finish(df: DataFrame) -> DataFrame:
    """Round doubles to 6 decimals and join arrays with ',' for comparison;
    the stored integer address columns are not part of any result."""
    cols = []
    for f in df.schema.fields:
        if f.name in NUM_COLUMNS:
            continue
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, 6)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(F.array_sort(c), ",")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(key: str):
    def register(fn: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(fn(spark, sf_dir))
        run.__name__ = key
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        return fn
    return register


def flows(spark, sf) -> DataFrame:
    return load_flows(spark, sf)


def flows_cc(spark, sf) -> DataFrame:
    """Every flow with its country, for queries that return flows."""
    return RJ.geo_country(flows(spark, sf), fixture_geo_ranges(spark))


def edges_cc(spark, sf, *measures: str, period: str | None = None) -> DataFrame:
    """External edges with their country, for queries that aggregate flows."""
    return RJ.country_edges(B.in_period(flows(spark, sf), period), fixture_geo_ranges(spark), measures=measures)


# --- A: sources and sinks ------------------------------------------------------

@query("flow_scan")
def _a1(spark, sf):
    """A1 on the stored dataset, partitioned by period."""
    return read_flows(spark, flows_table_path(spark, sf))


@query("file_order_scan")
def _a1b(spark, sf):
    """A1 on several files without ids: positions in file order, for each period."""
    baseline, test = derived_flow_files(spark, sf)
    return read_flows(spark, baseline, BASELINE).unionByName(read_flows(spark, test, TEST))


@query("period_scan")
def _a2(spark, sf):
    """A2: two periods of several files each as one frame; the last position shows
    that the files' rows are numbered through."""
    # min/max ticks rather than a tick sum: a sum of ticks overflows BIGINT at 10^12 flows
    return read_periods(spark, *derived_flow_files(spark, sf)).groupBy("period").agg(
        F.count(F.lit(1)).alias("flows"), F.max("flow_id").alias("last_position"), F.sum("up_bytes").alias("up_bytes"),
        F.sum("down_bytes").alias("down_bytes"), F.min("timestamp").alias("first_tick"),
        F.max("timestamp").alias("last_tick"))


@query("csv_sink")
def _a5(spark, sf):
    """A5: R16's distinct new-country flows written as CSV to the shared
    folder and read back (header, '\\N' for null, '' kept); the folder goes when
    the application ends."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources import read_csv_result, write_csv
    from ..sources.store import delete_at_end
    out = G.new_country_flows(edges_cc(spark, sf))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/flowlab-out/new_country_ips-{uuid.uuid4().hex[:12]}"
    delete_at_end(spark, path)
    write_csv(out, path)
    return read_csv_result(spark, path, out.schema)


@query("blocklist")
def _a6(spark, sf):
    """Every address that a detector of the report names, merged into the list
    kept so far (here: what the baseline's fan-out alone would have listed)."""
    f = flows(spark, sf)
    before = blocklist(detections(R.detect_botnet(f, period=BASELINE, min_fanout=3), "fanout_before"))
    return blocklist(R.address_detections(R.alerts(f, fixture_geo_ranges(spark))), existing=before)


# --- B: predicates -------------------------------------------------------------

@query("udp_flows")
def _b1(spark, sf):
    return B.udp_flows(flows(spark, sf))


@query("port443_flows")
def _b2(spark, sf):
    return B.port_flows(flows(spark, sf), 443)


@query("udp443_flows")
def _b3(spark, sf):
    return B.proto_port_flows(flows(spark, sf), "udp", 443)


@query("port53_non_udp")
def _b4(spark, sf):
    return B.port_protocol_check(flows(spark, sf), 53, "udp")


@query("port443_non_udp")
def _b5(spark, sf):
    return B.port_protocol_check(flows(spark, sf), 443, "udp")


@query("internal_flows")
def _b6(spark, sf):
    return B.internal_flows(flows(spark, sf))


@query("external_flows")
def _b7(spark, sf):
    return B.external_flows(flows(spark, sf))


@query("to_internet_flows")
def _b8(spark, sf):
    return B.to_internet_flows(flows(spark, sf))


@query("rfc1918_flows")
def _b9(spark, sf):
    return B.rfc1918_flows(flows(spark, sf))


@query("public_flag")
def _b10(spark, sf):
    return B.public_flag(flows(spark, sf))


@query("private_split")
def _b11(spark, sf):
    return B.private_split(flows(spark, sf))


@query("host_in_list")
def _b12(spark, sf):
    return B.host_in_list(B.public_flag(flows(spark, sf)), "src_ip", PEER_SUSPECTS, flag="pub")


@query("host_or_chain")
def _b13(spark, sf):
    return B.host_or_chain(flows(spark, sf), PEER_SUSPECTS)


@query("time_range")
def _b14(spark, sf):
    return B.time_range(flows(spark, sf), *K.BURST_SECONDS)


@query("having_threshold")
def _b15(spark, sf):
    return B.having_threshold(D.internet_flows_by_src(flows(spark, sf)), "counts", 100)


@query("project_columns")
def _b16(spark, sf):
    return B.project_columns(flows_cc(spark, sf), "src_ip", "dst_ip", "dst_cc")


@query("rename_agg")
def _b17(spark, sf):
    f = flows(spark, sf).where(net.in_prefix("src_ip"))
    return B.rename_agg(f.groupBy("src_ip").count(), "count", "counts")


@query("fill_zero")
def _b18(spark, sf):
    f = flows(spark, sf)
    hosts = f.select("src_ip").distinct()
    return B.fill_zero(hosts.join(D.udp443_count_by_src(f), "src_ip", "left"), "n")


@query("drop_null_cc")
def _b19(spark, sf):
    return B.drop_null_cc(flows_cc(spark, sf)).select("flow_id", "dst_cc")


# --- J: joins ------------------------------------------------------------------

@query("host_activity")
def _j1(spark, sf):
    return J.host_activity(flows(spark, sf))


@query("top_hosts_compare")
def _j2(spark, sf):
    return J.top_hosts_compare(flows(spark, sf), k=10)


@query("server_contact_growth")
def _j3(spark, sf):
    return J.server_contact_growth(flows(spark, sf))


@query("flows_to_known_hosts")
def _j4(spark, sf):
    f = flows(spark, sf)
    return J.flows_to_known_hosts(f, J.host_activity(f))


@query("bytes_with_counts")
def _j5(spark, sf):
    return J.bytes_with_counts(flows(spark, sf))


@query("geo_country")
def _j6(spark, sf):
    geo, _ = derived_range_files(spark, sf)
    return RJ.geo_country(flows(spark, sf), read_geo(spark, geo)).select("flow_id", "dst_ip", "dst_cc")


@query("geo_org")
def _j7(spark, sf):
    _, asn = derived_range_files(spark, sf)
    return RJ.geo_org(flows(spark, sf), read_asn(spark, asn)).select("flow_id", "dst_ip", "dst_org")


@query("geo_ranges")
def _a3(spark, sf):
    """A3: a stored country table with nested and unaligned ranges, made flat."""
    return RJ.flatten(read_geo(spark, derived_range_files(spark, sf)[0]), "cc")


@query("asn_ranges")
def _a4(spark, sf):
    """A4: the same of a stored organisation table."""
    return RJ.flatten(read_asn(spark, derived_range_files(spark, sf)[1]), "org")


@query("candidate_bytes")
def _j8(spark, sf):
    f = flows(spark, sf)
    return J.candidate_bytes(f, R.detect_botnet(f))


@query("period_compare")
def _j9(spark, sf):
    return J.period_compare(flows(spark, sf))


@query("reverse_dns")
def _j10(spark, sf):
    cache = read_dns_cache(spark, derived_dns_cache(spark, sf))
    return J.reverse_dns(flows(spark, sf), cache, "dst_ip")


@query("dns_misses")
def _j10b(spark, sf):
    """The destinations a resolver still has to be asked for."""
    return J.dns_misses(flows(spark, sf), read_dns_cache(spark, derived_dns_cache(spark, sf)), "dst_ip")


# --- D: aggregates -------------------------------------------------------------

@query("udp_count_by_src")
def _d1(spark, sf):
    return D.udp_count_by_src(flows(spark, sf))


@query("udp443_count_by_src")
def _d2(spark, sf):
    return D.udp443_count_by_src(flows(spark, sf))


@query("avg_down_by_src")
def _d3(spark, sf):
    return D.avg_down_by_src(flows(spark, sf))


@query("up443_by_src")
def _d4(spark, sf):
    return D.up443_by_src(flows(spark, sf))


@query("down_up_ratio_443")
def _d5(spark, sf):
    return D.down_up_ratio_443(flows(spark, sf))


@query("up443_histogram")
def _d6(spark, sf):
    return D.up443_histogram(flows(spark, sf), bins=10)


@query("internal_udp_by_src")
def _d7(spark, sf):
    return D.internal_udp_by_src(flows(spark, sf))


@query("internal_tcp_by_src")
def _d8(spark, sf):
    return D.internal_tcp_by_src(flows(spark, sf))


@query("external_udp_by_src")
def _d9(spark, sf):
    return D.external_udp_by_src(flows(spark, sf))


@query("mean_flows_per_host")
def _d10(spark, sf):
    return D.mean_flows_per_host(flows(spark, sf))


@query("proto_frequency")
def _d11(spark, sf):
    return D.proto_frequency(flows(spark, sf))


@query("port_frequency")
def _d12(spark, sf):
    return D.port_frequency(flows(spark, sf))


@query("distinct_dst")
def _d13(spark, sf):
    return D.distinct_dst(flows(spark, sf))


@query("distinct_countries")
def _d14(spark, sf):
    return D.distinct_countries(RJ.destination_countries(flows(spark, sf), fixture_geo_ranges(spark)))


@query("distinct_orgs")
def _d15(spark, sf):
    return D.distinct_orgs(RJ.destination_orgs(flows(spark, sf), fixture_asn_ranges(spark)))


@query("bytes_summary")
def _d16(spark, sf):
    return Q.describe(flows(spark, sf), ["up_bytes", "down_bytes"])


@query("internal_services")
def _d17(spark, sf):
    return D.internal_services(flows(spark, sf))


@query("internal_services_mean")
def _d18(spark, sf):
    return D.internal_services_mean(flows(spark, sf))


@query("hourly_bytes")
def _d19(spark, sf):
    return D.hourly_bytes(flows(spark, sf))


@query("internal_dst_count")
def _d20(spark, sf):
    return D.internal_dst_count(flows(spark, sf))


@query("internal_fanout")
def _d21(spark, sf):
    return D.internal_fanout(flows(spark, sf))


@query("internal_peers")
def _d22(spark, sf):
    return D.internal_peers(flows(spark, sf), hosts=PEER_SUSPECTS)


@query("dns_up_by_dst")
def _d23(spark, sf):
    return D.dns_up_by_dst(flows(spark, sf))


@query("server_bytes_by_src")
def _d24(spark, sf):
    f = flows(spark, sf)
    return D.server_bytes_by_src(f, D.resolvers(f))


@query("server_conns_by_src")
def _d25(spark, sf):
    f = flows(spark, sf)
    return D.server_conns_by_src(f, D.resolvers(f))


@query("server_ratio_by_src_dst")
def _d26(spark, sf):
    f = flows(spark, sf)
    return D.server_ratio_by_src_dst(f, D.resolvers(f), DNS_SUSPECTS)


@query("ratio_by_src")
def _d27(spark, sf):
    return D.ratio_by_src(flows(spark, sf))


@query("ratio_by_src_dst")
def _d28(spark, sf):
    return D.ratio_by_src_dst(flows(spark, sf), TCP_SUSPECTS)


@query("edge_conns_bytes")
def _d29(spark, sf):
    return D.edge_conns_bytes(flows(spark, sf), (F.col("proto") == "udp") & (F.col("port") == 443))


@query("edge_conns_public")
def _d30(spark, sf):
    return D.edge_conns_public(flows(spark, sf), TCP_SUSPECTS)


@query("edge_bytes")
def _d31(spark, sf):
    return D.edge_bytes(flows(spark, sf), TCP_SUSPECTS)


@query("dns_mean_by_src")
def _d32(spark, sf):
    f = flows(spark, sf)
    return D.dns_mean_by_src(f, D.resolvers(f))


@query("dst_count_for_hosts")
def _d33(spark, sf):
    return D.dst_count_for_hosts(flows(spark, sf), DNS_SUSPECTS)


@query("dns_count_by_src")
def _d34(spark, sf):
    return D.dns_count_by_src(flows(spark, sf))


@query("dns_up_by_src")
def _d35(spark, sf):
    return D.dns_up_by_src(flows(spark, sf))


@query("server_up_by_src")
def _d35b(spark, sf):
    """D35 with a list of resolvers: upload to them on any port."""
    f = flows(spark, sf)
    return D.dns_up_by_src(f, servers=D.resolvers(f), hosts=DNS_SUSPECTS)


@query("udp443_bytes_by_src")
def _d36(spark, sf):
    return D.udp443_bytes_by_src(flows(spark, sf))


@query("host_profile")
def _d37(spark, sf):
    return D.host_profile(flows(spark, sf))


@query("bytes_by_minute")
def _d38(spark, sf):
    return D.bytes_by_minute(flows(spark, sf))


@query("bytes_by_second")
def _d39(spark, sf):
    return D.bytes_by_second(flows(spark, sf))


@query("conns_by_second")
def _d40(spark, sf):
    return D.conns_by_second(flows(spark, sf))


@query("bytes_by_tick")
def _d39b(spark, sf):
    return D.bytes_by_second(flows(spark, sf), unit="tick")


@query("conns_by_tick")
def _d40b(spark, sf):
    return D.conns_by_second(flows(spark, sf), unit="tick")


@query("up_by_minute")
def _d41(spark, sf):
    return D.up_by_minute(flows(spark, sf))


@query("dst_up_with_sources")
def _d42(spark, sf):
    return D.dst_up_with_sources(flows(spark, sf), k=2)


@query("country_frequency")
def _d43(spark, sf):
    return D.country_frequency(G.new_country_flows(edges_cc(spark, sf)))


@query("country_fanout")
def _d44(spark, sf):
    return D.country_fanout(edges_cc(spark, sf))


@query("country_bytes")
def _d45(spark, sf):
    return D.country_bytes(edges_cc(spark, sf, "up_bytes"), ("CN", "RU"))


@query("internet_bytes_by_src")
def _d46(spark, sf):
    return D.internet_bytes_by_src(flows(spark, sf))


@query("internet_flows_by_src")
def _d47(spark, sf):
    return D.internet_flows_by_src(flows(spark, sf))


@query("country_count")
def _d48(spark, sf):
    return D.country_count(RJ.destination_countries(flows(spark, sf), fixture_geo_ranges(spark)))


@query("upload_histogram_time")
def _d49(spark, sf):
    return D.upload_histogram_time(flows(spark, sf), bins=10)


# --- E: windows ----------------------------------------------------------------

@query("flow_gap")
def _e1(spark, sf):
    return E.flow_gap(flows(spark, sf))


@query("avg_flow_gap")
def _e2(spark, sf):
    return E.avg_flow_gap(flows(spark, sf))


# --- F: sorts and limits -------------------------------------------------------

@query("sort_desc")
def _f1(spark, sf):
    return S.sort_desc(D.internet_bytes_by_src(flows(spark, sf)), "up_bytes", ["period", "src_ip"])


@query("top_k_hosts")
def _f2(spark, sf):
    return S.top_k_hosts(flows(spark, sf), k=10)


@query("tail_k")
def _f3(spark, sf):
    return S.tail_k(D.dns_count_by_src(flows(spark, sf)), "n", 5, ["src_ip"])


@query("peak_hour")
def _f4(spark, sf):
    return S.peak_hour(flows(spark, sf))


@query("last_entries")
def _f5(spark, sf):
    return S.last_entries(flows(spark, sf), 10)


@query("preview")
def _f6(spark, sf):
    return S.preview(D.up443_by_src(flows(spark, sf)), "up_bytes", ["src_ip"], n=5)


@query("skip_first_n")
def _f7(spark, sf):
    return S.skip_first_n(D.bytes_by_minute(flows(spark, sf)), "minute", K.SKIP_MINUTES)


@query("last_seconds")
def _f7b(spark, sf):
    return S.last_seconds(flows(spark, sf), 60)


# --- G: set operations ---------------------------------------------------------

@query("new_countries")
def _g1(spark, sf):
    return G.new_countries(edges_cc(spark, sf))


@query("new_country_flows")
def _g2(spark, sf):
    return G.new_country_flows(edges_cc(spark, sf))


@query("new_country_sources")
def _g3(spark, sf):
    return G.new_country_sources(edges_cc(spark, sf))


@query("new_country_source_ips")
def _g3b(spark, sf):
    return G.new_country_source_ips(edges_cc(spark, sf))


@query("country_list_diff")
def _g4(spark, sf):
    test, baseline = G.country_lists(edges_cc(spark, sf, "first_flow_id"))
    return G.country_list_diff(test, baseline, "cc", order_col="first_flow_id")


# --- H: scalar functions -------------------------------------------------------

@query("ts_to_hours")
def _h1(spark, sf):
    return flows(spark, sf).select("flow_id", timeparts.ts_to_hours("timestamp").alias("hms"))


@query("hour_of_day")
def _h2(spark, sf):
    return flows(spark, sf).select("flow_id", timeparts.hour_of_day("timestamp").alias("hour"))


@query("minute_of_day")
def _h3(spark, sf):
    return flows(spark, sf).select("flow_id", timeparts.minute_of_day("timestamp").alias("minute"))


@query("ts_seconds")
def _h4(spark, sf):
    return flows(spark, sf).select("flow_id", timeparts.ts_seconds("timestamp").alias("second"))


@query("ip_to_num")
def _h5(spark, sf):
    # parse the text once (the stored dst_ip_num is not used here: this query
    # exercises the parser), then test the CIDR on the parsed number
    parsed = flows(spark, sf).select("flow_id", net.ip_to_num("dst_ip").alias("dst_num"))
    return parsed.select("flow_id", "dst_num", net.in_cidr("dst_ip", num=F.col("dst_num")).alias("in_net"))


@query("ptr_name")
def _h6(spark, sf):
    return D.distinct_dst(flows(spark, sf)).select("dst_ip", net.ptr_name("dst_ip").alias("ptr"))


@query("address_quarantine")
def _h5b(spark, sf):
    return D.address_quarantine(flows(spark, sf))


@query("pct_increase")
def _h7(spark, sf):
    agg = flows(spark, sf).groupBy("src_ip").agg(
        F.count_if(F.col("period") == BASELINE).alias("b"), F.count_if(F.col("period") == TEST).alias("t"))
    return agg.select("src_ip", arith.pct_increase("b", "t").alias("increase"))


@query("bytes_per_flow")
def _h8(spark, sf):
    agg = flows(spark, sf).groupBy("src_ip").agg(F.sum("up_bytes").alias("s"), F.count(F.lit(1)).alias("n"))
    return agg.select("src_ip", arith.per_flow("s", "n").alias("up_bytes_per_flow"))


@query("share")
def _h9(spark, sf):
    agg = flows(spark, sf).groupBy("src_ip").agg(
        F.count_if(F.col("proto") == "udp").alias("u"), F.count(F.lit(1)).alias("n"))
    return agg.select("src_ip", arith.per_flow("u", "n").alias("udp_share"))


@query("safe_ratio")
def _h10(spark, sf):
    agg = flows(spark, sf).groupBy("src_ip", "port").agg(
        F.sum(F.when(F.col("proto") == "udp", F.col("up_bytes")).otherwise(0)).alias("u"),
        F.sum(F.when(F.col("proto") == "tcp", F.col("up_bytes")).otherwise(0)).alias("t"))
    return agg.select("src_ip", "port", arith.safe_ratio("u", "t").alias("ratio"))


@query("startswith_any")
def _h11(spark, sf):
    return flows(spark, sf).select("flow_id", net.startswith_any("dst_ip").alias("rfc1918"))


# --- R: detectors --------------------------------------------------------------

@query("rule_high_upload")
def _r1(spark, sf):
    return R.rule_high_upload(flows(spark, sf))


@query("rule_high_download")
def _r2(spark, sf):
    return R.rule_high_download(flows(spark, sf))


@query("rule_external_connections")
def _r3(spark, sf):
    return R.rule_external_connections(flows(spark, sf))


@query("rule_many_countries")
def _r4(spark, sf):
    return R.rule_many_countries(edges_cc(spark, sf, period=TEST))


@query("rule_country_transfer")
def _r5(spark, sf):
    return R.rule_country_transfer(edges_cc(spark, sf, "up_bytes", period=TEST))


@query("many_countries_bytes")
def _r6(spark, sf):
    return R.many_countries_bytes(edges_cc(spark, sf, "up_bytes", "down_bytes", period=TEST))


@query("detect_exfiltration")
def _r7(spark, sf):
    return R.detect_exfiltration(flows(spark, sf))


@query("exfiltration_bytes")
def _r8(spark, sf):
    return R.exfiltration_bytes(flows(spark, sf))


@query("detect_c2_growth")
def _r9(spark, sf):
    return R.detect_c2_growth(flows(spark, sf))


@query("detect_botnet")
def _r10(spark, sf):
    return R.detect_botnet(flows(spark, sf))


@query("botnet_peers")
def _r11(spark, sf):
    return R.botnet_peers(flows(spark, sf))


@query("detect_dns_c2")
def _r12(spark, sf):
    return R.detect_dns_c2(flows(spark, sf))


@query("detect_quic_exfil")
def _r13(spark, sf):
    return R.detect_quic_exfil(flows(spark, sf))


@query("detect_tcp_exfil")
def _r14(spark, sf):
    return R.detect_tcp_exfil(flows(spark, sf))


@query("detect_dns_exfil")
def _r15(spark, sf):
    return R.detect_dns_exfil(flows(spark, sf))


@query("detect_new_countries")
def _r16(spark, sf):
    return R.detect_new_countries(edges_cc(spark, sf))


@query("discover_servers")
def _r17(spark, sf):
    return R.discover_servers(flows(spark, sf), k=5)


@query("server_roles")
def _r17b(spark, sf):
    return R.server_roles(flows(spark, sf))


@query("burst_window")
def _r18(spark, sf):
    return R.burst_window(flows(spark, sf))


@query("alerts")
def _alerts(spark, sf):
    return R.alerts(flows(spark, sf), fixture_geo_ranges(spark))
