"""Detectors (R1-R18) and the alert union.

Each detector is a pure, lazy ``DataFrame -> DataFrame`` with keyword
thresholds. Single-period detectors read the test period (``period=None``
reads everything). Means "over hosts" enter as scalar subqueries, so no
detector joins a one-row table by a cross join or collects data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import defaults as K
from ..functions import arith, net
from ..schema import BASELINE, TEST
from . import aggregates as D
from . import filters as B
from . import joins as J
from . import rangejoin as RJ
from . import setops as G
from .summary import WEIGHT, flow_sum, n_flows, shared


def _is_base():
    return F.col("period") == BASELINE


def _is_test():
    return F.col("period") == TEST


def _host_internet_avgs(flows: DataFrame, net_prefix: str) -> DataFrame:
    """Per (period, source): average internet bytes per flow (J5 by period)."""
    per = B.to_internet_flows(flows, net_prefix).groupBy("period", "src_ip").agg(
        F.sum("up_bytes").alias("up"), F.sum("down_bytes").alias("down"), n_flows(flows).alias("n"))
    return per.select("period", "src_ip", arith.per_flow("up", "n").alias("avg_up_bytes"),
                      arith.per_flow("down", "n").alias("avg_down_bytes"))


def _mean_rule(flows: DataFrame, col: str, threshold: float, net_prefix: str) -> DataFrame:
    per = _host_internet_avgs(flows, net_prefix)
    means = per.agg(F.avg(F.when(_is_base(), F.col(col))).alias("normal_mean"),
                    F.avg(F.when(_is_test(), F.col(col))).alias("test_mean"))
    return means.select("normal_mean", "test_mean",
                        F.coalesce(F.col("test_mean") > F.col("normal_mean") * threshold,
                                   F.lit(False)).alias("detected"))


def rule_high_upload(flows: DataFrame, threshold: float = K.PERIOD_FACTOR,
                     net_prefix: str = net.DEFAULT_NET) -> DataFrame:
    """Mean over hosts of average upload per flow, test > threshold x baseline."""
    return _mean_rule(flows, "avg_up_bytes", threshold, net_prefix)


def rule_high_download(flows: DataFrame, threshold: float = K.PERIOD_FACTOR,
                       net_prefix: str = net.DEFAULT_NET) -> DataFrame:
    """R2: the same for download."""
    return _mean_rule(flows, "avg_down_bytes", threshold, net_prefix)


def rule_external_connections(flows: DataFrame, threshold: int = K.EXTERNAL_FLOWS_THRESHOLD,
                              net_prefix: str = net.DEFAULT_NET, period: str | None = TEST) -> DataFrame:
    """Total (not per host) test flows to the internet above a threshold."""
    n = B.to_internet_flows(B.in_period(flows, period), net_prefix).agg(
        F.coalesce(n_flows(flows), F.lit(0)).cast("bigint").alias("external_flows"))
    return n.select("external_flows", (F.col("external_flows") > threshold).alias("detected"))


def rule_many_countries(flows_cc: DataFrame, threshold: int = K.MAX_COUNTRIES,
                        period: str | None = TEST) -> DataFrame:
    """Sources reaching more than ``threshold`` distinct known countries."""
    return B.having_threshold(D.country_fanout(B.in_period(flows_cc, period)), "n_countries", threshold)


def rule_country_transfer(flows_cc: DataFrame, countries=K.TRANSFER_COUNTRIES,
                          threshold: int = K.TRANSFER_BYTES, period: str | None = TEST) -> DataFrame:
    """Sources uploading more than ``threshold`` bytes to listed countries."""
    return B.having_threshold(D.country_bytes(B.in_period(flows_cc, period), countries), "up_bytes", threshold)


def many_countries_bytes(flows_cc: DataFrame, threshold: int = K.MAX_COUNTRIES,
                         net_prefix: str = net.DEFAULT_NET) -> DataFrame:
    """Test internet bytes of R4's sources (chart data), in one aggregate:
    the distinct known countries and the internet byte sums per source."""
    test = B.in_period(flows_cc, TEST)
    internet = ~net.in_prefix("dst_ip", net_prefix)
    known = F.when(F.col("dst_cc") != "", F.col("dst_cc"))
    per = test.groupBy("src_ip").agg(
        F.count_distinct(known).alias("_n"),
        F.sum(F.when(internet, F.col("up_bytes"))).alias("up_bytes"),
        F.sum(F.when(internet, F.col("down_bytes"))).alias("down_bytes"))
    return per.where((F.col("_n") > threshold) & F.col("up_bytes").isNotNull()).select(
        "src_ip", "up_bytes", "down_bytes")


def detect_exfiltration(flows: DataFrame, net_prefix: str = net.DEFAULT_NET,
                        factor: float = K.PERIOD_FACTOR) -> DataFrame:
    """Average up or down bytes per internet flow grew past ``factor`` x
    baseline; sources present in both periods. One scan, one shuffle."""
    return _exfil_totals(flows, net_prefix, factor).select(*J.PERIOD_AVERAGES)


def _exfil_totals(flows: DataFrame, net_prefix: str, factor: float) -> DataFrame:
    tot = J.period_internet_totals(flows, net_prefix)
    return tot.where((F.col("avg_up_bytes_test") > F.col("avg_up_bytes_normal") * factor)
                     | (F.col("avg_down_bytes_test") > F.col("avg_down_bytes_normal") * factor))


def exfiltration_bytes(flows: DataFrame, net_prefix: str = net.DEFAULT_NET,
                       factor: float = K.PERIOD_FACTOR) -> DataFrame:
    """Test internet bytes of R7's sources. The test sums are part of R7's
    own aggregate, so this is the same single scan (no second pass and semi
    join as ``candidate_bytes`` would need)."""
    return _exfil_totals(flows, net_prefix, factor).select(
        "src_ip", F.col("up_test").alias("up_bytes"), F.col("down_test").alias("down_bytes"))


def detect_c2_growth(flows: DataFrame, net_prefix: str = net.DEFAULT_NET, min_increase: float = K.C2_MIN_INCREASE,
                     min_baseline: int = K.C2_MIN_BASELINE, include_new_hosts: bool = False,
                     top_k: int | None = None) -> DataFrame:
    """Flows to internal hosts grew more than ``min_increase`` % and the
    baseline had more than ``min_baseline`` such flows.

    As in the reference the ``inf`` arm is dead by default (Q3): an infinite
    increase needs a zero baseline. ``include_new_hosts=True`` flags sources
    silent in the baseline that exceed ``min_baseline`` flows in the test.
    A 0/0 increase is null and never flags (Q2b).
    """
    g = J.server_contact_growth(flows, net_prefix, top_k=top_k)
    inc = F.col("increase")
    cond = ((inc > min_increase) | (inc == float("inf"))) & (F.col("counts") > min_baseline)
    if include_new_hosts:
        cond = cond | ((F.col("counts") == 0) & (F.col("counts_test") > min_baseline))
    return g.where(F.coalesce(cond, F.lit(False)))


def detect_botnet(flows: DataFrame, cidr: str = net.DEFAULT_CIDR, min_fanout: int = K.MIN_FANOUT,
                  period: str | None = TEST) -> DataFrame:
    """Sources with more distinct internal destinations than ``min_fanout``."""
    return B.having_threshold(D.internal_fanout(B.in_period(flows, period), cidr), "n_peers", min_fanout)


def botnet_peers(flows: DataFrame, cidr: str = net.DEFAULT_CIDR, min_fanout: int = K.MIN_FANOUT,
                 period: str | None = TEST) -> DataFrame:
    """The internal peers of R10's sources, one row per (source, peer).
    The distinct pairs give the fan-out too, so they are made once."""
    pairs = D.internal_peers(B.in_period(flows, period), cidr)
    suspects = pairs.groupBy("src_ip").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > min_fanout)
    return pairs.join(suspects, "src_ip", "left_semi")


def _dns_per_src(flows: DataFrame) -> DataFrame:
    """Per-source DNS totals. The detector and its mean over hosts read them by
    plans that share the aggregate, so the flows are scanned once."""
    dns = B.proto_port_flows(flows, "udp", 53)
    per = dns.groupBy("src_ip").agg(
        flow_sum(flows).alias("conns"), F.sum("up_bytes").alias("up_bytes"), F.sum("down_bytes").alias("down_bytes"))
    return (shared(per, "conns", "up_bytes", "down_bytes")
            .select("src_ip", "conns", "up_bytes", arith.safe_ratio("up_bytes", "down_bytes").alias("ratio")))


def detect_dns_c2(flows: DataFrame, volume_factor: float = K.DNS_C2_VOLUME,
                  ratio_lo: float = K.DNS_RATIO_RANGE[0], ratio_hi: float = K.DNS_RATIO_RANGE[1],
                  period: str | None = TEST) -> DataFrame:
    """Many DNS connections (above ``volume_factor`` x the mean over
    hosts) with a normal up/down ratio: command and control over DNS."""
    per = _dns_per_src(B.in_period(flows, period))
    mean_conns = per.select(F.avg("conns")).scalar()
    return (per.where((F.col("conns") > mean_conns * volume_factor)
                      & F.col("ratio").between(ratio_lo, ratio_hi))
            .select("src_ip", "conns", "ratio"))


def detect_quic_exfil(flows: DataFrame, min_ratio: float = K.QUIC_MIN_RATIO,
                      period: str | None = TEST) -> DataFrame:
    """UDP/443 upload/download ratio above ``min_ratio`` (normal ~0.1)."""
    per = D.udp443_bytes_by_src(B.in_period(flows, period))
    return (per.withColumn("ratio", arith.safe_ratio("up_bytes", "down_bytes"))
            .where(F.coalesce(F.col("ratio") > min_ratio, F.lit(False))))


def detect_tcp_exfil(flows: DataFrame, min_ratio: float = K.TCP_MIN_RATIO,
                     min_edge_ratio: float = K.TCP_MIN_EDGE_RATIO,
                     period: str | None = TEST) -> DataFrame:
    """Sources whose TCP up/down ratio exceeds ``min_ratio``, then their
    TCP edges whose up/down ratio exceeds ``min_edge_ratio``, with connections
    and upload per edge."""
    tcp = B.in_period(flows, period).where(F.col("proto") == "tcp")
    edges = shared(tcp.groupBy("src_ip", "dst_ip").agg(
        flow_sum(tcp).alias("conns"), F.sum("up_bytes").alias("up_bytes"), F.sum("down_bytes").alias("down_bytes")),
        "conns", "up_bytes", "down_bytes")
    # a source's totals are sums over its edges: one scan and one shuffle of the flows
    suspects = B.having_threshold(D.ratio_by_src(edges), "ratio", min_ratio).select("src_ip")
    rated = edges.select("src_ip", "dst_ip", "conns", "up_bytes", arith.safe_ratio("up_bytes", "down_bytes").alias("ratio"))
    return rated.where(F.coalesce(F.col("ratio") > min_edge_ratio, F.lit(False))).join(suspects, "src_ip", "left_semi")


def detect_dns_exfil(flows: DataFrame, volume_factor: float = K.DNS_EXFIL_VOLUME,
                     ratio_lo: float = K.DNS_RATIO_RANGE[0], ratio_hi: float = K.DNS_RATIO_RANGE[1],
                     period: str | None = TEST) -> DataFrame:
    """Normal DNS up/down ratio but DNS upload above ``volume_factor`` x
    the mean over hosts: data leaving inside DNS queries."""
    per = _dns_per_src(B.in_period(flows, period))
    mean_up = per.select(F.avg("up_bytes")).scalar()
    return (per.where((F.col("up_bytes") > mean_up * volume_factor)
                      & F.col("ratio").between(ratio_lo, ratio_hi))
            .select("src_ip", "up_bytes", "conns", "ratio"))


def detect_new_countries(flows_cc: DataFrame) -> DataFrame:
    """Sources reaching countries absent from the baseline;
    ``n`` = distinct destinations in that country."""
    return (G.new_country_flows(flows_cc).groupBy("src_ip", "dst_cc")
            .agg(F.count(F.lit(1)).alias("n")))


def discover_servers(flows: DataFrame, net_prefix: str = net.DEFAULT_NET, k: int = K.TOP_SERVERS,
                     period: str | None = TEST) -> DataFrame:
    """The k busiest internal addresses by total activity."""
    return J.host_activity(B.in_period(flows, period), net_prefix, by=()).limit(k)


def server_roles(flows: DataFrame, net_prefix: str = net.DEFAULT_NET, k: int = K.TOP_SERVERS,
                 period: str | None = TEST) -> DataFrame:
    """R17 with roles: the k busiest internal addresses and the services
    (``proto/port``) they receive, from the traffic itself, never hard-coded
    (Q16). Two scans: the top-k activity, and the distinct services of those
    hosts, whose flows the k-row top list picks by a broadcast semi join."""
    sel = B.in_period(flows, period)
    top = discover_servers(sel, net_prefix, k, period=None)
    services = (sel.where(net.in_prefix("dst_ip", net_prefix))
                .select(F.col("dst_ip").alias("ip"),
                        F.concat_ws("/", "proto", F.col("port").cast("string")).alias("svc"))
                .join(F.broadcast(top.select("ip")), "ip", "left_semi").distinct())
    # k hosts, each with at most one row per protocol and port
    roles = services.groupBy("ip").agg(F.array_sort(F.collect_list("svc")).alias("services"))
    return top.join(roles, "ip", "left").select("ip", "flows", "services")


def burst_window(flows: DataFrame, lo: int = K.BURST_SECONDS[0], hi: int = K.BURST_SECONDS[1],
                 k: int = K.BURST_TOP,
                 period: str | None = TEST) -> DataFrame:
    """The k largest uploads with ``lo < second < hi``."""
    sel = B.time_range(B.in_period(flows, period), lo, hi)
    return sel.orderBy(F.col("up_bytes").desc(), F.col("flow_id").asc()).limit(k)


# The levels of ``level_totals``, by the bits of grouping_id() over (src_ip, dst_ip, dst_cc).
EDGE, SOURCE_COUNTRY, SOURCE, COUNTRY, NETWORK = 0b000, 0b010, 0b011, 0b110, 0b111


def level_totals(edges_cc: DataFrame, net_prefix: str = net.DEFAULT_NET, cidr: str = net.DEFAULT_CIDR,
                 transfer_countries=K.TRANSFER_COUNTRIES) -> DataFrame:
    """Totals that all detectors read, by one GROUPING SETS aggregate over an edge
    summary with ``dst_num`` and ``dst_cc``: per edge, source and country, source,
    country, and the whole network. ``level`` names the set a row belongs to; a
    total without any flow is null."""
    base, test = _is_base(), _is_test()
    inside = net.in_prefix("dst_ip", net_prefix)
    dns = test & (F.col("proto") == "udp") & (F.col("port") == 53)
    quic = test & (F.col("proto") == "udp") & (F.col("port") == 443)
    tcp = test & (F.col("proto") == "tcp")
    n, up, down = F.col(WEIGHT), F.col("up_bytes"), F.col("down_bytes")
    parts = {
        "n_normal": (base, n), "n_test": (test, n),
        "net_n_normal": (base & ~inside, n), "net_up_normal": (base & ~inside, up), "net_down_normal": (base & ~inside, down),
        "net_n_test": (test & ~inside, n), "net_up_test": (test & ~inside, up), "net_down_test": (test & ~inside, down),
        "in_n_normal": (base & inside, n), "in_n_test": (test & inside, n),
        "peer_n": (test & F.coalesce(net.in_cidr("dst_ip", cidr, F.col("dst_num")), F.lit(False)), n),
        "dns_n": (dns, n), "dns_up": (dns, up), "dns_down": (dns, down), "quic_up": (quic, up), "quic_down": (quic, down),
        "tcp_n": (tcp, n), "tcp_up": (tcp, up), "tcp_down": (tcp, down),
        "transfer_up": (test & F.col("dst_cc").isin(*transfer_countries), up),
    }
    src, dst, cc = F.col("src_ip"), F.col("dst_ip"), F.col("dst_cc")
    sets = edges_cc.groupingSets([[src, dst, cc], [src, cc], [src], [cc], []], src, dst, cc)
    return sets.agg(F.grouping_id().alias("level"), *[F.sum(F.when(cond, x)).alias(name) for name, (cond, x) in parts.items()])


def _opaque(totals: DataFrame, *keys: str) -> DataFrame:
    """``totals`` with its keys and level bound to a total, so that no reader's
    tests on them move below the aggregate: all readers share it. Every row has
    flows in one of the periods, so nothing changes."""
    exists = F.coalesce("n_normal", "n_test").isNotNull()
    return totals.withColumns({k: F.when(exists, F.col(k)) for k in keys})


def _at(totals: DataFrame, *levels: int) -> DataFrame:
    return totals.where(F.col("level").isin(*levels))


def alerts(flows: DataFrame, geo: DataFrame, net_prefix: str = net.DEFAULT_NET,
           cidr: str = net.DEFAULT_CIDR, period_factor: float = K.PERIOD_FACTOR,
           external_flows: int = K.EXTERNAL_FLOWS_THRESHOLD,
           exfil_factor: float = K.PERIOD_FACTOR, c2_min_increase: float = K.C2_MIN_INCREASE,
           c2_min_baseline: int = K.C2_MIN_BASELINE, botnet_min_fanout: int = K.MIN_FANOUT,
           max_countries: int = K.MAX_COUNTRIES, transfer_countries=K.TRANSFER_COUNTRIES,
           transfer_bytes: int = K.TRANSFER_BYTES, dns_c2_volume: float = K.DNS_C2_VOLUME,
           quic_min_ratio: float = K.QUIC_MIN_RATIO, tcp_min_ratio: float = K.TCP_MIN_RATIO,
           tcp_min_edge_ratio: float = K.TCP_MIN_EDGE_RATIO, dns_exfil_volume: float = K.DNS_EXFIL_VOLUME,
           dns_ratio_lo: float = K.DNS_RATIO_RANGE[0], dns_ratio_hi: float = K.DNS_RATIO_RANGE[1]) -> DataFrame:
    """The report of all detectors as ``(rule, subject, detail, metric, threshold)`` rows.

    ``subject`` is a source address, or the network prefix for the rules about
    the whole network (R1-R3); ``detail`` is the destination of an edge (R14) or
    the new country (R16). One lazy plan: flows (or an edge summary) are scanned
    and shuffled once into edges, each external destination is looked up once,
    one GROUPING SETS aggregate totals the edges at every level, and the rules
    read its rows.
    """
    keyed, num = net.with_addr_num(flows, "dst_ip")
    keys = ["period", "src_ip", "dst_ip", F.coalesce(num, F.lit(RJ.UNKNOWN)).alias("dst_num"), "proto", "port"]
    edges = shared(keyed.groupBy(*keys).agg(flow_sum(flows).alias(WEIGHT), F.sum("up_bytes").alias("up_bytes"),
                                            F.sum("down_bytes").alias("down_bytes")), WEIGHT, "up_bytes", "down_bytes")
    lo, hi = net.cidr_bounds(cidr)
    internal = F.col("dst_num").between(lo, hi)
    edges_cc = RJ.with_country(edges, geo, many_readers=True).withColumn("dst_cc", F.when(~internal, F.col("dst_cc")))
    raw = level_totals(edges_cc, net_prefix, cidr, transfer_countries)
    measures = [c for c in raw.columns if c not in ("src_ip", "dst_ip", "dst_cc", "level")]
    totals = _opaque(shared(raw, *measures), "src_ip", "dst_ip", "dst_cc", "level")

    # per source: its totals, its internal peers and its known countries
    own = F.col("level") == SOURCE
    per = _at(totals, SOURCE, SOURCE_COUNTRY, EDGE).groupBy("src_ip").agg(
        *[F.max(F.when(own, F.col(m))).alias(m) for m in measures],
        F.sum(F.when((F.col("level") == EDGE) & (F.col("peer_n") > 0), 1).otherwise(0)).alias("peers"),
        F.sum(F.when((F.col("level") == SOURCE_COUNTRY) & (F.col("dst_cc") != "") & (F.col("n_test") > 0), 1).otherwise(0))
        .alias("countries"))
    sources = _opaque(shared(per, *measures, "peers", "countries"), "src_ip").withColumns({
        "up_normal": arith.safe_ratio("net_up_normal", "net_n_normal"), "up_test": arith.safe_ratio("net_up_test", "net_n_test"),
        "down_normal": arith.safe_ratio("net_down_normal", "net_n_normal"), "down_test": arith.safe_ratio("net_down_test", "net_n_test"),
        "dns_ratio": arith.safe_ratio("dns_up", "dns_down")})
    col = F.col

    def mean(c: str):
        return sources.select(F.avg(c)).scalar()

    def rule(name: str, metric, threshold: float, flagged):
        return F.when(flagged, F.struct(F.lit(name).alias("rule"), F.lit(None).cast("string").alias("detail"),
                                        metric.cast("double").alias("metric"), F.lit(float(threshold)).alias("threshold")))

    growth = arith.pct_increase(F.coalesce("in_n_normal", F.lit(0)), F.coalesce("in_n_test", F.lit(0)))
    normal_dns = col("dns_ratio").between(dns_ratio_lo, dns_ratio_hi)
    quic = arith.safe_ratio("quic_up", "quic_down")
    by_source = F.array(
        rule("exfiltration", F.greatest(arith.safe_ratio("up_test", "up_normal"), arith.safe_ratio("down_test", "down_normal")),
             exfil_factor, (col("up_test") > col("up_normal") * exfil_factor) | (col("down_test") > col("down_normal") * exfil_factor)),
        rule("c2_growth", growth, c2_min_increase, (growth > c2_min_increase) & (col("in_n_normal") > c2_min_baseline)),
        rule("botnet", col("peers"), botnet_min_fanout, col("peers") > botnet_min_fanout),
        rule("many_countries", col("countries"), max_countries, col("countries") > max_countries),
        rule("country_transfer", col("transfer_up"), transfer_bytes, col("transfer_up") > transfer_bytes),
        rule("dns_c2", col("dns_n"), dns_c2_volume, (col("dns_n") > mean("dns_n") * dns_c2_volume) & normal_dns),
        rule("quic_exfil", quic, quic_min_ratio, quic > quic_min_ratio),
        rule("dns_exfil", col("dns_up"), dns_exfil_volume, (col("dns_up") > mean("dns_up") * dns_exfil_volume) & normal_dns))
    columns = [col("r.rule").alias("rule"), "subject", col("r.detail").alias("detail"), col("r.metric").alias("metric"),
               col("r.threshold").alias("threshold")]

    def rows(df: DataFrame, subject, rules) -> DataFrame:
        return (df.select(subject.alias("subject"), rules.alias("rules")).select("subject", F.explode("rules").alias("r"))
                .where(col("r").isNotNull()).select(*columns))

    # over the network: means over its sources, and its total
    means = sources.agg(*[F.avg(c).alias(c) for c in ("up_normal", "up_test", "down_normal", "down_test")],
                        F.sum("net_n_test").alias("external"))
    by_network = F.array(
        rule("high_upload", arith.safe_ratio("up_test", "up_normal"), period_factor, col("up_test") > col("up_normal") * period_factor),
        rule("high_download", arith.safe_ratio("down_test", "down_normal"), period_factor,
             col("down_test") > col("down_normal") * period_factor),
        rule("external_connections", col("external"), external_flows, col("external") > external_flows))

    # edges of sources that upload much by TCP; a null source never matches
    suspects = sources.where(arith.safe_ratio("tcp_up", "tcp_down") > tcp_min_ratio).select("src_ip")
    ratio = arith.safe_ratio("tcp_up", "tcp_down")
    tcp = _at(totals, EDGE).where(ratio > tcp_min_edge_ratio).join(suspects, "src_ip", "left_semi")
    new = (_at(totals, COUNTRY).where((col("n_test") > 0) & col("n_normal").isNull() & col("dst_cc").isNotNull()).select("dst_cc"))
    reached = (_at(totals, EDGE).where(col("n_test") > 0).join(new, "dst_cc", "left_semi")
               .groupBy("src_ip", "dst_cc").agg(F.count(F.lit(1)).alias("n")))
    out = ["rule", "subject", "detail", "metric", "threshold"]
    return (rows(sources, col("src_ip"), by_source)
            .unionByName(rows(means, F.lit(net_prefix), by_network))
            .unionByName(tcp.select(F.lit("tcp_exfil").alias("rule"), col("src_ip").alias("subject"), col("dst_ip").alias("detail"),
                                    ratio.alias("metric"), F.lit(float(tcp_min_edge_ratio)).alias("threshold")))
            .unionByName(reached.select(F.lit("new_country").alias("rule"), col("src_ip").alias("subject"), col("dst_cc").alias("detail"),
                                        col("n").cast("double").alias("metric"), F.lit(0.0).alias("threshold")))
            .select(*out))


#: Rules whose subject is an address (the others are about the whole network).
ADDRESS_RULES = ("exfiltration", "c2_growth", "botnet", "many_countries", "country_transfer", "dns_c2",
                 "quic_exfil", "dns_exfil", "tcp_exfil", "new_country")


def address_detections(report: DataFrame) -> DataFrame:
    """``(ip, reason)`` of every address that a report of ``alerts`` names."""
    return (report.where(F.col("rule").isin(*ADDRESS_RULES) & F.col("subject").isNotNull())
            .select(F.col("subject").alias("ip"), F.col("rule").alias("reason")).distinct())
