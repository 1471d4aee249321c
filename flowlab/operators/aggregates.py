"""Aggregations.

All are hash aggregates with partial (map-side) aggregation: a key that holds
a third of all flows still sends one row per task to the shuffle. Distinct
counts de-duplicate ``(key, value)`` pairs in the same way before the final
count. Ratios go through ``safe_ratio`` (ANSI stays on).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import defaults as K
from ..functions import arith, net, timeparts
from ..functions.common import idiv
from . import filters as B

# Columns the reference counts with ``groupby(...).count()`` (its parquet has no
# flow_id or period column).
COUNTED_COLUMNS = ("timestamp", "dst_ip", "proto", "port", "up_bytes", "down_bytes")

DNS_PROTO, DNS_PORT = "udp", 53

# Each period is a capture with a clock of its own, so its hours, seconds and
# hosts are kept apart; ``by=()`` adds the periods up.
PER_PERIOD = ("period",)


def _dns(flows: DataFrame) -> DataFrame:
    return B.proto_port_flows(flows, DNS_PROTO, DNS_PORT)


def _restrict(flows: DataFrame, col: str, values) -> DataFrame:
    """``col IN values``: a literal list, or a semi join against a frame.

    A frame of values is derived data of unknown size; the semi join lets AQE
    broadcast it only when its measured size is below the threshold.
    """
    if values is None:
        return flows
    if isinstance(values, DataFrame):
        v = values.select(F.col(values.columns[0]).alias(col)).distinct()
        return flows.join(v, col, "left_semi")
    return flows.where(F.col(col).isin(*values))


def _to_internal(flows: DataFrame, cidr: str) -> DataFrame:
    """Flows whose destination lies in ``cidr`` (N1, on the stored integer address)."""
    return flows.where(net.in_cidr("dst_ip", cidr, net.addr_num(flows, "dst_ip")))


def count_by(df: DataFrame, keys, name: str = "n", counted: str | None = None) -> DataFrame:
    agg = F.count(counted) if counted else F.count(F.lit(1))
    return df.groupBy(*keys).agg(agg.alias(name))


def sum_by(df: DataFrame, keys, cols=("up_bytes", "down_bytes")) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in cols])


def ratio_by(df: DataFrame, keys, num: str = "up_bytes", den: str = "down_bytes",
             name: str = "ratio") -> DataFrame:
    return df.groupBy(*keys).agg(
        arith.safe_ratio(F.sum(num), F.sum(den)).alias(name))


# --- per-source counts and sums (sample scripts) ---------------------------------

def udp_count_by_src(flows: DataFrame) -> DataFrame:
    """UDP flows per source (non-null ``up_bytes``)."""
    return count_by(B.udp_flows(flows), ["src_ip"], counted="up_bytes")


def udp443_count_by_src(flows: DataFrame) -> DataFrame:
    """D2."""
    return count_by(B.proto_port_flows(flows, "udp", 443), ["src_ip"], counted="up_bytes")


def avg_down_by_src(flows: DataFrame) -> DataFrame:
    """D3: mean downloaded bytes per flow (the reference calls it ``avgUp``, Q6)."""
    return flows.groupBy("src_ip").agg(F.avg("down_bytes").alias("avg_down"))


def up443_by_src(flows: DataFrame, port: int = 443) -> DataFrame:
    """Uploaded bytes on ``port`` per source, largest first."""
    return (sum_by(B.port_flows(flows, port), ["src_ip"], ["up_bytes"])
            .orderBy(F.col("up_bytes").desc(), "src_ip"))


def down_up_ratio_443(flows: DataFrame, port: int = 443) -> DataFrame:
    """``sum(down) / sum(up)`` on ``port`` (labelled up/down there, Q6)."""
    return ratio_by(B.port_flows(flows, port), ["src_ip"], num="down_bytes", den="up_bytes")


def histogram(values: DataFrame, col: str, bins: int = K.HISTOGRAM_BINS, by=()) -> DataFrame:
    """``bins`` equal-width bins over ``[min, max]``, last bin closed (Q9),
    for each value of the ``by`` columns if there are any (null is none).

    One lazy plan: the bounds and the binning read the same ``values``, whose
    aggregate they share, bin numbers are exact integer divisions, and the
    bounds (one row, or one per ``by`` value) also make the table of edges, on
    which empty bins appear. With min = max the edges are ``min - 0.5 .. max +
    0.5`` as in numpy, so every value falls in the middle bin.
    """
    x, by = F.col(col), list(by)
    known = reduce(lambda df, c: df.where(F.col(c).isNotNull()), [*by, col], values).select(*by, col)
    bounds = known.groupBy(*by).agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"))
    if by:
        bounded = known.join(F.broadcast(bounds), by)  # one row per period
    else:
        bounded = known.withColumns({"_mn": bounds.select("_mn").scalar(), "_mx": bounds.select("_mx").scalar()})
    mn, mx = F.col("_mn"), F.col("_mx")
    one_value = mn == mx
    bin_no = F.when(one_value, bins // 2).otherwise(
        F.least(idiv((x - mn) * bins, F.when(~one_value, mx - mn)), F.lit(bins - 1))).cast("int")
    counts = bounded.groupBy(*by, bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    first = F.when(one_value, mn - 0.5).otherwise(mn.cast("double"))
    width = F.when(one_value, 1.0 / bins).otherwise((mx - mn).cast("double") / bins)
    i = F.col("bin")
    edges = bounds.select(*by, first.alias("_first"), width.alias("_width"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    edges = edges.select(*by, "bin", (F.col("_first") + i * F.col("_width")).alias("lo"), (F.col("_first") + (i + 1) * F.col("_width")).alias("hi"))
    return edges.join(counts, [*by, "bin"], "left").select(*by, "bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def up443_histogram(flows: DataFrame, bins: int = K.HISTOGRAM_BINS) -> DataFrame:
    """Histogram of D4."""
    return histogram(sum_by(B.port_flows(flows, 443), ["src_ip"], ["up_bytes"]), "up_bytes", bins)


def count_columns_by_src(flows: DataFrame, cols=COUNTED_COLUMNS) -> DataFrame:
    """``groupby('src_ip').count()``: non-null count of every other column."""
    return flows.groupBy("src_ip").agg(*[F.count(c).alias(f"n_{c}") for c in cols])


def internal_udp_by_src(flows: DataFrame, net_prefix: str = net.DEFAULT_NET) -> DataFrame:
    """D7."""
    return count_columns_by_src(B.udp_flows(B.internal_flows(flows, net_prefix)))


def internal_tcp_by_src(flows: DataFrame, net_prefix: str = net.DEFAULT_NET) -> DataFrame:
    """D8."""
    return count_columns_by_src(B.internal_flows(flows, net_prefix).where(F.col("proto") == "tcp"))


def external_udp_by_src(flows: DataFrame, net_prefix: str = net.DEFAULT_NET) -> DataFrame:
    """D9."""
    return count_columns_by_src(B.udp_flows(B.external_flows(flows, net_prefix)))


def mean_flows_per_host(flows: DataFrame, net_prefix: str = net.DEFAULT_NET) -> DataFrame:
    """Mean over internal sources of their flow count."""
    per_src = count_by(flows.where(net.in_prefix("src_ip", net_prefix)), ["src_ip"])
    return per_src.agg(F.avg("n").alias("mean_flows"))


def proto_frequency(flows: DataFrame) -> DataFrame:
    """D11."""
    return count_by(flows, ["proto"])


def port_frequency(flows: DataFrame) -> DataFrame:
    """D12."""
    return count_by(flows, ["port"])


def distinct_dst(flows: DataFrame) -> DataFrame:
    """D13."""
    return flows.select("dst_ip").distinct()


def distinct_countries(flows_cc: DataFrame) -> DataFrame:
    """Distinct destination countries of flows enriched by J6; internal
    (null) dropped, unknown ('') kept."""
    return B.drop_null_cc(flows_cc.select("dst_cc")).distinct()


def distinct_orgs(flows_org: DataFrame) -> DataFrame:
    """Distinct organisations of flows enriched by J7 (null included,
    as ``unique()`` keeps it)."""
    return flows_org.select("dst_org").distinct()


def internal_services(flows: DataFrame, prefixes=net.RFC1918_PREFIXES) -> DataFrame:
    """Per internal (dst_ip, port): bytes and connections, busiest first."""
    return (B.rfc1918_flows(flows, prefixes).groupBy("dst_ip", "port")
            .agg(F.sum("up_bytes").alias("up_bytes"), F.sum("down_bytes").alias("down_bytes"),
                 F.count("dst_ip").alias("connections"))
            .orderBy(F.col("connections").desc(), "dst_ip", "port"))


def internal_services_mean(flows: DataFrame, prefixes=net.RFC1918_PREFIXES) -> DataFrame:
    """Mean over services of D17's sums."""
    return internal_services(flows, prefixes).agg(
        F.avg("up_bytes").alias("mean_up"), F.avg("down_bytes").alias("mean_down"))


def hourly_bytes(flows: DataFrame, by=PER_PERIOD) -> DataFrame:
    """Bytes per hour of day (H2)."""
    return sum_by(flows.withColumn("hour", timeparts.hour_of_day("timestamp")), [*by, "hour"])


def internal_dst_count(flows: DataFrame, cidr: str = net.DEFAULT_CIDR) -> DataFrame:
    """Flows per internal destination (``count('proto')``)."""
    inside = _to_internal(flows, cidr)
    return count_by(inside, ["dst_ip"], counted="proto")


def internal_fanout(flows: DataFrame, cidr: str = net.DEFAULT_CIDR, hosts=None) -> DataFrame:
    """Distinct internal destinations per source."""
    inside = _restrict(_to_internal(flows, cidr), "src_ip", hosts)
    return inside.groupBy("src_ip").agg(F.count_distinct("dst_ip").alias("n_peers"))


def internal_peers(flows: DataFrame, cidr: str = net.DEFAULT_CIDR, hosts=None) -> DataFrame:
    """The internal destinations of each source (Q11), one row per
    ``(src_ip, peer)``, so a source's peers never gather in one task however
    wide the network is."""
    inside = _restrict(_to_internal(flows, cidr), "src_ip", hosts)
    return inside.select("src_ip", F.col("dst_ip").alias("peer")).distinct()


def dns_up_by_dst(flows: DataFrame) -> DataFrame:
    """Bytes and connections to each UDP/53 destination (finds resolvers)."""
    return _dns(flows).groupBy("dst_ip").agg(
        F.sum("up_bytes").alias("up_bytes"), F.count(F.lit(1)).alias("conns"))


def resolvers(flows: DataFrame) -> DataFrame:
    """Destinations of UDP/53 traffic: the DNS servers, from ports (Q16)."""
    return _dns(flows).select(F.col("dst_ip").alias("server")).distinct()


def server_bytes_by_src(flows: DataFrame, servers) -> DataFrame:
    """Up and down bytes to a server list, per source."""
    return sum_by(_restrict(flows, "dst_ip", servers), ["src_ip"])


def server_conns_by_src(flows: DataFrame, servers) -> DataFrame:
    """Connections to a server list, per source."""
    return count_by(_restrict(flows, "dst_ip", servers), ["src_ip"], name="conns", counted="dst_ip")


def server_ratio_by_src_dst(flows: DataFrame, servers, hosts) -> DataFrame:
    """up/down per (source, server) for chosen hosts and servers."""
    sel = _restrict(_restrict(flows, "dst_ip", servers), "src_ip", hosts)
    return ratio_by(sel, ["src_ip", "dst_ip"])


def ratio_by_src(flows: DataFrame, where=None) -> DataFrame:
    """up/down per source; ``where`` selects the variant (TCP, UDP/443...)."""
    return ratio_by(flows if where is None else flows.where(where), ["src_ip"])


def ratio_by_src_dst(flows: DataFrame, hosts=None, where=None) -> DataFrame:
    """up/down per edge for chosen sources."""
    sel = _restrict(flows if where is None else flows.where(where), "src_ip", hosts)
    return ratio_by(sel, ["src_ip", "dst_ip"])


def edge_conns_bytes(flows: DataFrame, where=None) -> DataFrame:
    """Per (src, dst): connections and uploaded bytes."""
    sel = flows if where is None else flows.where(where)
    return sel.groupBy("src_ip", "dst_ip").agg(
        F.count("dst_ip").alias("conns"), F.sum("up_bytes").alias("up_bytes"))


def edge_conns_public(flows: DataFrame, hosts=None, cidr: str = net.DEFAULT_CIDR) -> DataFrame:
    """Per (src, dst): connections to public addresses."""
    sel = _restrict(flows.where(net.is_public("dst_ip", cidr, net.addr_num(flows, "dst_ip"))), "src_ip", hosts)
    return count_by(sel, ["src_ip", "dst_ip"], name="conns", counted="port")


def edge_bytes(flows: DataFrame, hosts=None) -> DataFrame:
    """Per (src, dst): up and down sums for chosen sources."""
    return sum_by(_restrict(flows, "src_ip", hosts), ["src_ip", "dst_ip"])


def dns_mean_by_src(flows: DataFrame, servers) -> DataFrame:
    """Mean up/down bytes per flow to the resolvers."""
    return _restrict(flows, "dst_ip", servers).groupBy("src_ip").agg(
        F.avg("up_bytes").alias("avg_up"), F.avg("down_bytes").alias("avg_down"))


def dst_count_for_hosts(flows: DataFrame, hosts) -> DataFrame:
    """Which destinations the chosen sources contact most."""
    return count_by(_restrict(flows, "src_ip", hosts), ["dst_ip"], counted="up_bytes")


def dns_count_by_src(flows: DataFrame) -> DataFrame:
    """UDP/53 flows per source."""
    return count_by(_dns(flows), ["src_ip"], counted="up_bytes")


def dns_up_by_src(flows: DataFrame, servers=None, hosts=None) -> DataFrame:
    """Uploaded bytes per source by UDP/53 or, where a list of ``servers`` is
    given, to those servers on any port; optionally of chosen hosts only."""
    sel = _dns(flows) if servers is None else _restrict(flows, "dst_ip", servers)
    return sum_by(_restrict(sel, "src_ip", hosts), ["src_ip"], ["up_bytes"])


def udp443_bytes_by_src(flows: DataFrame) -> DataFrame:
    """Up and down bytes on UDP/443 per source."""
    return sum_by(B.proto_port_flows(flows, "udp", 443), ["src_ip"])


def host_profile(flows: DataFrame) -> DataFrame:
    """Per-source profile in one keyed aggregate (Q1 fixed: no positional
    alignment; a host without e.g. UDP flows gets 0, not a neighbour's value)."""
    flows, dnum = net.with_addr_num(flows, "dst_ip")
    private = net.is_private("dst_ip", dnum)
    n = F.count(F.lit(1))
    agg = flows.groupBy("src_ip").agg(
        n.alias("flows"),
        F.count_if(~private).alias("flows_to_internet"),
        F.count_if(private).alias("flows_to_private_ips"),
        F.sum("up_bytes").alias("total_up_bytes"),
        F.sum("down_bytes").alias("total_down_bytes"),
        F.count_if(F.col("proto") == "udp").alias("_udp"),
        F.count_if(F.col("proto") == "tcp").alias("_tcp"),
    )
    return agg.select(
        "src_ip", "flows", "flows_to_internet", "flows_to_private_ips", "total_up_bytes",
        "total_down_bytes",
        arith.per_flow("total_up_bytes", "flows").alias("up_bytes_per_flow"),
        arith.per_flow("total_down_bytes", "flows").alias("down_bytes_per_flow"),
        arith.per_flow("_udp", "flows").alias("udp_share"),
        arith.per_flow("_tcp", "flows").alias("tcp_share"),
    )


def bytes_by_minute(flows: DataFrame, by=PER_PERIOD) -> DataFrame:
    """Bytes per ``HH:MM`` of day (at most 1,440 groups a period)."""
    return sum_by(flows.withColumn("minute", timeparts.minute_of_day("timestamp")), [*by, "minute"])


def _with_instant(flows: DataFrame, unit: str) -> DataFrame:
    return flows.withColumn(unit, timeparts.ts_seconds("timestamp") if unit == "second" else F.col("timestamp"))


def bytes_by_second(flows: DataFrame, unit: str = "second", by=PER_PERIOD) -> DataFrame:
    """Uploaded bytes per whole second, or per raw tick (``unit='tick'``)."""
    return sum_by(_with_instant(flows, unit), [*by, unit], ["up_bytes"])


def conns_by_second(flows: DataFrame, unit: str = "second", by=PER_PERIOD) -> DataFrame:
    """Flows per second (or per tick)."""
    return count_by(_with_instant(flows, unit), [*by, unit], counted="up_bytes")


def up_by_minute(flows: DataFrame, by=PER_PERIOD) -> DataFrame:
    """Uploaded bytes per minute (labelled "connections" there, Q6)."""
    return sum_by(flows.withColumn("minute", timeparts.minute_of_day("timestamp")), [*by, "minute"], ["up_bytes"])


def dst_up_with_sources(flows: DataFrame, k: int = K.TOP_DESTINATIONS) -> DataFrame:
    """The ``k`` destinations with most upload, each with its sources.

    One row per (destination, distinct source) instead of a list per
    destination: a popular destination may have any number of sources, and a
    list would gather them all in one task. The k destinations come from a
    top-k (no global sort) and reach the flows as a k-row broadcast.
    """
    per_dst = sum_by(flows, ["dst_ip"], ["up_bytes"])
    top = per_dst.orderBy(F.col("up_bytes").desc(), "dst_ip").limit(k)
    # the inner join with the k-row broadcast both filters and attaches the sums
    return (flows.select("dst_ip", "src_ip").join(F.broadcast(top), "dst_ip")
            .select("dst_ip", "up_bytes", "src_ip").distinct())


def country_frequency(new_country_flows: DataFrame) -> DataFrame:
    """Connections per new country over distinct (src, dst, cc) rows."""
    return count_by(new_country_flows, ["dst_cc"])


def country_fanout(flows_cc: DataFrame) -> DataFrame:
    """Distinct known countries per source (internal and unknown excluded)."""
    known = flows_cc.where(F.col("dst_cc") != "")
    return known.groupBy("src_ip").agg(F.count_distinct("dst_cc").alias("n_countries"))


def country_bytes(flows_cc: DataFrame, countries=K.TRANSFER_COUNTRIES) -> DataFrame:
    """Uploaded bytes per source to listed countries."""
    return sum_by(flows_cc.where(F.col("dst_cc").isin(*countries)), ["src_ip"], ["up_bytes"])


def internet_bytes_by_src(flows: DataFrame, net_prefix: str = net.DEFAULT_NET, by=PER_PERIOD) -> DataFrame:
    """D46."""
    return sum_by(B.to_internet_flows(flows, net_prefix), [*by, "src_ip"])


def internet_flows_by_src(flows: DataFrame, net_prefix: str = net.DEFAULT_NET, by=PER_PERIOD) -> DataFrame:
    """D47."""
    return count_by(B.to_internet_flows(flows, net_prefix), [*by, "src_ip"], name="counts")


def country_count(flows_cc: DataFrame) -> DataFrame:
    """Countries seen; null skipped, '' counted (section 1.5)."""
    return flows_cc.agg(F.count_distinct("dst_cc").alias("n_countries"))


def upload_histogram_time(flows: DataFrame, bins: int = K.HISTOGRAM_BINS, by=PER_PERIOD) -> DataFrame:
    """Histogram of the per-tick upload sums."""
    return histogram(bytes_by_second(flows, unit="tick", by=by), "up_bytes", bins, by=by)


def address_quarantine(flows: DataFrame) -> DataFrame:
    """Q12: flows whose source or destination is not a valid dotted quad (their
    address number is null; every predicate treats them as external). One row:
    ``flows, bad_src, bad_dst``; a global count, one partial row per task."""
    src = net.addr_num(flows, "src_ip")
    dst = net.addr_num(flows, "dst_ip")
    return flows.agg(F.count(F.lit(1)).alias("flows"),
                     F.count_if(src.isNull()).alias("bad_src"),
                     F.count_if(dst.isNull()).alias("bad_dst"))
