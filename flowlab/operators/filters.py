"""Projections and predicates.

Each function is a lazy ``DataFrame -> DataFrame`` step. Equality, ``IN``,
prefix, OR-of-prefix and negated-prefix predicates reach the Parquet scan as
pushed filters when ``flows`` is a stored dataset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import net, timeparts


def in_period(flows: DataFrame, period: str | None) -> DataFrame:
    return flows if period is None else flows.where(F.col("period") == period)


def udp_flows(flows: DataFrame) -> DataFrame:
    """B1."""
    return flows.where(F.col("proto") == "udp")


def port_flows(flows: DataFrame, port: int = 443) -> DataFrame:
    """B2."""
    return flows.where(F.col("port") == port)


def proto_port_flows(flows: DataFrame, proto: str = "udp", port: int = 443) -> DataFrame:
    """B3."""
    return flows.where((F.col("proto") == proto) & (F.col("port") == port))


def port_non_proto_flows(flows: DataFrame, port: int, proto: str = "udp") -> DataFrame:
    """Flows on ``port`` that do not use ``proto``."""
    return flows.where((F.col("proto") != proto) & (F.col("port") == port))


def port_protocol_check(flows: DataFrame, port: int, proto: str = "udp") -> DataFrame:
    """B4/B5 as a verdict: one row ``(port, proto, violations, violated)``.

    A global count with partial aggregation: each task sends one number.
    """
    bad = port_non_proto_flows(flows, port, proto)
    return bad.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(port).cast("int").alias("port"), F.lit(proto).alias("proto"),
        "violations", (F.col("violations") > 0).alias("violated"))


def internal_flows(flows: DataFrame, net_prefix: str = net.DEFAULT_NET) -> DataFrame:
    """Source and destination both inside the network."""
    return flows.where(net.in_prefix("src_ip", net_prefix) & net.in_prefix("dst_ip", net_prefix))


def external_flows(flows: DataFrame, net_prefix: str = net.DEFAULT_NET) -> DataFrame:
    """Internal source, external destination."""
    return flows.where(net.in_prefix("src_ip", net_prefix) & ~net.in_prefix("dst_ip", net_prefix))


def to_internet_flows(flows: DataFrame, net_prefix: str = net.DEFAULT_NET) -> DataFrame:
    """Destination outside the network, any source."""
    return flows.where(~net.in_prefix("dst_ip", net_prefix))


def rfc1918_flows(flows: DataFrame, prefixes=net.RFC1918_PREFIXES) -> DataFrame:
    """Destination in a prefix list."""
    return flows.where(net.startswith_any("dst_ip", prefixes))


def public_flag(flows: DataFrame, cidr: str = net.DEFAULT_CIDR) -> DataFrame:
    """Append ``pub`` (destination outside ``cidr`` by address arithmetic)."""
    return flows.withColumn("pub", net.is_public("dst_ip", cidr, net.addr_num(flows, "dst_ip")))


def private_split(flows: DataFrame) -> DataFrame:
    """``(flow_id, is_private)`` by the CPython ``is_private`` ranges."""
    parsed, dnum = net.with_addr_num(flows, "dst_ip")
    return parsed.select("flow_id", net.is_private("dst_ip", dnum).alias("is_private"))


def host_in_list(flows: DataFrame, col: str, hosts, flag=None) -> DataFrame:
    """``col IN hosts`` (AND an optional boolean column)."""
    cond = F.col(col).isin(*hosts)
    if flag is not None:
        cond = cond & (F.col(flag) if isinstance(flag, str) else flag)
    return flows.where(cond)


def host_or_chain(flows: DataFrame, hosts, cidr: str = net.DEFAULT_CIDR) -> DataFrame:
    """The reference's OR chain of equalities AND not public, as ``IN``."""
    return flows.where(F.col("src_ip").isin(*hosts) & net.in_cidr("dst_ip", cidr, net.addr_num(flows, "dst_ip")))


def time_range(flows: DataFrame, lo: int, hi: int) -> DataFrame:
    """``lo < seconds < hi``, both bounds exclusive.

    Written on the raw tick column so that Parquet can prune row groups:
    ``sec > lo`` is ``ts >= (lo + 1) * 100`` and ``sec < hi`` is ``ts < hi * 100``
    for non-negative ticks.
    """
    ts = F.col("timestamp")
    return flows.where((ts >= (lo + 1) * timeparts.TICKS_PER_SECOND) & (ts < hi * timeparts.TICKS_PER_SECOND))


def having_threshold(agg: DataFrame, col: str, threshold, op: str = ">") -> DataFrame:
    """Threshold on an aggregate column."""
    c = F.col(col)
    cond = {">": c > threshold, ">=": c >= threshold, "<": c < threshold, "<=": c <= threshold}[op]
    return agg.where(cond)


def project_columns(flows: DataFrame, *cols: str) -> DataFrame:
    """B16."""
    return flows.select(*cols)


def rename_agg(agg: DataFrame, old: str, new: str) -> DataFrame:
    """B17."""
    return agg.withColumnRenamed(old, new)


def fill_zero(df: DataFrame, *cols: str) -> DataFrame:
    """Null -> 0 after an outer join."""
    return df.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in cols else F.col(c) for c in df.columns])


def drop_null_cc(df: DataFrame, col: str = "dst_cc") -> DataFrame:
    """Drop rows without a country (internal destinations)."""
    return df.dropna(subset=[col])
