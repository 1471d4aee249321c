"""IPv4 column expressions (H5, H6, H11 and the four notions of "internal").

Everything is a built-in Catalyst expression: no Python runs per row, and the
prefix predicates reach the Parquet reader as pushed filters.
"""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import as_col

from ..defaults import INTERNAL_CIDR as DEFAULT_CIDR
from ..defaults import INTERNAL_PREFIX as DEFAULT_NET

# The RFC 1918 prefix list of the internal-services query.
RFC1918_PREFIXES = (
    "192.168.", "10.", "172.16.", "172.17.", "172.18.", "172.19.", "172.20.",
    "172.21.", "172.22.", "172.23.", "172.24.", "172.25.", "172.26.", "172.27.",
    "172.28.", "172.29.", "172.30.", "172.31.",
)

# Networks CPython's ipaddress.IPv4Address.is_private treats as
# private (N4), and the two addresses it carves out of 192.0.0.0/24.
PRIVATE_NETWORKS = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
    "255.255.255.255/32",
)
PRIVATE_EXCEPTIONS = ("192.0.0.9", "192.0.0.10")

# four decimal octets without leading zeros (CPython rejects "01.2.3.4")
_OCTET = r"(0|[1-9][0-9]{0,2})"
_DOTTED_QUAD = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def cidr_bounds(cidr: str) -> tuple[int, int]:
    """Inclusive integer bounds of a CIDR block (parsed once, on the driver)."""
    net = ipaddress.IPv4Network(cidr, strict=False)
    return int(net.network_address), int(net.broadcast_address)


def ip_to_num(ip) -> Column:
    """Dotted quad -> BIGINT; malformed text or an octet above 255 -> null (Q12)."""
    ip = as_col(ip)
    parts = F.split(ip, r"\.")
    octets = [F.try_element_at(parts, F.lit(i)).try_cast("bigint") for i in range(1, 5)]
    value = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    in_range = reduce(lambda a, b: a & b, [o <= 255 for o in octets])
    return F.when(ip.rlike(_DOTTED_QUAD), F.when(in_range, value))


def num_to_ip(num) -> Column:
    num = as_col(num)
    parts = [F.shiftright(num, s) % 256 for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *[p.cast("string") for p in parts])


def addr_num(df, ip: str) -> Column:
    """The integer form of address column ``ip``: the stored ``<ip>_num``
    column when the frame has one (parsed once at ingest), else parsed here."""
    stored = f"{ip}_num"
    return F.col(stored) if stored in df.columns else ip_to_num(ip)


def with_addr_num(df, ip: str):
    """``(frame, column)``: the frame with ``<ip>_num`` parsed once if it is not
    stored, and that column. A projected column is evaluated once per row even
    when many predicates read it (Catalyst does not inline a non-trivial
    expression that is referenced several times)."""
    stored = f"{ip}_num"
    if stored not in df.columns:
        df = df.withColumn(stored, ip_to_num(ip))
    return df, F.col(stored)


def in_cidr(ip, cidr: str = DEFAULT_CIDR, num: Column | None = None) -> Column:
    """Address arithmetic; null for a malformed address."""
    lo, hi = cidr_bounds(cidr)
    return (ip_to_num(ip) if num is None else num).between(lo, hi)


def in_prefix(ip, prefix: str = DEFAULT_NET) -> Column:
    """Textual prefix test, pushed down to Parquet as StringStartsWith."""
    return as_col(ip).startswith(prefix)


def startswith_any(ip, prefixes=RFC1918_PREFIXES) -> Column:
    """OR of prefix tests, folded from a list."""
    ip = as_col(ip)
    return reduce(lambda a, b: a | b, [ip.startswith(p) for p in prefixes])


def is_private(ip, num: Column | None = None) -> Column:
    """The CPython ``is_private`` ranges as one OR of integer ranges."""
    num = ip_to_num(ip) if num is None else num
    ranges = [num.between(*cidr_bounds(c)) for c in PRIVATE_NETWORKS]
    carved = num.isin(*[int(ipaddress.IPv4Address(a)) for a in PRIVATE_EXCEPTIONS])
    return reduce(lambda a, b: a | b, ranges) & ~carved


def outside_cidr(num: Column, cidr: str = DEFAULT_CIDR) -> Column:
    """Not in ``cidr``; a malformed address (null) is outside. Plain comparisons,
    so that the test reaches the Parquet scan on a stored address column."""
    lo, hi = cidr_bounds(cidr)
    return num.isNull() | (num < lo) | (num > hi)


def is_public(ip, cidr: str = DEFAULT_CIDR, num: Column | None = None) -> Column:
    """B10 ``pub``: not in the internal CIDR; malformed text counts as public."""
    return outside_cidr(ip_to_num(ip) if num is None else num, cidr)


def ptr_name(ip) -> Column:
    """H6: reverse pointer name, ``d.c.b.a.in-addr.arpa``."""
    return F.concat(F.array_join(F.reverse(F.split(as_col(ip), r"\.")), "."), F.lit(".in-addr.arpa"))


def first_octet(ip) -> Column:
    return F.shiftright(ip_to_num(ip), 24)
