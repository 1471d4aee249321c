"""Column expressions: IPv4 arithmetic, timestamp parts and safe ratios."""

from .arith import nan_to_null, pct_increase, per_flow, round6, safe_ratio
from .common import as_col, idiv
from .net import (
    DEFAULT_CIDR, DEFAULT_NET, PRIVATE_NETWORKS, RFC1918_PREFIXES, addr_num, cidr_bounds,
    first_octet, in_cidr, in_prefix, ip_to_num, is_private, is_public, num_to_ip,
    ptr_name, startswith_any,
)
from .timeparts import hour_of_day, minute_of_day, ts_seconds, ts_to_hours

__all__ = [
    "as_col", "idiv", "safe_ratio", "pct_increase", "per_flow", "nan_to_null", "round6",
    "DEFAULT_CIDR", "DEFAULT_NET", "PRIVATE_NETWORKS", "RFC1918_PREFIXES", "addr_num", "cidr_bounds",
    "first_octet", "in_cidr", "in_prefix", "ip_to_num", "is_private", "is_public",
    "num_to_ip", "ptr_name", "startswith_any",
    "hour_of_day", "minute_of_day", "ts_seconds", "ts_to_hours",
]
