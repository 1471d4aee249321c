"""DuckDB oracle: for each registered query, the same result in plain SQL.

Each text starts from the raw ``events`` view through the flows adapter
(``oracle_base.FLOWS_SQL``). Conventions: sums and counts BIGINT, averages
and ratios ``round(x, 6)``, lists ``array_to_string(list_sort(...), ',')``.
"""

from __future__ import annotations

from ..functions.net import PRIVATE_EXCEPTIONS, PRIVATE_NETWORKS, RFC1918_PREFIXES, cidr_bounds
from .catalog import DNS_SUSPECTS, PEER_SUSPECTS, TCP_SUSPECTS
from .oracle_base import ASN_SQL, NESTED_SQL, ip_num_sql, with_flows, with_flows_cc

NET_LO, NET_HI = cidr_bounds("192.168.109.0/24")
FLOW_COLS = "flow_id, period, timestamp, src_ip, dst_ip, proto, port, up_bytes, down_bytes"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _ratio(num: str, den: str) -> str:
    """pandas division: x/0 -> +-inf, 0/0 -> null (NaN)."""
    return (f"round(CASE WHEN {den} <> 0 THEN CAST({num} AS DOUBLE) / {den} "
            f"WHEN {num} > 0 THEN 'inf'::DOUBLE WHEN {num} < 0 THEN '-inf'::DOUBLE END, 6)")


def _is_private(col: str) -> str:
    num = ip_num_sql(col)
    ranges = " OR ".join(f"{num} BETWEEN {lo} AND {hi}" for lo, hi in map(cidr_bounds, PRIVATE_NETWORKS))
    import ipaddress
    exc = ", ".join(str(int(ipaddress.IPv4Address(a))) for a in PRIVATE_EXCEPTIONS)
    return f"(({ranges}) AND NOT ({num} IN ({exc})))"


RFC1918_SQL = "(" + " OR ".join(f"starts_with(dst_ip, '{p}')" for p in RFC1918_PREFIXES) + ")"
INTERNET = "NOT starts_with(dst_ip, '192.168.109.')"
DNS = "proto = 'udp' AND port = 53"
PUB = f"NOT coalesce({ip_num_sql('dst_ip')} BETWEEN {NET_LO} AND {NET_HI}, false)"
HOUR = "printf('%02d', ((timestamp // 100) // 3600) % 24)"
MINUTE = "printf('%02d:%02d', ((timestamp // 100) // 3600) % 24, ((timestamp // 100) % 3600) // 60)"
RESOLVERS = f"SELECT DISTINCT dst_ip FROM flows WHERE {DNS}"

# endpoint rows of J1: internal source, internal destination
ENDPOINTS = """endpoints AS (
    SELECT src_ip AS ip, period FROM flows WHERE starts_with(src_ip, '192.168.109.')
    UNION ALL
    SELECT dst_ip AS ip, period FROM flows WHERE starts_with(dst_ip, '192.168.109.')
  )"""

DESTINATIONS = """destinations AS (
    SELECT dst_ip, CAST(split_part(dst_ip, '.', 1) AS BIGINT) AS a, CAST(split_part(dst_ip, '.', 3) AS BIGINT) AS c,
           CAST(split_part(dst_ip, '.', 4) AS BIGINT) AS d
    FROM (SELECT DISTINCT dst_ip FROM flows)
  )"""

# J9 per-source comparison
PERIOD_COMPARE = f"""pc_agg AS (
    SELECT src_ip,
      count(*) FILTER (WHERE period = 'baseline') AS cn,
      count(*) FILTER (WHERE period = 'test') AS ct,
      sum(up_bytes) FILTER (WHERE period = 'baseline') AS un,
      sum(down_bytes) FILTER (WHERE period = 'baseline') AS dn,
      sum(up_bytes) FILTER (WHERE period = 'test') AS ut,
      sum(down_bytes) FILTER (WHERE period = 'test') AS dt
    FROM flows WHERE {INTERNET} GROUP BY src_ip
  ),
  pc AS (
    SELECT src_ip, un / cn AS avg_up_bytes_normal, dn / cn AS avg_down_bytes_normal,
           ut / ct AS avg_up_bytes_test, dt / ct AS avg_down_bytes_test
    FROM pc_agg WHERE cn > 0 AND ct > 0
  ),
  exfil AS (
    SELECT * FROM pc WHERE avg_up_bytes_test > avg_up_bytes_normal * 1.5
                        OR avg_down_bytes_test > avg_down_bytes_normal * 1.5
  )"""

GROWTH = """growth AS (
    SELECT src_ip,
      count(*) FILTER (WHERE period = 'baseline') AS counts,
      count(*) FILTER (WHERE period = 'test') AS counts_test
    FROM flows WHERE starts_with(dst_ip, '192.168.109.') GROUP BY src_ip
  ),
  growth_pct AS (
    SELECT *, CASE WHEN counts <> 0 THEN CAST(counts_test - counts AS DOUBLE) / counts * 100
                   WHEN counts_test - counts > 0 THEN 'inf'::DOUBLE END AS increase
    FROM growth
  ),
  c2 AS (
    SELECT * FROM growth_pct WHERE (increase > 250 OR increase = 'inf'::DOUBLE) AND counts > 50
  )"""

BOTNET = f"""fanout AS (
    SELECT src_ip, CAST(count(DISTINCT dst_ip) AS BIGINT) AS n_peers
    FROM flows WHERE period = 'test' AND NOT ({PUB}) GROUP BY src_ip
  ),
  botnet AS (SELECT * FROM fanout WHERE n_peers > 4)"""

NEW_COUNTRY = """cc_test AS (SELECT DISTINCT dst_cc FROM flows_cc WHERE period = 'test' AND dst_cc IS NOT NULL),
  cc_base AS (SELECT DISTINCT dst_cc FROM flows_cc WHERE period = 'baseline' AND dst_cc IS NOT NULL),
  new_cc AS (SELECT dst_cc FROM cc_test WHERE dst_cc NOT IN (SELECT dst_cc FROM cc_base)),
  new_cc_flows AS (
    SELECT DISTINCT src_ip, dst_ip, dst_cc FROM flows_cc
    WHERE period = 'test' AND dst_cc IN (SELECT dst_cc FROM new_cc)
  )"""

DNS_PER_SRC = f"""dns_src AS (
    SELECT src_ip, count(*) AS conns, sum(up_bytes) AS up_bytes, sum(down_bytes) AS down_bytes
    FROM flows WHERE period = 'test' AND {DNS} GROUP BY src_ip
  )"""

ORG_SQL = f"""{ASN_SQL},
  flows_org AS (
    SELECT f.*, asn.org AS dst_org
    FROM (SELECT *, {ip_num_sql('dst_ip')} AS dst_num FROM flows) f
    LEFT JOIN asn ON f.dst_num BETWEEN asn.lo AND asn.hi
  )"""


def _hist(values_cte: str, col: str, bins: int = 10, by: str | None = None) -> str:
    """D6/D49 in SQL: ``values_cte`` defines ``vals``; returns the full query."""
    key = by or "0"
    body = f"""SELECT {f'e.k AS {by}, ' if by else ''}e.bin, round(e.lo, 6) AS lo, round(e.hi, 6) AS hi, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM edges e LEFT JOIN cnt c ON e.bin = c.bin AND e.k = c.k"""
    ctes = [
        values_cte,
        f"st AS (SELECT {key} AS k, min({col}) AS mn, max({col}) AS mx FROM vals GROUP BY ALL)",
        f"""binned AS (
    SELECT st.k, CASE WHEN st.mn = st.mx THEN {bins // 2}
                ELSE least(((v.{col} - st.mn) * {bins}) // (st.mx - st.mn), {bins - 1}) END AS bin
    FROM vals v JOIN st ON {'v.' + by if by else '0'} = st.k WHERE v.{col} IS NOT NULL
  )""",
        "cnt AS (SELECT k, bin, count(*) AS n FROM binned GROUP BY k, bin)",
        f"""edges AS (
    SELECT st.k, CAST(i AS INTEGER) AS bin,
      CASE WHEN st.mn = st.mx THEN st.mn - 0.5 ELSE CAST(st.mn AS DOUBLE) END
        + i * (CASE WHEN st.mn = st.mx THEN 1.0 ELSE CAST(st.mx - st.mn AS DOUBLE) END / {bins}) AS lo,
      CASE WHEN st.mn = st.mx THEN st.mn - 0.5 ELSE CAST(st.mn AS DOUBLE) END
        + (i + 1) * (CASE WHEN st.mn = st.mx THEN 1.0 ELSE CAST(st.mx - st.mn AS DOUBLE) END / {bins}) AS hi
    FROM range({bins}) t(i), st
  )""",
    ]
    return with_flows(body, *ctes)


def _count_cols(where: str) -> str:
    cols = ("timestamp", "dst_ip", "proto", "port", "up_bytes", "down_bytes")
    counts = ", ".join(f"count({c}) AS n_{c}" for c in cols)
    return with_flows(f"SELECT src_ip, {counts} FROM flows WHERE {where} GROUP BY src_ip")


INTERNAL = "starts_with(src_ip, '192.168.109.') AND starts_with(dst_ip, '192.168.109.')"
EXTERNAL = "starts_with(src_ip, '192.168.109.') AND NOT starts_with(dst_ip, '192.168.109.')"


def _describe() -> str:
    parts = []
    for stat, fn in [("count", "CAST(count({c}) AS DOUBLE)"), ("mean", "avg({c})"),
                     ("std", "stddev_samp({c})"), ("min", "CAST(min({c}) AS DOUBLE)"),
                     ("25%", "quantile_cont({c}, 0.25)"), ("50%", "quantile_cont({c}, 0.5)"),
                     ("75%", "quantile_cont({c}, 0.75)"), ("max", "CAST(max({c}) AS DOUBLE)")]:
        up, down = fn.format(c="up_bytes"), fn.format(c="down_bytes")
        parts.append(f"SELECT '{stat}' AS stat, round({up}, 6) AS up_bytes, "
                     f"round({down}, 6) AS down_bytes FROM flows")
    return with_flows("\nUNION ALL\n".join(parts))


ORACLE: dict[str, str] = {
    # A
    "flow_scan": with_flows(f"SELECT {FLOW_COLS} FROM flows"),
    "file_order_scan": with_flows(
        f"""SELECT * REPLACE (row_number() OVER (PARTITION BY period ORDER BY flow_id) - 1 AS flow_id)
           FROM (SELECT {FLOW_COLS} FROM flows)"""),
    "period_scan": with_flows(
        "SELECT period, count(*) AS flows, count(*) - 1 AS last_position, CAST(sum(up_bytes) AS BIGINT) AS up_bytes, "
        "CAST(sum(down_bytes) AS BIGINT) AS down_bytes, min(timestamp) AS first_tick, max(timestamp) AS last_tick "
        "FROM flows GROUP BY period"),
    # B
    "udp_flows": with_flows(f"SELECT {FLOW_COLS} FROM flows WHERE proto = 'udp'"),
    "port443_flows": with_flows(f"SELECT {FLOW_COLS} FROM flows WHERE port = 443"),
    "udp443_flows": with_flows(f"SELECT {FLOW_COLS} FROM flows WHERE proto = 'udp' AND port = 443"),
    "port53_non_udp": with_flows(
        "SELECT CAST(53 AS INTEGER) AS port, 'udp' AS proto, count(*) AS violations, "
        "count(*) > 0 AS violated FROM flows WHERE proto <> 'udp' AND port = 53"),
    "port443_non_udp": with_flows(
        "SELECT CAST(443 AS INTEGER) AS port, 'udp' AS proto, count(*) AS violations, "
        "count(*) > 0 AS violated FROM flows WHERE proto <> 'udp' AND port = 443"),
    "internal_flows": with_flows(f"SELECT {FLOW_COLS} FROM flows WHERE {INTERNAL}"),
    "external_flows": with_flows(f"SELECT {FLOW_COLS} FROM flows WHERE {EXTERNAL}"),
    "to_internet_flows": with_flows(f"SELECT {FLOW_COLS} FROM flows WHERE {INTERNET}"),
    "rfc1918_flows": with_flows(f"SELECT {FLOW_COLS} FROM flows WHERE {RFC1918_SQL}"),
    "public_flag": with_flows(f"SELECT {FLOW_COLS}, {PUB} AS pub FROM flows"),
    "private_split": with_flows(f"SELECT flow_id, {_is_private('dst_ip')} AS is_private FROM flows"),
    "host_in_list": with_flows(
        f"SELECT {FLOW_COLS}, pub FROM (SELECT *, {PUB} AS pub FROM flows) "
        f"WHERE src_ip IN {_in(PEER_SUSPECTS)} AND pub"),
    "host_or_chain": with_flows(
        f"SELECT {FLOW_COLS} FROM flows WHERE src_ip IN {_in(PEER_SUSPECTS)} AND NOT ({PUB})"),
    "time_range": with_flows(
        f"SELECT {FLOW_COLS} FROM flows WHERE timestamp // 100 > 80000 AND timestamp // 100 < 90000"),
    "having_threshold": with_flows(
        f"SELECT period, src_ip, count(*) AS counts FROM flows WHERE {INTERNET} GROUP BY ALL HAVING count(*) > 100"),
    "project_columns": with_flows_cc("SELECT src_ip, dst_ip, dst_cc FROM flows_cc"),
    "rename_agg": with_flows(
        "SELECT src_ip, count(*) AS counts FROM flows WHERE starts_with(src_ip, '192.168.109.') GROUP BY src_ip"),
    "fill_zero": with_flows(
        """SELECT h.src_ip, CAST(coalesce(u.n, 0) AS BIGINT) AS n
           FROM (SELECT DISTINCT src_ip FROM flows) h
           LEFT JOIN (SELECT src_ip, count(up_bytes) AS n FROM flows
                      WHERE proto = 'udp' AND port = 443 GROUP BY src_ip) u ON h.src_ip = u.src_ip"""),
    "drop_null_cc": with_flows_cc("SELECT flow_id, dst_cc FROM flows_cc WHERE dst_cc IS NOT NULL"),
    # J
    "host_activity": with_flows("SELECT period, ip, count(*) AS flows FROM endpoints GROUP BY period, ip", ENDPOINTS),
    "top_hosts_compare": with_flows(
        """SELECT ip, counts_normal, counts_test FROM (
             SELECT ip, count(*) FILTER (WHERE period = 'baseline') AS counts_normal,
                    count(*) FILTER (WHERE period = 'test') AS counts_test
             FROM endpoints GROUP BY ip HAVING count(*) FILTER (WHERE period = 'test') > 0
             ORDER BY counts_test DESC, ip LIMIT 10) WHERE counts_normal > 0""", ENDPOINTS),
    "server_contact_growth": with_flows(
        "SELECT src_ip, counts, counts_test, round(increase, 6) AS increase FROM growth_pct", GROWTH),
    "flows_to_known_hosts": with_flows(
        """SELECT period, src_ip, count(*) AS counts FROM flows
           WHERE (period, dst_ip) IN (SELECT (period, ip) FROM endpoints) GROUP BY period, src_ip""", ENDPOINTS),
    "bytes_with_counts": with_flows(
        f"""SELECT period, src_ip, CAST(sum(up_bytes) AS BIGINT) AS up_bytes, CAST(sum(down_bytes) AS BIGINT) AS down_bytes,
                  count(*) AS counts, round(sum(up_bytes) / count(*), 6) AS avg_up_bytes,
                  round(sum(down_bytes) / count(*), 6) AS avg_down_bytes
           FROM flows WHERE {INTERNET} GROUP BY period, src_ip"""),
    "geo_country": with_flows(
        f"""SELECT flow_id, dst_ip, CASE WHEN num BETWEEN {NET_LO} AND {NET_HI} THEN NULL ELSE coalesce(cc, '') END AS dst_cc
           FROM (SELECT flow_id, dst_ip, {ip_num_sql('dst_ip')} AS num FROM flows) LEFT JOIN pieces ON num BETWEEN lo AND hi""", NESTED_SQL),
    "geo_org": with_flows(
        f"""SELECT flow_id, dst_ip, org AS dst_org
           FROM (SELECT flow_id, dst_ip, {ip_num_sql('dst_ip')} AS num FROM flows) LEFT JOIN pieces ON num BETWEEN lo AND hi""", NESTED_SQL),
    "geo_ranges": with_flows("SELECT lo, hi, cc FROM pieces", NESTED_SQL),
    "asn_ranges": with_flows("SELECT lo, hi, org FROM pieces", NESTED_SQL),
    "candidate_bytes": with_flows(
        f"""SELECT src_ip, CAST(sum(up_bytes) AS BIGINT) AS up_bytes, CAST(sum(down_bytes) AS BIGINT) AS down_bytes
           FROM flows WHERE period = 'test' AND {INTERNET} AND src_ip IN (SELECT src_ip FROM botnet)
           GROUP BY src_ip""", BOTNET),
    "period_compare": with_flows(
        """SELECT src_ip, round(avg_up_bytes_normal, 6) AS avg_up_bytes_normal,
                  round(avg_down_bytes_normal, 6) AS avg_down_bytes_normal,
                  round(avg_up_bytes_test, 6) AS avg_up_bytes_test,
                  round(avg_down_bytes_test, 6) AS avg_down_bytes_test FROM pc""", PERIOD_COMPARE),
    "reverse_dns": with_flows(
        """SELECT dst_ip AS ip, CASE WHEN a % 2 = 0 AND c % 5 <> 3 THEN 'h' || replace(dst_ip, '.', '-') || '.example'
 END AS host FROM destinations""", DESTINATIONS),
    "dns_misses": with_flows(
        """SELECT dst_ip AS ip, array_to_string(list_reverse(string_split(dst_ip, '.')), '.') || '.in-addr.arpa' AS ptr_name
           FROM destinations WHERE a % 2 = 1""", DESTINATIONS),
    # D
    "udp_count_by_src": with_flows(
        "SELECT src_ip, count(up_bytes) AS n FROM flows WHERE proto = 'udp' GROUP BY src_ip"),
    "udp443_count_by_src": with_flows(
        "SELECT src_ip, count(up_bytes) AS n FROM flows WHERE proto = 'udp' AND port = 443 GROUP BY src_ip"),
    "avg_down_by_src": with_flows(
        "SELECT src_ip, round(avg(down_bytes), 6) AS avg_down FROM flows GROUP BY src_ip"),
    "up443_by_src": with_flows(
        "SELECT src_ip, CAST(sum(up_bytes) AS BIGINT) AS up_bytes FROM flows WHERE port = 443 GROUP BY src_ip"),
    "down_up_ratio_443": with_flows(
        f"SELECT src_ip, {_ratio('sum(down_bytes)', 'sum(up_bytes)')} AS ratio "
        "FROM flows WHERE port = 443 GROUP BY src_ip"),
    "internal_udp_by_src": _count_cols(f"{INTERNAL} AND proto = 'udp'"),
    "internal_tcp_by_src": _count_cols(f"{INTERNAL} AND proto = 'tcp'"),
    "external_udp_by_src": _count_cols(f"{EXTERNAL} AND proto = 'udp'"),
    "mean_flows_per_host": with_flows(
        """SELECT round(avg(n), 6) AS mean_flows FROM (
             SELECT src_ip, count(*) AS n FROM flows WHERE starts_with(src_ip, '192.168.109.') GROUP BY src_ip)"""),
    "proto_frequency": with_flows("SELECT proto, count(*) AS n FROM flows GROUP BY proto"),
    "port_frequency": with_flows("SELECT port, count(*) AS n FROM flows GROUP BY port"),
    "distinct_dst": with_flows("SELECT DISTINCT dst_ip FROM flows"),
    "distinct_countries": with_flows_cc("SELECT DISTINCT dst_cc FROM flows_cc WHERE dst_cc IS NOT NULL"),
    "distinct_orgs": with_flows("SELECT DISTINCT dst_org FROM flows_org", ORG_SQL),
    "bytes_summary": _describe(),
    "internal_services": with_flows(
        f"""SELECT dst_ip, port, CAST(sum(up_bytes) AS BIGINT) AS up_bytes,
                  CAST(sum(down_bytes) AS BIGINT) AS down_bytes, count(dst_ip) AS connections
           FROM flows WHERE {RFC1918_SQL} GROUP BY dst_ip, port"""),
    "internal_services_mean": with_flows(
        f"""SELECT round(avg(u), 6) AS mean_up, round(avg(d), 6) AS mean_down FROM (
             SELECT sum(up_bytes) AS u, sum(down_bytes) AS d FROM flows WHERE {RFC1918_SQL}
             GROUP BY dst_ip, port)"""),
    "hourly_bytes": with_flows(
        f"""SELECT period, {HOUR} AS hour, CAST(sum(up_bytes) AS BIGINT) AS up_bytes,
                  CAST(sum(down_bytes) AS BIGINT) AS down_bytes FROM flows GROUP BY ALL"""),
    "internal_dst_count": with_flows(
        f"SELECT dst_ip, count(proto) AS n FROM flows WHERE NOT ({PUB}) GROUP BY dst_ip"),
    "internal_fanout": with_flows(
        f"SELECT src_ip, count(DISTINCT dst_ip) AS n_peers FROM flows WHERE NOT ({PUB}) GROUP BY src_ip"),
    "internal_peers": with_flows(
        f"""SELECT DISTINCT src_ip, dst_ip AS peer
           FROM flows WHERE NOT ({PUB}) AND src_ip IN {_in(PEER_SUSPECTS)}"""),
    "dns_up_by_dst": with_flows(
        f"SELECT dst_ip, CAST(sum(up_bytes) AS BIGINT) AS up_bytes, count(*) AS conns FROM flows WHERE {DNS} GROUP BY dst_ip"),
    "server_bytes_by_src": with_flows(
        f"""SELECT src_ip, CAST(sum(up_bytes) AS BIGINT) AS up_bytes, CAST(sum(down_bytes) AS BIGINT) AS down_bytes
           FROM flows WHERE dst_ip IN ({RESOLVERS}) GROUP BY src_ip"""),
    "server_conns_by_src": with_flows(
        f"SELECT src_ip, count(dst_ip) AS conns FROM flows WHERE dst_ip IN ({RESOLVERS}) GROUP BY src_ip"),
    "server_ratio_by_src_dst": with_flows(
        f"""SELECT src_ip, dst_ip, {_ratio('sum(up_bytes)', 'sum(down_bytes)')} AS ratio FROM flows
           WHERE dst_ip IN ({RESOLVERS}) AND src_ip IN {_in(DNS_SUSPECTS)} GROUP BY src_ip, dst_ip"""),
    "ratio_by_src": with_flows(
        f"SELECT src_ip, {_ratio('sum(up_bytes)', 'sum(down_bytes)')} AS ratio FROM flows GROUP BY src_ip"),
    "ratio_by_src_dst": with_flows(
        f"""SELECT src_ip, dst_ip, {_ratio('sum(up_bytes)', 'sum(down_bytes)')} AS ratio FROM flows
           WHERE src_ip IN {_in(TCP_SUSPECTS)} GROUP BY src_ip, dst_ip"""),
    "edge_conns_bytes": with_flows(
        """SELECT src_ip, dst_ip, count(dst_ip) AS conns, CAST(sum(up_bytes) AS BIGINT) AS up_bytes
           FROM flows WHERE proto = 'udp' AND port = 443 GROUP BY src_ip, dst_ip"""),
    "edge_conns_public": with_flows(
        f"""SELECT src_ip, dst_ip, count(port) AS conns FROM flows
           WHERE {PUB} AND src_ip IN {_in(TCP_SUSPECTS)} GROUP BY src_ip, dst_ip"""),
    "edge_bytes": with_flows(
        f"""SELECT src_ip, dst_ip, CAST(sum(up_bytes) AS BIGINT) AS up_bytes, CAST(sum(down_bytes) AS BIGINT) AS down_bytes
           FROM flows WHERE src_ip IN {_in(TCP_SUSPECTS)} GROUP BY src_ip, dst_ip"""),
    "dns_mean_by_src": with_flows(
        f"""SELECT src_ip, round(avg(up_bytes), 6) AS avg_up, round(avg(down_bytes), 6) AS avg_down
           FROM flows WHERE dst_ip IN ({RESOLVERS}) GROUP BY src_ip"""),
    "dst_count_for_hosts": with_flows(
        f"SELECT dst_ip, count(up_bytes) AS n FROM flows WHERE src_ip IN {_in(DNS_SUSPECTS)} GROUP BY dst_ip"),
    "dns_count_by_src": with_flows(f"SELECT src_ip, count(up_bytes) AS n FROM flows WHERE {DNS} GROUP BY src_ip"),
    "dns_up_by_src": with_flows(
        f"SELECT src_ip, CAST(sum(up_bytes) AS BIGINT) AS up_bytes FROM flows WHERE {DNS} GROUP BY src_ip"),
    "server_up_by_src": with_flows(
        f"""SELECT src_ip, CAST(sum(up_bytes) AS BIGINT) AS up_bytes FROM flows
           WHERE dst_ip IN ({RESOLVERS}) AND src_ip IN {_in(DNS_SUSPECTS)} GROUP BY src_ip"""),
    "udp443_bytes_by_src": with_flows(
        """SELECT src_ip, CAST(sum(up_bytes) AS BIGINT) AS up_bytes, CAST(sum(down_bytes) AS BIGINT) AS down_bytes
           FROM flows WHERE proto = 'udp' AND port = 443 GROUP BY src_ip"""),
    "host_profile": with_flows(
        f"""SELECT src_ip, count(*) AS flows,
                  count(*) FILTER (WHERE NOT {_is_private('dst_ip')}) AS flows_to_internet,
                  count(*) FILTER (WHERE {_is_private('dst_ip')}) AS flows_to_private_ips,
                  CAST(sum(up_bytes) AS BIGINT) AS total_up_bytes,
                  CAST(sum(down_bytes) AS BIGINT) AS total_down_bytes,
                  round(sum(up_bytes) / count(*), 6) AS up_bytes_per_flow,
                  round(sum(down_bytes) / count(*), 6) AS down_bytes_per_flow,
                  round(count(*) FILTER (WHERE proto = 'udp') / count(*), 6) AS udp_share,
                  round(count(*) FILTER (WHERE proto = 'tcp') / count(*), 6) AS tcp_share
           FROM flows GROUP BY src_ip"""),
    "bytes_by_minute": with_flows(
        f"""SELECT period, {MINUTE} AS minute, CAST(sum(up_bytes) AS BIGINT) AS up_bytes,
                  CAST(sum(down_bytes) AS BIGINT) AS down_bytes FROM flows GROUP BY ALL"""),
    "bytes_by_second": with_flows(
        "SELECT period, timestamp // 100 AS second, CAST(sum(up_bytes) AS BIGINT) AS up_bytes FROM flows GROUP BY ALL"),
    "bytes_by_tick": with_flows(
        "SELECT period, timestamp AS tick, CAST(sum(up_bytes) AS BIGINT) AS up_bytes FROM flows GROUP BY ALL"),
    "conns_by_second": with_flows(
        "SELECT period, timestamp // 100 AS second, count(up_bytes) AS n FROM flows GROUP BY ALL"),
    "conns_by_tick": with_flows("SELECT period, timestamp AS tick, count(up_bytes) AS n FROM flows GROUP BY ALL"),
    "up_by_minute": with_flows(
        f"SELECT period, {MINUTE} AS minute, CAST(sum(up_bytes) AS BIGINT) AS up_bytes FROM flows GROUP BY ALL"),
    "dst_up_with_sources": with_flows(
        """SELECT DISTINCT f.dst_ip, t.up_bytes, f.src_ip FROM flows f JOIN (
             SELECT dst_ip, CAST(sum(up_bytes) AS BIGINT) AS up_bytes FROM flows GROUP BY dst_ip
             ORDER BY up_bytes DESC, dst_ip LIMIT 2) t ON f.dst_ip = t.dst_ip"""),
    "country_frequency": with_flows_cc(
        "SELECT dst_cc, count(*) AS n FROM new_cc_flows GROUP BY dst_cc", NEW_COUNTRY),
    "country_fanout": with_flows_cc(
        "SELECT src_ip, count(DISTINCT dst_cc) AS n_countries FROM flows_cc WHERE dst_cc <> '' GROUP BY src_ip"),
    "country_bytes": with_flows_cc(
        "SELECT src_ip, CAST(sum(up_bytes) AS BIGINT) AS up_bytes FROM flows_cc "
        "WHERE dst_cc IN ('CN', 'RU') GROUP BY src_ip"),
    "internet_bytes_by_src": with_flows(
        f"""SELECT period, src_ip, CAST(sum(up_bytes) AS BIGINT) AS up_bytes, CAST(sum(down_bytes) AS BIGINT) AS down_bytes
           FROM flows WHERE {INTERNET} GROUP BY ALL"""),
    "internet_flows_by_src": with_flows(
        f"SELECT period, src_ip, count(*) AS counts FROM flows WHERE {INTERNET} GROUP BY ALL"),
    "country_count": with_flows_cc("SELECT count(DISTINCT dst_cc) AS n_countries FROM flows_cc"),
    # E
    "flow_gap": with_flows(
        """SELECT flow_id, period, src_ip,
                  coalesce(timestamp - lag(timestamp) OVER (PARTITION BY period, src_ip ORDER BY flow_id), 0) AS gap
           FROM flows"""),
    "avg_flow_gap": with_flows(
        """SELECT period, src_ip, round(avg(gap), 6) AS avg_gap FROM (
             SELECT period, src_ip, coalesce(timestamp - lag(timestamp) OVER (PARTITION BY period, src_ip ORDER BY flow_id), 0) AS gap
             FROM flows) GROUP BY period, src_ip"""),
    # F
    "sort_desc": with_flows(
        f"""SELECT period, src_ip, CAST(sum(up_bytes) AS BIGINT) AS up_bytes, CAST(sum(down_bytes) AS BIGINT) AS down_bytes
           FROM flows WHERE {INTERNET} GROUP BY ALL ORDER BY up_bytes DESC, period, src_ip"""),
    "top_k_hosts": with_flows(
        """SELECT period, ip, count(*) AS flows FROM endpoints GROUP BY period, ip
           QUALIFY row_number() OVER (PARTITION BY period ORDER BY flows DESC, ip) <= 10""", ENDPOINTS),
    "tail_k": with_flows(
        f"SELECT src_ip, count(up_bytes) AS n FROM flows WHERE {DNS} GROUP BY src_ip ORDER BY n DESC, src_ip LIMIT 5"),
    "peak_hour": with_flows(
        """SELECT period, 'up_bytes' AS metric, arg_max(hour, (up, -CAST(hour AS INTEGER))) AS hour FROM hourly GROUP BY period
           UNION ALL
           SELECT period, 'down_bytes', arg_max(hour, (down, -CAST(hour AS INTEGER))) FROM hourly GROUP BY period""",
        f"hourly AS (SELECT period, {HOUR} AS hour, sum(up_bytes) AS up, sum(down_bytes) AS down FROM flows GROUP BY ALL)"),
    "last_entries": with_flows(f"SELECT {FLOW_COLS} FROM flows ORDER BY flow_id DESC LIMIT 10"),
    "preview": with_flows(
        """SELECT src_ip, CAST(sum(up_bytes) AS BIGINT) AS up_bytes FROM flows WHERE port = 443
           GROUP BY src_ip ORDER BY up_bytes DESC, src_ip LIMIT 5"""),
    "skip_first_n": with_flows(
        f"""SELECT period, {MINUTE} AS minute, CAST(sum(up_bytes) AS BIGINT) AS up_bytes,
                  CAST(sum(down_bytes) AS BIGINT) AS down_bytes FROM flows GROUP BY 1, 2
           QUALIFY row_number() OVER (PARTITION BY period ORDER BY minute) > 500"""),
    "last_seconds": with_flows(
        """SELECT period, timestamp // 100 AS second, CAST(sum(up_bytes) AS BIGINT) AS up_bytes FROM flows GROUP BY 1, 2
           QUALIFY row_number() OVER (PARTITION BY period ORDER BY second DESC) <= 60"""),
    # G
    "new_countries": with_flows_cc("SELECT dst_cc FROM new_cc", NEW_COUNTRY),
    "new_country_flows": with_flows_cc("SELECT src_ip, dst_ip, dst_cc FROM new_cc_flows", NEW_COUNTRY),
    "new_country_sources": with_flows_cc("SELECT DISTINCT src_ip, dst_cc FROM new_cc_flows", NEW_COUNTRY),
    "new_country_source_ips": with_flows_cc("SELECT DISTINCT src_ip FROM new_cc_flows", NEW_COUNTRY),
    "country_list_diff": with_flows_cc(
        """SELECT dst_cc AS cc, min(flow_id) AS first_flow_id FROM flows_cc
           WHERE period = 'test' AND dst_cc IS NOT NULL
             AND dst_cc NOT IN (SELECT dst_cc FROM flows_cc WHERE period = 'baseline' AND dst_cc IS NOT NULL)
           GROUP BY dst_cc"""),
    # H
    "ts_to_hours": with_flows(
        """SELECT flow_id, printf('%02d:%02d:%02d', (timestamp // 100) // 3600,
                  ((timestamp // 100) % 3600) // 60, (timestamp // 100) % 60) AS hms FROM flows"""),
    "hour_of_day": with_flows(f"SELECT flow_id, {HOUR} AS hour FROM flows"),
    "minute_of_day": with_flows(f"SELECT flow_id, {MINUTE} AS minute FROM flows"),
    "ts_seconds": with_flows("SELECT flow_id, timestamp // 100 AS second FROM flows"),
    "ip_to_num": with_flows(
        f"""SELECT flow_id, {ip_num_sql('dst_ip')} AS dst_num,
                  {ip_num_sql('dst_ip')} BETWEEN {NET_LO} AND {NET_HI} AS in_net FROM flows"""),
    "ptr_name": with_flows(
        """SELECT dst_ip, array_to_string(list_reverse(string_split(dst_ip, '.')), '.') || '.in-addr.arpa' AS ptr
           FROM (SELECT DISTINCT dst_ip FROM flows)"""),
    "pct_increase": with_flows(
        f"""SELECT src_ip, round(CASE WHEN b <> 0 THEN CAST(t - b AS DOUBLE) / b
                                      WHEN t - b > 0 THEN 'inf'::DOUBLE END * 100, 6) AS increase
           FROM (SELECT src_ip, count(*) FILTER (WHERE period = 'baseline') AS b,
                        count(*) FILTER (WHERE period = 'test') AS t FROM flows GROUP BY src_ip)"""),
    "bytes_per_flow": with_flows(
        "SELECT src_ip, round(sum(up_bytes) / count(*), 6) AS up_bytes_per_flow FROM flows GROUP BY src_ip"),
    "share": with_flows(
        "SELECT src_ip, round(count(*) FILTER (WHERE proto = 'udp') / count(*), 6) AS udp_share "
        "FROM flows GROUP BY src_ip"),
    "safe_ratio": with_flows(
        f"""SELECT src_ip, port, {_ratio('u', 't')} AS ratio FROM (
             SELECT src_ip, port, sum(CASE WHEN proto = 'udp' THEN up_bytes ELSE 0 END) AS u,
                    sum(CASE WHEN proto = 'tcp' THEN up_bytes ELSE 0 END) AS t
             FROM flows GROUP BY src_ip, port)"""),
    "startswith_any": with_flows(f"SELECT flow_id, {RFC1918_SQL} AS rfc1918 FROM flows"),
    # R
    "rule_high_upload": with_flows(
        """SELECT round(normal_mean, 6) AS normal_mean, round(test_mean, 6) AS test_mean,
                  coalesce(test_mean > normal_mean * 1.5, false) AS detected FROM (
             SELECT avg(a) FILTER (WHERE period = 'baseline') AS normal_mean,
                    avg(a) FILTER (WHERE period = 'test') AS test_mean FROM host_avgs)""",
        f"""host_avgs AS (SELECT period, src_ip, sum(up_bytes) / count(*) AS a FROM flows
                          WHERE {INTERNET} GROUP BY period, src_ip)"""),
    "rule_high_download": with_flows(
        """SELECT round(normal_mean, 6) AS normal_mean, round(test_mean, 6) AS test_mean,
                  coalesce(test_mean > normal_mean * 1.5, false) AS detected FROM (
             SELECT avg(a) FILTER (WHERE period = 'baseline') AS normal_mean,
                    avg(a) FILTER (WHERE period = 'test') AS test_mean FROM host_avgs)""",
        f"""host_avgs AS (SELECT period, src_ip, sum(down_bytes) / count(*) AS a FROM flows
                          WHERE {INTERNET} GROUP BY period, src_ip)"""),
    "rule_external_connections": with_flows(
        f"""SELECT count(*) AS external_flows, count(*) > 37 AS detected
           FROM flows WHERE period = 'test' AND {INTERNET}"""),
    "rule_many_countries": with_flows_cc(
        """SELECT src_ip, count(DISTINCT dst_cc) AS n_countries FROM flows_cc
           WHERE period = 'test' AND dst_cc <> '' GROUP BY src_ip HAVING count(DISTINCT dst_cc) > 5"""),
    "rule_country_transfer": with_flows_cc(
        """SELECT src_ip, CAST(sum(up_bytes) AS BIGINT) AS up_bytes FROM flows_cc
           WHERE period = 'test' AND dst_cc IN ('CN', 'RU') GROUP BY src_ip HAVING sum(up_bytes) > 1000000"""),
    "many_countries_bytes": with_flows_cc(
        f"""SELECT src_ip, CAST(sum(up_bytes) AS BIGINT) AS up_bytes, CAST(sum(down_bytes) AS BIGINT) AS down_bytes
           FROM flows WHERE period = 'test' AND {INTERNET} AND src_ip IN (
             SELECT src_ip FROM flows_cc WHERE period = 'test' AND dst_cc <> ''
             GROUP BY src_ip HAVING count(DISTINCT dst_cc) > 5)
           GROUP BY src_ip"""),
    "detect_exfiltration": with_flows(
        """SELECT src_ip, round(avg_up_bytes_normal, 6) AS avg_up_bytes_normal,
                  round(avg_down_bytes_normal, 6) AS avg_down_bytes_normal,
                  round(avg_up_bytes_test, 6) AS avg_up_bytes_test,
                  round(avg_down_bytes_test, 6) AS avg_down_bytes_test FROM exfil""", PERIOD_COMPARE),
    "exfiltration_bytes": with_flows(
        f"""SELECT src_ip, CAST(sum(up_bytes) AS BIGINT) AS up_bytes, CAST(sum(down_bytes) AS BIGINT) AS down_bytes
           FROM flows WHERE period = 'test' AND {INTERNET} AND src_ip IN (SELECT src_ip FROM exfil)
           GROUP BY src_ip""", PERIOD_COMPARE),
    "detect_c2_growth": with_flows(
        "SELECT src_ip, counts, counts_test, round(increase, 6) AS increase FROM c2", GROWTH),
    "detect_botnet": with_flows("SELECT src_ip, n_peers FROM botnet", BOTNET),
    "botnet_peers": with_flows(
        f"""SELECT DISTINCT src_ip, dst_ip AS peer FROM flows
           WHERE period = 'test' AND NOT ({PUB}) AND src_ip IN (SELECT src_ip FROM botnet)""",
        BOTNET),
    "detect_dns_c2": with_flows(
        f"""SELECT src_ip, conns, {_ratio('up_bytes', 'down_bytes')} AS ratio FROM dns_src
           WHERE conns > (SELECT avg(conns) FROM dns_src) * 1.25
             AND CAST(up_bytes AS DOUBLE) / down_bytes BETWEEN 0.41 AND 0.45""", DNS_PER_SRC),
    "detect_quic_exfil": with_flows(
        f"""SELECT src_ip, up_bytes, down_bytes, {_ratio('up_bytes', 'down_bytes')} AS ratio FROM (
             SELECT src_ip, CAST(sum(up_bytes) AS BIGINT) AS up_bytes, CAST(sum(down_bytes) AS BIGINT) AS down_bytes
             FROM flows WHERE period = 'test' AND proto = 'udp' AND port = 443 GROUP BY src_ip)
           WHERE CAST(up_bytes AS DOUBLE) / down_bytes > 1.0"""),
    "detect_tcp_exfil": with_flows(
        f"""SELECT src_ip, dst_ip, count(*) AS conns, CAST(sum(up_bytes) AS BIGINT) AS up_bytes,
                  {_ratio('sum(up_bytes)', 'sum(down_bytes)')} AS ratio
           FROM flows WHERE period = 'test' AND proto = 'tcp' AND src_ip IN (
             SELECT src_ip FROM flows WHERE period = 'test' AND proto = 'tcp'
             GROUP BY src_ip HAVING CAST(sum(up_bytes) AS DOUBLE) / sum(down_bytes) > 0.3)
           GROUP BY src_ip, dst_ip HAVING CAST(sum(up_bytes) AS DOUBLE) / sum(down_bytes) > 1.0"""),
    "detect_dns_exfil": with_flows(
        f"""SELECT src_ip, CAST(up_bytes AS BIGINT) AS up_bytes, conns,
                  {_ratio('up_bytes', 'down_bytes')} AS ratio FROM dns_src
           WHERE up_bytes > (SELECT avg(up_bytes) FROM dns_src) * 1.5
             AND CAST(up_bytes AS DOUBLE) / down_bytes BETWEEN 0.41 AND 0.45""", DNS_PER_SRC),
    "detect_new_countries": with_flows_cc(
        "SELECT src_ip, dst_cc, count(*) AS n FROM new_cc_flows GROUP BY src_ip, dst_cc", NEW_COUNTRY),
    "discover_servers": with_flows(
        """SELECT ip, count(*) AS flows FROM endpoints WHERE period = 'test'
           GROUP BY ip ORDER BY flows DESC, ip LIMIT 5""", ENDPOINTS),
    "burst_window": with_flows(
        f"""SELECT {FLOW_COLS} FROM flows WHERE period = 'test'
             AND timestamp // 100 > 80000 AND timestamp // 100 < 90000
           ORDER BY up_bytes DESC, flow_id LIMIT 30"""),
}

ORACLE["up443_histogram"] = _hist(
    "vals AS (SELECT src_ip, sum(up_bytes) AS up_bytes FROM flows WHERE port = 443 GROUP BY src_ip)", "up_bytes")
ORACLE["upload_histogram_time"] = _hist(
    "vals AS (SELECT period, timestamp, sum(up_bytes) AS up_bytes FROM flows GROUP BY ALL)", "up_bytes", by="period")


def _alert(rule: str, metric: str, threshold: float, rows: str, subject: str = "src_ip", detail: str = "NULL") -> str:
    return (f"SELECT '{rule}' AS rule, {subject} AS subject, CAST({detail} AS VARCHAR) AS detail, "
            f"round(CAST({metric} AS DOUBLE), 6) AS metric, CAST({threshold} AS DOUBLE) AS threshold FROM {rows}")


def _mean_alert(rule: str, col: str) -> str:
    """Mean over hosts of average bytes per internet flow, by period."""
    hosts = f"SELECT period, src_ip, sum({col}) / count(*) AS a FROM flows WHERE {INTERNET} GROUP BY period, src_ip"
    means = (f"(SELECT avg(a) FILTER (WHERE period = 'baseline') AS b, avg(a) FILTER (WHERE period = 'test') AS t "
             f"FROM ({hosts})) WHERE t > b * 1.5")
    return _alert(rule, "t / b", 1.5, means, "'192.168.109.'")


NORMAL_DNS = "CAST(up_bytes AS DOUBLE) / down_bytes BETWEEN 0.41 AND 0.45"
ALERTS = "report AS (" + "\n UNION ALL ".join([
    _alert("exfiltration", f"greatest({_ratio('avg_up_bytes_test', 'avg_up_bytes_normal')}, "
                           f"{_ratio('avg_down_bytes_test', 'avg_down_bytes_normal')})", 1.5, "exfil"),
    _alert("c2_growth", "increase", 250, "c2"),
    _alert("botnet", "n_peers", 4, "botnet"),
    _alert("many_countries", "n", 5, "(SELECT src_ip, count(DISTINCT dst_cc) AS n FROM flows_cc "
                                     "WHERE period = 'test' AND dst_cc <> '' GROUP BY src_ip) WHERE n > 5"),
    _alert("country_transfer", "u", 1000000, "(SELECT src_ip, sum(up_bytes) AS u FROM flows_cc "
                                             "WHERE period = 'test' AND dst_cc IN ('CN', 'RU') GROUP BY src_ip) WHERE u > 1000000"),
    _alert("dns_c2", "conns", 1.25, f"dns_src WHERE conns > (SELECT avg(conns) FROM dns_src) * 1.25 AND {NORMAL_DNS}"),
    _alert("quic_exfil", _ratio("u", "d"), 1.0, "(SELECT src_ip, sum(up_bytes) AS u, sum(down_bytes) AS d FROM flows WHERE period = 'test' "
                                                "AND proto = 'udp' AND port = 443 GROUP BY src_ip) WHERE CAST(u AS DOUBLE) / d > 1.0"),
    _alert("dns_exfil", "up_bytes", 1.5, f"dns_src WHERE up_bytes > (SELECT avg(up_bytes) FROM dns_src) * 1.5 AND {NORMAL_DNS}"),
    _mean_alert("high_upload", "up_bytes"),
    _mean_alert("high_download", "down_bytes"),
    _alert("external_connections", "n", 37, f"(SELECT count(*) AS n FROM flows WHERE period = 'test' AND {INTERNET}) WHERE n > 37", "'192.168.109.'"),
    _alert("tcp_exfil", _ratio("u", "d"), 1.0,
           "(SELECT src_ip, dst_ip, sum(up_bytes) AS u, sum(down_bytes) AS d FROM flows WHERE period = 'test' AND proto = 'tcp' "
           "GROUP BY src_ip, dst_ip) WHERE CAST(u AS DOUBLE) / d > 1.0 AND src_ip IN (SELECT src_ip FROM flows WHERE period = 'test' "
           "AND proto = 'tcp' GROUP BY src_ip HAVING CAST(sum(up_bytes) AS DOUBLE) / sum(down_bytes) > 0.3)", detail="dst_ip"),
    _alert("new_country", "n", 0, "(SELECT src_ip, dst_cc, count(*) AS n FROM new_cc_flows GROUP BY src_ip, dst_cc)", detail="dst_cc"),
]) + ")"
ALERT_PARTS = (PERIOD_COMPARE, GROWTH, BOTNET, DNS_PER_SRC, NEW_COUNTRY, ALERTS)

ORACLE["alerts"] = with_flows_cc("SELECT * FROM report", *ALERT_PARTS)

ORACLE["blocklist"] = with_flows_cc(
    f"""SELECT ip, array_to_string(list_sort(list_distinct(list(reason))), ',') AS reasons FROM (
         SELECT subject AS ip, rule AS reason FROM report
         WHERE rule NOT IN ('high_upload', 'high_download', 'external_connections')
         UNION ALL SELECT src_ip, 'fanout_before' FROM flows WHERE period = 'baseline' AND NOT ({PUB})
           GROUP BY src_ip HAVING count(DISTINCT dst_ip) > 3) GROUP BY ip""", *ALERT_PARTS)

ORACLE["csv_sink"] = with_flows_cc("SELECT src_ip, dst_ip, dst_cc FROM new_cc_flows", NEW_COUNTRY)

ORACLE["server_roles"] = with_flows(
    """SELECT t.ip, t.flows, array_to_string(list_sort(list(DISTINCT f.proto || '/' || CAST(f.port AS VARCHAR))), ',')
              AS services
       FROM (SELECT ip, count(*) AS flows FROM endpoints WHERE period = 'test'
             GROUP BY ip ORDER BY flows DESC, ip LIMIT 5) t
       LEFT JOIN flows f ON f.dst_ip = t.ip AND f.period = 'test' AND starts_with(f.dst_ip, '192.168.109.')
       GROUP BY t.ip, t.flows""", ENDPOINTS)

ORACLE["address_quarantine"] = with_flows(
    f"""SELECT count(*) AS flows, count(*) FILTER (WHERE {ip_num_sql('src_ip')} IS NULL) AS bad_src,
              count(*) FILTER (WHERE {ip_num_sql('dst_ip')} IS NULL) AS bad_dst FROM flows""")
