"""Shared SQL text for the DuckDB oracle: the flows adapter and fixture tables.

Independent of the Spark code paths: the flows derivation and every query are
written again here as plain SQL so the two engines cross-check each other.
"""

from __future__ import annotations

from ..sources.ranges import FIXTURE_COUNTRY_BY_OCTET

FLOWS_SQL = """
  fl_ev AS (
    SELECT event_id AS e, user_id % 20 AS h, ts, CAST(ROUND(value * 100) AS BIGINT) AS cents
    FROM events
  ),
  fl_period AS (
    SELECT *, CASE WHEN h = 7 THEN (CASE WHEN e % 6 = 0 THEN 'baseline' ELSE 'test' END)
                   WHEN day(ts) <= 15 THEN 'baseline' ELSE 'test' END AS period
    FROM fl_ev
  ),
  fl_kind AS (
    SELECT *, CASE WHEN h IN (3, 11, 17) AND e % 10 = 9 AND period = 'test' THEN 'peer'
                   WHEN e % 8 < 6 THEN 'server' ELSE 'ext' END AS kind,
              CAST(FLOOR(e / 8.0) AS BIGINT) AS q
    FROM fl_period
  ),
  fl_group AS (
    SELECT *, CASE WHEN period = 'test' AND h = 13 THEN q % 12
                   WHEN period = 'test' AND h = 14 THEN 8 + q % 4
                   ELSE q % 4 END AS g
    FROM fl_kind
  ),
  fl_bytes AS (
    SELECT *,
      CASE WHEN (kind = 'server' AND e % 2 = 0) OR (kind = 'ext' AND e % 5 = 0) THEN 'udp' ELSE 'tcp' END AS proto,
      CAST(CASE WHEN kind = 'server' AND e % 2 = 0 THEN 53 ELSE 443 END AS INTEGER) AS port,
      (100 + cents) * CASE WHEN kind = 'ext' AND period = 'test' AND h = 5 THEN 40
                           WHEN kind = 'ext' AND period = 'test' AND h = 14 AND g >= 10 THEN 20
                           WHEN kind = 'server' AND e % 2 = 0 AND period = 'test' AND h = 9 THEN 3
                           ELSE 1 END AS up
    FROM fl_group
  ),
  flows AS (
    SELECT e AS flow_id, period,
      CAST((((day(ts) - 1) % 15) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts)) * 100
           + e % 100 AS BIGINT) AS timestamp,
      '192.168.109.' || CAST(h + 1 AS VARCHAR) AS src_ip,
      CASE WHEN kind = 'server' THEN '192.168.109.' ||
                CASE e % 4 WHEN 0 THEN '224' WHEN 1 THEN '225' WHEN 2 THEN '227' ELSE '230' END
           WHEN kind = 'ext' THEN CAST(20 + g AS VARCHAR) || '.' || CAST(e % 7 AS VARCHAR) || '.'
                || CAST(h % 5 AS VARCHAR) || '.' || CAST(1 + e % 3 AS VARCHAR)
           ELSE '192.168.109.' ||
                CASE WHEN h = 3 THEN (CASE WHEN e % 20 = 9 THEN '12' ELSE '18' END)
                     WHEN h = 11 THEN (CASE WHEN e % 20 = 9 THEN '4' ELSE '18' END)
                     ELSE (CASE WHEN e % 20 = 9 THEN '4' ELSE '12' END) END
      END AS dst_ip,
      proto, port, CAST(up AS BIGINT) AS up_bytes,
      CAST(CASE WHEN port = 53 THEN FLOOR(up * 23 / 10.0) ELSE 500 + 8 * cents END AS BIGINT) AS down_bytes
    FROM fl_bytes
  )"""


def _geo_values() -> str:
    rows = ", ".join(
        f"({o * 16777216}, {(o + 1) * 16777216 - 1}, '{cc}')"
        for o, cc in sorted(FIXTURE_COUNTRY_BY_OCTET.items()))
    return f"geo(lo, hi, cc) AS (VALUES {rows})"


def _asn_values() -> str:
    rows = ", ".join(
        f"({o * 16777216}, {(o + 1) * 16777216 - 1}, 'AS{o} ORG{o}')"
        for o in sorted(FIXTURE_COUNTRY_BY_OCTET))
    return f"asn(lo, hi, org) AS (VALUES {rows})"


# dotted quad -> integer, null when malformed (mirrors functions.net.ip_to_num)
def ip_num_sql(col: str) -> str:
    octet = "(0|[1-9][0-9]{0,2})"
    pat = rf"'^{octet}\.{octet}\.{octet}\.{octet}$'"
    parts = [f"CAST(regexp_extract({col}, {pat}, {i}) AS BIGINT)" for i in range(1, 5)]
    valid = " AND ".join([f"regexp_full_match({col}, {pat})"] + [f"{p} <= 255" for p in parts])
    return (f"(CASE WHEN {valid} THEN {parts[0]} * 16777216 + {parts[1]} * 65536 "
            f"+ {parts[2]} * 256 + {parts[3]} END)")


GEO_SQL = _geo_values()
ASN_SQL = _asn_values()

# flows with dst_cc: null for internal (N1), '' for unknown external.
FLOWS_CC_SQL = f"""
  {GEO_SQL},
  flows_cc AS (
    SELECT f.*, CASE WHEN f.dst_num BETWEEN 3232263424 AND 3232263679 THEN NULL
                     ELSE coalesce(geo.cc, '') END AS dst_cc
    FROM (SELECT *, {ip_num_sql('dst_ip')} AS dst_num FROM flows) f
    LEFT JOIN geo ON f.dst_num BETWEEN geo.lo AND geo.hi
  )"""


def with_flows(body: str, *extra_ctes: str) -> str:
    ctes = ",\n".join([FLOWS_SQL, *extra_ctes])
    return f"WITH {ctes}\n{body}"


def with_flows_cc(body: str, *extra_ctes: str) -> str:
    return with_flows(body, FLOWS_CC_SQL, *extra_ctes)


# Nested ranges around the external destinations, and what each address finds: the
# narrowest range that holds it. ``cuts`` are the places where that may change.
NESTED_SQL = f"""
  ext AS (
    SELECT n, (n >> 24) & 255 AS a, (n >> 16) & 255 AS b, (n >> 8) & 255 AS c, n & 255 AS d
    FROM (SELECT DISTINCT {ip_num_sql('dst_ip')} AS n FROM flows)
    WHERE n IS NOT NULL AND n NOT BETWEEN 3232263424 AND 3232263679
  ),
  {GEO_SQL},
  nested AS (
    SELECT lo, hi, cc, 'BLOCK ' || a AS org FROM (SELECT DISTINCT a FROM ext) JOIN geo ON geo.lo = a << 24
    UNION SELECT n - n % 65536, n - n % 65536 + 1023, 'CA', 'REGION ' || a FROM ext WHERE (a + b) % 3 = 0
    UNION SELECT n - d, n - d + 255, 'CH', 'SITE ' || a FROM ext WHERE (a + b + c) % 4 = 1
    UNION SELECT n - d + 1, n - d + 2, 'IT', 'PAIR ' || a FROM ext WHERE (a + 2 * b + c) % 5 = 2
    UNION SELECT n, n, 'NO', 'HOST ' || a FROM ext WHERE (a + b + c + d) % 7 = 0
  ),
  cuts AS (SELECT DISTINCT unnest([lo, hi + 1]) AS cut FROM nested),
  pieces AS (
    SELECT cut AS lo, next - 1 AS hi, arg_min(cc, width) AS cc, arg_min(org, width) AS org FROM (
      SELECT c.cut, c.next, n.cc, n.org, n.hi - n.lo AS width
      FROM (SELECT cut, lead(cut) OVER (ORDER BY cut) AS next FROM cuts) c JOIN nested n ON c.cut BETWEEN n.lo AND n.hi)
    GROUP BY cut, next
  )"""
