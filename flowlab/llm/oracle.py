"""SQL for the text operators that SQL can express, written apart from the operators.

The texts use lists, lambdas and window functions as DuckDB has them."""

from __future__ import annotations


def centroid_sql(*, k: int, rounds: int, dims: int) -> str:
    """Rounds of clustering, one pair of subqueries each, over one row per component."""
    steps = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
parts AS MATERIALIZED (SELECT r, unnest(v) AS x, unnest(range({dims})) AS d FROM kept),
seeds AS (SELECT v, row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c FROM kept),
centres0 AS MATERIALIZED (SELECT c, unnest(v) AS x, unnest(range({dims})) AS d FROM seeds WHERE c < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""far{i} AS (SELECT r, c, CAST(sum((p.x - q.x) * (p.x - q.x)) AS BIGINT) AS distance
  FROM parts p JOIN centres{i} q USING (d) GROUP BY r, c),
near{i} AS MATERIALIZED (SELECT r, arg_min(c, (distance, c)) AS c, min(distance) AS distance FROM far{i} GROUP BY r)""")
        if i < rounds:
            steps.append(f"""centres{i + 1} AS MATERIALIZED (
  SELECT c, d, CAST(coalesce(m.x, q.x) AS BIGINT) AS x FROM centres{i} q LEFT JOIN (
    SELECT c, d, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x
    FROM near{i} JOIN parts USING (r) GROUP BY c, d) m USING (c, d))""")
    return "WITH " + ",\n".join(steps) + f""",
names AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM centres{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM near{rounds} JOIN kept USING (r) JOIN names USING (c)"""


# crc32 of a short text, bit by bit: eight steps for each byte, the byte mixed in before the first
CRC32 = """CAST(xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split({0}, ''),
    lambda ch: [CAST(ord(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) AS BIGINT)"""

TRIE_SQL = f"""WITH RECURSIVE turns AS MATERIALIZED (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS p,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS MATERIALIZED (SELECT c, {CRC32.format("CAST(c AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT c FROM turns)),
parts AS (
  SELECT v.c, 0 AS own, t.p, t.role, t.text FROM convs v JOIN turns t ON t.c = v.c - v.c % 20 AND t.p < v.h
  UNION ALL SELECT v.c, 1, t.p, t.role, t.text FROM convs v JOIN turns t ON t.c = v.c AND t.p >= v.h),
placed AS MATERIALIZED (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d, sha256(length(role) || ':' || role || text) AS turn,
  len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM parts),
sizes AS MATERIALIZED (SELECT convs.c, CAST(coalesce(max(d), 0) AS BIGINT) AS size FROM convs LEFT JOIN placed USING (c) GROUP BY convs.c),
-- the name of a node is the digest of its parent's name and its last turn
walk AS (
  SELECT c, CAST(0 AS BIGINT) AS d, '' AS node, CAST(NULL AS VARCHAR) AS up, CAST(0 AS BIGINT) AS words FROM sizes
  UNION ALL SELECT w.c, p.d, sha256(w.node || p.turn), w.node, p.words FROM walk w JOIN placed p ON p.c = w.c AND p.d = w.d + 1),
nodes AS MATERIALIZED (SELECT node, min(up) AS up, d, min(c) AS conv_id, count(*) AS n_convs, min(words) AS words FROM walk GROUP BY node, d),
children AS (SELECT up AS node, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
counted AS MATERIALIZED (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (node)),
climb AS (
  SELECT node AS top, up, CAST(n_children = 0 AS BIGINT) AS leaf, (n_convs - 1) * words AS saved FROM counted
  UNION ALL SELECT n.node, n.up, k.leaf, k.saved FROM climb k JOIN nodes n ON n.node = k.up),
sums AS (SELECT top AS node, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM climb GROUP BY top),
ends AS (SELECT w.node, string_agg(CAST(w.c AS VARCHAR), ',' ORDER BY w.c) AS ids FROM walk w JOIN sizes s ON s.c = w.c AND s.size = w.d GROUP BY w.node)
SELECT x.conv_id, CAST(x.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, x.n_convs, x.n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM counted x JOIN sums USING (node) LEFT JOIN ends USING (node) LEFT JOIN nodes u ON u.node = x.up"""


CHAT_SQL = r"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (SELECT *, row_number() OVER w AS p, count(*) OVER (PARTITION BY conv_id) AS n, lag(role) OVER w AS before,
    length('### : </turn>' || chr(10)) + CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role) ELSE 1 + length(hex(role)) END
      + length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '</turn>'))
      + coalesce(list_sum(list_transform(regexp_extract_all(text, '###+'), lambda x: length(x) - 2)), 0) AS size
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY p)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY p) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN p = 1 THEN role IN ('system', 'user') ELSE (before || ' ' || role) IN ('system user', 'user assistant', 'assistant user') END)
    AND bool_or(p = n AND role = 'assistant') AS valid
FROM sized GROUP BY conv_id"""
