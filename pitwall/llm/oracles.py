"""DuckDB statements of the operators that SQL can express."""

from __future__ import annotations

#: Unsigned CRC-32 of a decimal number, bit by bit.
_CRC = """xor(list_reduce([4294967295] || flatten(list_transform(string_split(CAST(c AS VARCHAR), ''),
    lambda ch: [CAST(ascii(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
    lambda a, b: CASE WHEN xor(a, b) & 1 = 1 THEN xor(xor(a, b) >> 1, 3988292384) ELSE xor(a, b) >> 1 END), 4294967295)"""

PREFIX_TRIE = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, {_CRC} % 6 AS h FROM (SELECT DISTINCT c FROM t)),
steps AS (
  SELECT v.c, 0 AS part, t.i, t.r, t.x FROM convs v JOIN t ON t.c = v.c - v.c % 100 AND t.i <= v.h
  UNION ALL
  SELECT v.c, 1, t.i, t.r, t.x FROM convs v JOIN t ON t.c = v.c AND t.i > v.h),
rebuilt AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d, length(x) AS n,
         sha256(length(r) || ':' || r || x) AS s FROM steps),
prefix AS (
  SELECT c, d, n, string_agg(s, ',') OVER (PARTITION BY c ORDER BY d) AS k FROM rebuilt
  UNION ALL SELECT c, 0, 0, '' FROM convs),
rows_ AS (SELECT *, d = max(d) OVER (PARTITION BY c) AS ends FROM prefix),
nodes AS (
  SELECT d, k, CASE WHEN d > 1 THEN left(k, length(k) - 65) ELSE '' END AS up, min(c) AS conv_id, count(*) AS n_convs,
         any_value(n) AS n, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '') AS e
  FROM rows_ GROUP BY d, k),
kids AS (SELECT up AS k, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (k, d)),
below AS (
  SELECT a AS d, left(k, CASE WHEN a > 0 THEN 65 * a - 1 ELSE 0 END) AS k,
         count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * n) AS saved_tokens
  FROM (SELECT *, unnest(generate_series(0, d)) AS a FROM full_) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, b.n_leaves,
       CAST(b.saved_tokens AS BIGINT) AS saved_tokens, sha256(f.e) AS ends_sha256
FROM full_ f JOIN below b USING (d, k) LEFT JOIN nodes p ON p.d = f.d - 1 AND p.k = f.up
"""

_ROUNDS = 5
_ASSIGN = """a{r} AS MATERIALIZED (
  SELECT id, vec_id, x, w.c AS c, w.dist AS dist FROM (
    SELECT id, any_value(vec_id) AS vec_id, any_value(v.x) AS x, min({{'dist': dist, 'c': c}}) AS w FROM (
      SELECT v.id, v.vec_id, v.x, m.c,
             list_sum(list_transform(list_zip(v.x, m.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist
      FROM kept v CROSS JOIN c{r} m) v GROUP BY id))"""
_MOVE = """c{n} AS MATERIALIZED (
  SELECT o.c, coalesce(m.x, o.x) AS x FROM c{r} o LEFT JOIN (
    SELECT c, list(CAST((s - ((s % k) + k) % k) // k AS BIGINT) ORDER BY i) AS x FROM (
      SELECT c, i, sum(e) AS s, count(*) AS k
      FROM (SELECT c, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY c, i) GROUP BY c) m USING (c))"""

CLUSTERS = (
    """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c, x FROM kept WHERE vec_id IS NOT NULL QUALIFY c < 40),
"""
    + ",\n".join(_ASSIGN.format(r=r) + ",\n" + _MOVE.format(r=r, n=r + 1) for r in range(_ROUNDS))
    + ",\n"
    + _ASSIGN.format(r=_ROUNDS)
    + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance,
       CAST(sum(dist) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(dist) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m.x, ',')) AS centroid_sha256
FROM a{_ROUNDS} a JOIN c{_ROUNDS} m USING (c)
"""
)
