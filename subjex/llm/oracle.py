"""DuckDB SQL for the queries that SQL can express."""

from subjex.llm.queries import MIX
from subjex.llm.raking import KEEP, ROUNDS, STILL

_LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM lines),
often AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, o.key IS NOT NULL AND k.doc_id <> o.last_doc AS gone
  FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_SPACED = "'[\\x20\\x09-\\x0D]+'"


def _mixing(targets: dict, keep: float, rounds: int, still: float) -> str:
    """Raking as a recursive CTE over rows: caps from the sorted ratios of supply to target, then one window per dimension."""
    names = {d: [*(v for v in targets[d] if v != "other"), "other"] for d in ("source", "lang", "topic")}
    code = lambda d: "CASE " + " ".join(f"WHEN {d} = '{v}' THEN {i}" for i, v in enumerate(names[d][:-1], 1)) + f" ELSE {len(names[d])} END"
    asked = ", ".join(f"('{d[0]}', {i}, {float(targets[d].get(v, 0.0))!r}::DOUBLE)" for d in names for i, v in enumerate(names[d], 1))
    fit = lambda k, r, inner: (f"SELECT *, least(1.0, {r} * CASE WHEN sum(w * {r}) OVER (PARTITION BY {k}) > 0 THEN g{k} / sum(w * {r}) OVER (PARTITION BY {k}) ELSE 0 END) "  # noqa: E731
                               f"AS {r}{k} FROM ({inner})")
    step = fit("t", "rsl", fit("l", "rs", fit("s", "r", f"SELECT * FROM raked WHERE moved > {still!r} AND k < {rounds}")))
    return f"""
WITH RECURSIVE counted AS (
  SELECT *, len(list_filter(regexp_split_to_array(coalesce(text, ''), {_SPACED}), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents),
topical AS (
  SELECT *, CASE WHEN contains(coalesce(text, ''), '|') THEN 'table' WHEN regexp_matches(coalesce(text, ''), '[0-9]') THEN 'figures'
                 WHEN n_tokens < 100 THEN 'brief' ELSE 'article' END AS topic FROM counted),
coded AS (SELECT *, {code("source")} AS s, {code("lang")} AS l, {code("topic")} AS t FROM topical),
cell AS (SELECT s, l, t, sum(n_tokens)::DOUBLE AS w FROM coded GROUP BY ALL HAVING sum(n_tokens) > 0),
supply AS (SELECT 's' AS d, s AS v, sum(w) AS m FROM cell GROUP BY s UNION ALL SELECT 'l', l, sum(w) FROM cell GROUP BY l UNION ALL SELECT 't', t, sum(w) FROM cell GROUP BY t),
asked(d, v, x) AS (VALUES {asked}),
offered AS (SELECT d, v, x, m FROM asked JOIN supply USING (d, v) WHERE x > 0),
total AS (SELECT least((SELECT sum(w) FROM cell) * {keep!r}, min(h)) AS n FROM (SELECT d, sum(m) AS h FROM offered GROUP BY d)),
scarce AS (
  SELECT *, coalesce(sum(m) OVER before, 0) AS m_before, coalesce(sum(x) OVER before, 0) AS x_before, sum(x) OVER (PARTITION BY d) AS x_all
  FROM offered WINDOW before AS (PARTITION BY d ORDER BY m / x, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
multiple AS (SELECT d, max((n - m_before) / (x_all - x_before)) AS y FROM scarce, total GROUP BY d),
goal AS (SELECT d, v, least(x * y, m) AS g FROM scarce JOIN multiple USING (d)),
begun AS (
  SELECT c.*, coalesce(a.g, 0) AS gs, coalesce(b.g, 0) AS gl, coalesce(e.g, 0) AS gt,
         CASE WHEN a.g > 0 AND b.g > 0 AND e.g > 0 THEN (SELECT n FROM total) / sum(w) OVER () ELSE 0 END AS r
  FROM cell c LEFT JOIN goal a ON a.d = 's' AND a.v = s LEFT JOIN goal b ON b.d = 'l' AND b.v = l LEFT JOIN goal e ON e.d = 't' AND e.v = t),
raked(k, moved, s, l, t, w, gs, gl, gt, r) AS (
  SELECT 0, 1.0::DOUBLE, s, l, t, w, gs, gl, gt, r FROM begun
  UNION ALL
  SELECT k + 1, max(abs(rslt - r)) OVER (), s, l, t, w, gs, gl, gt, rslt FROM ({step})),
rated AS (SELECT s, l, t, r AS rate FROM raked WHERE k = (SELECT max(k) FROM raked))
SELECT doc_id, topic, n_tokens, round(coalesce(rate, 0.0), 6) AS rate,
       (floor(coalesce(rate, 0.0)) + CASE WHEN ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0
          < coalesce(rate, 0.0) - floor(coalesce(rate, 0.0)) THEN 1 ELSE 0 END)::BIGINT AS copies
FROM coded LEFT JOIN rated USING (s, l, t)"""


def _clusters(clusters: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """Every round written out over the long form (row, dimension, component)."""
    def nearest(k: int) -> str:
        return f"""
a{k} AS MATERIALIZED (
  SELECT r, min(row(d, c)) AS best
  FROM (SELECT r, c, sum((x - m) * (x - m))::BIGINT AS d FROM flat JOIN c{k} USING (i) GROUP BY r, c) GROUP BY r)"""

    def means(k: int) -> str:
        return f"""
s{k} AS (SELECT best[2] AS c, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM a{k} JOIN flat USING (r) GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT c, i, coalesce(((s - ((s % n) + n) % n) // n)::BIGINT, m) AS m FROM c{k} LEFT JOIN s{k} USING (c, i))"""

    parts = [p for k in range(rounds) for p in (nearest(k), means(k))] + [nearest(rounds)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
flat AS MATERIALIZED (SELECT r, unnest(range(1, 65)) AS i, unnest(v) AS x FROM kept),
first AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM kept QUALIFY c < {clusters}),
c0 AS MATERIALIZED (SELECT c::INT AS c, unnest(range(1, 65)) AS i, unnest(v) AS m FROM first),
{",".join(parts)},
sha AS (SELECT c, sha256(string_agg(m::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c),
found AS (SELECT vec_id, best[2] AS cluster, best[1] AS distance FROM a{rounds} JOIN kept USING (r))
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM found JOIN sha ON cluster = c"""


ORACLE_SQL = {
    "op12_va_clusters": _clusters(),
    "op3_mixing": _mixing(MIX, KEEP, ROUNDS, STILL),
    "op10_line_dedup": _LINE_DEDUP,
}
