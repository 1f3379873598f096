"""DuckDB SQL of the queries that SQL can express: the contracts' own words, over all windows, pairs and documents."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRINGS = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM w, unnest(range(1, len(ws) - 11)) AS t(i) WHERE len(ws) >= 13),
low AS (SELECT s, min(doc_id) AS low FROM g GROUP BY s),
gone AS (SELECT DISTINCT g.doc_id, i + k AS j FROM g JOIN low USING (s), unnest(range(0, 13)) AS r(k) WHERE low < g.doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{_WORD}') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s, least(len(ws), 4) AS k FROM w, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (s, k) WHERE a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
way AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.x, way.y FROM reach JOIN way ON reach.y = way.x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, CAST((SELECT count(*) FROM way WHERE way.x = w.doc_id) AS BIGINT) AS n_links FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)
"""

_ITEM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

CONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{_ITEM}') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '{_ITEM}') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS s FROM b, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS t(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS s FROM d, sizes, unnest(range(1, len(ws) - n + 2)) AS t(i) WHERE len(ws) >= n),
hit AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN win USING (s, n)),
places AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(0, n)) AS r(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

AUDIT = rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
d AS (SELECT doc_id, part, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false)] AS fails FROM t),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM d LEFT JOIN (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS idx FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT filter_order, idx, CAST(step AS INTEGER) AS step, idx[step] AS f FROM o, range(1, 6) AS r(step)),
x AS (SELECT part, filter_order, step, f, n, good, toxic, fails[f] AS here, list_bool_or([fails[k] FOR k IN idx[1:step - 1]]) AS before, len([y FOR y IN fails IF y]) = 1 AS alone FROM m, s),
c AS (SELECT part, filter_order, step, f,
  coalesce(sum(n) FILTER (NOT here AND NOT coalesce(before, false)), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT coalesce(before, false)), 0) AS removed,
  coalesce(sum(n) FILTER (here AND coalesce(before, false)), 0) AS redundant, coalesce(sum(n) FILTER (here AND alone), 0) AS unique_fails,
  coalesce(sum(good) FILTER (here AND NOT coalesce(before, false)), 0) AS good_lost, coalesce(sum(toxic) FILTER (here AND NOT coalesce(before, false)), 0) AS toxic_lost
  FROM x GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))}, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM c
"""


def _whole(scale: int) -> str:
    return f"[floor({scale} * CAST(x AS DOUBLE)) FOR x IN embedding]"


_USABLE = "embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"

TOP_K = f"""
WITH v AS (SELECT vec_id, {_whole(1024)} AS x FROM embeddings WHERE {_USABLE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""


def _round(i: int) -> str:
    """Assignment to the centroids of round i and the centroids that follow from it."""
    return f"""
a{i} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, arg_min(j, d * 64 + j) AS cluster, CAST(min(d) AS BIGINT) AS distance
  FROM (SELECT v.vec_id, v.x, c.j, list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x) AS d FROM v, c{i} c) GROUP BY vec_id),
c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
  SELECT j, list(y ORDER BY p) AS x FROM (SELECT cluster AS j, p, floor(sum(y) / count(*)) AS y FROM (SELECT cluster, unnest(x) AS y, generate_subscripts(x, 1) AS p FROM a{i}) GROUP BY cluster, p) GROUP BY j) m USING (j))"""


#: Sums stay so small that a double's quotient has the floor of the exact one.
CENTROIDS = f"""
WITH v AS MATERIALIZED (SELECT vec_id, {_whole(256)} AS x FROM embeddings WHERE len(embedding) = 64 AND {_USABLE}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS j, x FROM v QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id)) <= 40),{",".join(_round(i) for i in range(6))}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string([CAST(y AS BIGINT) FOR y IN c5.x], ',')) AS centroid_sha256 FROM a5 JOIN c5 ON c5.j = a5.cluster
"""
