"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

import string

from .licenses import DEN, NUM, TEMPLATES

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP10 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')")} AS ws
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh
  FROM w
), e AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT x, y FROM both_ways
  UNION
  SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x
)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles,
       least(s.doc_id, coalesce((SELECT min(y) FROM reach WHERE reach.x = s.doc_id), s.doc_id)) AS component_id
FROM s
"""

OP5 = """
WITH c AS (
  SELECT vec_id, list_transform(range(1, (SELECT max(len(embedding)) + 1 FROM embeddings)),
                                lambda i: coalesce(embedding[i] > 0 AND NOT isnan(embedding[i]), false)) AS bits
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id,
         len(list_filter(range(1, len(q.bits) + 1), lambda i: q.bits[i] <> c.bits[i]))::INTEGER AS distance
  FROM c q, c WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INTEGER AS rank FROM d
)
SELECT query_id, rank, neighbor_id, distance FROM r WHERE rank <= 10
"""

_values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEMPLATES.items())
_bigrams = ("list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))")
_words = f"regexp_extract_all(translate({{}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[a-z0-9]+')"
OP7 = f"""
WITH t AS (
  SELECT name, {_bigrams.format("ws")} AS b FROM (SELECT name, {_words.format("body")} AS ws FROM (VALUES {_values}) v(name, body))
), u AS (
  SELECT DISTINCT doc_id, unnest(list_concat([text], list_concat(
    regexp_split_to_array(text, '\n[\x20\x09-\x0D]*\n'), string_split(text, chr(10))))) AS unit FROM documents
), a AS (
  SELECT doc_id, {_bigrams.format("ws")} AS a FROM (SELECT doc_id, unit, {_words.format("unit")} AS ws FROM u) WHERE len(ws) > 1
), m AS (
  SELECT a.doc_id, a.a, t.name, len(list_intersect(a.a, t.b)) AS shared, len(a.a) + len(t.b) AS sizes FROM a JOIN t
  ON len(a.a) * {NUM} <= len(t.b) * {2 * DEN - NUM} AND len(t.b) * {NUM} <= len(a.a) * {2 * DEN - NUM}
), hit AS (
  SELECT doc_id, a, name, 2.0::DOUBLE * shared / sizes AS score FROM m WHERE 2 * shared * {DEN} >= {NUM} * sizes
), best AS (
  SELECT doc_id, name, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, name) AS nth FROM hit
)
SELECT d.doc_id, best.name AS license, best.score AS score,
       (SELECT count(*) FROM (SELECT DISTINCT u.unit FROM u JOIN (SELECT doc_id, a FROM hit) h ON h.doc_id = u.doc_id
         AND h.a = (SELECT {_bigrams.format("ws")} FROM (SELECT {_words.format("u.unit")} AS ws)) WHERE u.doc_id = d.doc_id))::BIGINT AS n_units
FROM documents d LEFT JOIN best ON best.doc_id = d.doc_id AND best.nth = 1
"""

_terms = (r"regexp_extract_all(translate(coalesce(text, ''), '" + string.ascii_uppercase + "', '" + string.ascii_lowercase
          + r"'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
OP12 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_terms} AS ts FROM documents
), s AS (
  SELECT count(*) FILTER (WHERE len(ts) > 0) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d
), p AS (
  SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t
), q AS (
  SELECT DISTINCT item_id, unnest({_terms}) AS t FROM benchmark
), w AS (
  SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM p, s WHERE t IN (SELECT t FROM q) GROUP BY t
), m AS (
  SELECT r, doc_id, 50 + (50 * len(ts) * n_docs) // n_terms AS m FROM d, s WHERE len(ts) > 0
), f AS (
  SELECT q.item_id, m.doc_id, p.r, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * m.m)))::BIGINT AS score
  FROM q JOIN w ON q.t = w.t JOIN p ON p.t = q.t JOIN m ON m.r = p.r GROUP BY q.item_id, m.doc_id, p.r
), o AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM f WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50
"""

ORACLE = {
    "op12_ranked_search": OP12,
    "op5_topk_search": OP5,
    "op7_license_scan": OP7,
    "op10_jaccard_join": OP10,
}
