"""DuckDB SQL twins of the registered queries (same output names and types)."""

from __future__ import annotations

from ..functions.text import sql_clean, sql_scrape, sql_str, sql_tidy
from ..functions.tokens import sql_words
from ..operators.segment import SEGMENTS
from . import queries as Q

TS = "'%Y-%m-%d %H:%M:%S.%f'"


def _words(expr: str) -> str:
    return sql_words(sql_clean(expr))


LAB = "lab AS (SELECT doc_id, 'q' || CAST(quality AS VARCHAR) AS label FROM labels)"



def _nb(labels: str, docs: str, target: str) -> str:
    """Multinomial NB with Laplace smoothing, fixed-point log-probabilities (DECIMAL(18,9)),
    scores of ``docs`` (doc_id, source, n_chars, text), shares and segments per source."""
    return f"""
WITH {labels},
tr AS (SELECT d.doc_id, l.label, {_words('d.text')} AS w FROM documents d JOIN lab l USING (doc_id)),
trt AS (SELECT label, unnest(w) AS token FROM tr),
cls AS (SELECT label, count(*) AS n_docs FROM tr GROUP BY label),
ctok AS (SELECT label, count(*) AS n_tokens FROM trt GROUP BY label),
v AS (SELECT count(DISTINCT token) AS vsize FROM trt),
prior AS (SELECT c.label, CAST(ln(c.n_docs / (SELECT sum(n_docs) FROM cls)) AS DECIMAL(18,9)) AS lp,
                 coalesce(t.n_tokens, 0) AS n_tokens
          FROM cls c LEFT JOIN ctok t USING (label)),
voc AS (SELECT DISTINCT token FROM trt),
tc AS (SELECT token, label, count(*) AS n FROM trt GROUP BY ALL),
model AS (SELECT voc.token, p.label,
                 CAST(ln((coalesce(tc.n, 0) + 1.0) / CAST(p.n_tokens + 1.0 * v.vsize AS DOUBLE)) AS DECIMAL(18,9)) AS lp
          FROM voc CROSS JOIN prior p CROSS JOIN v
          LEFT JOIN tc ON tc.token = voc.token AND tc.label = p.label),
docs AS (SELECT doc_id, source, n_chars, {_words('text')} AS w FROM ({docs})),
dt AS (SELECT doc_id, unnest(w) AS token FROM docs),
pc AS (SELECT doc_id, token, count(*) AS cnt FROM dt GROUP BY ALL),
sc AS (SELECT pc.doc_id, m.label, sum(CAST(pc.cnt AS DECIMAL(10,0)) * m.lp) AS s
       FROM pc JOIN model m USING (token) GROUP BY ALL),
allsc AS (SELECT d.doc_id, d.source, d.n_chars, p.label,
                 p.lp + CAST(coalesce(sc.s, 0) AS DECIMAL(30,9)) AS score,
                 length(array_to_string(d.w, ' ')) AS len
          FROM docs d CROSS JOIN prior p LEFT JOIN sc ON sc.doc_id = d.doc_id AND sc.label = p.label),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label ASC) AS rk FROM allsc),
pred AS (SELECT doc_id, source, n_chars,
                CASE WHEN len > 4 THEN '__label__' || label ELSE 'unmeasurable' END AS prediction,
                CASE WHEN len > 4 THEN CAST(round(score, 3) AS DOUBLE) END AS score
         FROM ranked WHERE rk = 1),
share AS (SELECT source,
                 count(*) FILTER (WHERE contains(prediction, '{target}')) AS n_target,
                 count(doc_id) FILTER (WHERE contains(prediction, '__label__')) AS n_measurable,
                 count(*) AS n_posts,
                 max(doc_id) AS first_id
          FROM pred GROUP BY source),
share2 AS (SELECT *, CASE WHEN n_measurable > 0 THEN n_target / n_measurable
                          WHEN n_target > 0 THEN 'Infinity'::DOUBLE END AS share FROM share),
seg AS (SELECT s.source AS screen_name, s.first_id AS newest_tweet_id, p.n_chars AS followers,
               s.n_target, s.n_measurable, s.n_posts, s.share AS target_share,
               CASE WHEN coalesce(s.share >= 0.42, false) AND coalesce(p.n_chars >= 5000, false) THEN '{SEGMENTS[0]}'
                    WHEN coalesce(s.share >= 0.42, false) THEN '{SEGMENTS[1]}'
                    WHEN coalesce(p.n_chars >= 3000, false) THEN '{SEGMENTS[2]}'
                    ELSE '{SEGMENTS[3]}' END AS segment
        FROM share2 s JOIN pred p ON p.doc_id = s.first_id)
"""


NB = _nb(LAB, "SELECT * FROM documents", Q.TARGET_CLASS)

# The segmentation: listed users, newest posts up to the cap, activity floor.
_USER = f"source || '-' || CAST(floor(doc_id / {Q.USER_SPAN}) AS BIGINT)"
FLAG = _nb("lab AS (SELECT doc_id, lang AS label FROM documents)", f"""
  SELECT doc_id, u AS source, n_chars, text FROM (
    SELECT *, count(doc_id) OVER (PARTITION BY u) AS n_user FROM (
      SELECT *, {_USER} AS u, row_number() OVER (PARTITION BY {_USER} ORDER BY doc_id DESC) AS nth FROM documents)
    WHERE nth <= {Q.TIMELINE_CAP} AND u IN (
      SELECT {_USER} FROM documents WHERE contains(text, '{Q.SEARCH['keyword']}') AND n_chars >= {Q.SEARCH['min_faves']}
        AND lang = '{Q.SEARCH['lang']}'))
  WHERE n_user > 5""", Q.LANG_TARGET)

EVENTS_TS = f"strftime(ts, {TS})"
RT_TYPES = "('click', 'view')"


def _dedupe(keys: str, where: str = "") -> str:
    return (f"SELECT event_id, user_id, event_type, value, ts FROM ("
            f"SELECT event_id, user_id, event_type, value, {EVENTS_TS} AS ts, "
            f"row_number() OVER (PARTITION BY {keys} ORDER BY event_id) AS rn FROM events) WHERE rn = 1 {where}")


def _kw_values() -> str:
    rows = [f"({sql_str(c)}, {sql_str(k)})" for c, ks in Q.DATA_KEYWORDS.items() for k in ks]
    return "kw(category, keyword) AS (VALUES " + ", ".join(rows) + ")"


def _training(doc_col: bool = True) -> str:
    cols = "d.doc_id, " if doc_col else ""
    return (f"WITH {LAB} SELECT {cols}l.label, '__label__' || l.label || ', ' || "
            f"array_to_string({_words('d.text')}, ' ') AS line FROM documents d JOIN lab l USING (doc_id)")


# Documents' words that occur at least 10 times in all documents, in order, and their n-grams.
VOCAB_WORDS = f"""WITH w0 AS (SELECT doc_id, {_words('text')} AS w FROM documents),
tok AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM w0),
voc AS (SELECT token FROM tok GROUP BY token HAVING count(*) >= 10),
kept AS (SELECT doc_id, list(token ORDER BY pos) AS w FROM tok SEMI JOIN voc USING (token) GROUP BY doc_id),
words AS (SELECT w0.doc_id, coalesce(kept.w, []) AS w FROM w0 LEFT JOIN kept USING (doc_id)),
grams AS (SELECT doc_id, list_concat(w, list_concat(
    list_transform(range(greatest(len(w) - 1, 0)), lambda i: w[i + 1] || ' ' || w[i + 2]),
    list_transform(range(greatest(len(w) - 2, 0)), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))) AS g FROM words)
"""


def _html_links() -> str:
    return r"""WITH l AS (SELECT page_id, list_transform(regexp_extract_all(html, '(?s)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>'),
       lambda e: {'h': regexp_extract(e, '(?s)^<a\s[^>]*?href="([^"]*)"', 1), 't': regexp_extract(e, '(?s)^<a\s[^>]*>(.*?)</a>$', 1)}) AS al FROM pages),
e AS (SELECT page_id, al, len(al) AS n_items, unnest(range(len(al))) AS pos FROM l)
SELECT page_id, pos, (pos + 1) % n_items AS seq, n_items, true AS aligned,
       al[pos + 1].h AS href, regexp_replace(al[pos + 1].t, '<[^<]+?>', '', 'g') AS anchor_text,
       CASE WHEN regexp_matches(al[pos + 1].h, '/[^/]*/') THEN regexp_extract(al[pos + 1].h, '/([^/]*)/', 1) END AS first_segment
FROM e"""


# Straight from the table the pages were built from.
SEARCH_CURSOR = f"""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS i FROM events),
seen AS (SELECT * FROM a WHERE user_id % 5 <> 0 OR i < 2 * {Q.PAGE_POSTS}),
took AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i) AS nth FROM seen WHERE event_type NOT IN {RT_TYPES})
SELECT user_id AS search, nth, event_id, CAST(floor(value) AS BIGINT) AS favorites,
       strftime(ts, '%a %b %d %H:%M:%S +0000 %Y') AS created_at_raw FROM took WHERE nth <= {Q.SEARCH_TOTAL}"""


def _scrape_posts() -> str:
    """Straight from the table the pages were built from."""
    return f"""WITH c AS (SELECT *, conv_id * 100 + turn AS n, count(*) OVER (PARTITION BY conv_id) AS n_items,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations),
p AS (SELECT *, conv_id % 3 = 0 AND turn = 1 AS bare, n % 37 AS user_id, (pos + 1) % n_items AS seq, length(text) * 3 % 2000 AS likes,
       bool_or(conv_id % 3 = 0 AND turn = 1) OVER (PARTITION BY conv_id) AS odd_page FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY conv_id, seq) AS nth FROM p)
SELECT conv_id AS page_id, seq, NOT odd_page AS aligned, user_id, CASE WHEN NOT bare THEN role || turn END AS screen_name,
       'User ' || role AS user_name, CAST(likes AS BIGINT) AS favorites,
       CASE WHEN NOT bare THEN strftime(TIMESTAMP '2019-03-07' + to_minutes(CAST(n % 1000 AS INTEGER)), '%Y-%m-%d %H:%M') END AS created_at,
       {sql_scrape("text || '<b>' || chr(10) || 'RT</b>'")} AS text, n AS tweet_id
FROM f WHERE nth = 1 AND likes >= {Q.MIN_FAVES}"""


# Straight from the table the pages were built from.
SCRAPE_NESTED = f"""
WITH c AS (SELECT *, conv_id * 100 + turn AS n FROM conversations),
r AS (SELECT conv_id, turn, 0 AS quoted, n % 37 AS user_id, n AS tweet_id, text FROM c
      UNION ALL SELECT conv_id, turn, 1, n % 11, n + 1000000000, role FROM c WHERE turn % 3 = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, quoted) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n_items FROM r)
SELECT conv_id AS page_id, pos, (pos + 1) % n_items AS seq, CASE WHEN quoted = 1 THEN pos - 1 END AS parent, user_id, tweet_id,
       {sql_scrape("text")} AS text FROM p"""


# Least-cost words by a table of the cheapest costs of every beginning of a run of letters, one place more a step.
LATTICE_WORDS = f"""
WITH RECURSIVE low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
counted AS (SELECT surface, count(*) AS n FROM (SELECT unnest(regexp_extract_all(t, '[a-z]+')) AS surface FROM low)
            GROUP BY surface HAVING count(*) >= {Q.VOCAB_FLOOR}),
total AS (SELECT CAST(coalesce(sum(n), 0) + 1 AS DOUBLE) AS total FROM counted),
lex AS (SELECT surface, length(surface) AS len, CAST(floor(1000 * ln(total / n)) AS BIGINT) AS cost FROM counted, total),
missing AS (SELECT CAST(floor(1000 * ln(2 * total)) AS BIGINT) AS cost FROM total),
runs AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(t, '([a-z]+) ([a-z]+)', '\\1\\2', 'g'), '[a-z]+')) AS run FROM low),
each AS (SELECT row_number() OVER (ORDER BY run) AS id, run FROM (SELECT DISTINCT run FROM runs)),
starts AS (SELECT id, run, unnest(range(1, length(run) + 1)) AS pos FROM each),
pieces AS (SELECT id, pos, unnest(range(1, length(run) - pos + 2)) AS len, run FROM starts),
words AS (SELECT p.id, p.pos + p.len - 1 AS ending, p.len, lex.cost FROM pieces p JOIN lex ON lex.surface = substr(p.run, p.pos, p.len)),
edges AS (SELECT id, ending, len, cost, 1 AS known FROM words
          UNION ALL SELECT s.id, s.pos, 1, missing.cost, 0 FROM starts s, missing
          WHERE NOT EXISTS (SELECT 1 FROM words w WHERE w.id = s.id AND w.ending = s.pos AND w.len = 1)),
path AS (SELECT id, 0 AS pos, [CAST(0 AS BIGINT)] AS best, [CAST(0 AS BIGINT)] AS n_known, [CAST(0 AS BIGINT)] AS known_chars,
                [CAST(0 AS BIGINT)] AS squares, [CAST(0 AS BIGINT)] AS cost FROM each
         UNION ALL
         SELECT id, pos + 1, list_append(best, best[pos + 2 - len] + edge), list_append(n_known, n_known[pos + 2 - len] + known),
                list_append(known_chars, known_chars[pos + 2 - len] + known * len), list_append(squares, squares[pos + 2 - len] + known * len * len),
                list_append(cost, cost[pos + 2 - len] + known * edge)
         FROM (SELECT p.*, e.len, e.cost AS edge, e.known,
                      row_number() OVER (PARTITION BY p.id ORDER BY p.best[p.pos + 2 - e.len] + e.cost, e.len DESC) AS nth
               FROM path p JOIN edges e ON e.id = p.id AND e.ending = p.pos + 1) WHERE nth = 1),
done AS (SELECT e.run, p.n_known[p.pos + 1] AS n_known, p.known_chars[p.pos + 1] AS known_chars, p.squares[p.pos + 1] AS squares, p.cost[p.pos + 1] AS cost
         FROM path p JOIN each e USING (id) WHERE p.pos = length(e.run)),
found AS (SELECT doc_id, sum(n_known) AS n_known, sum(known_chars) AS known_chars, sum(squares) AS squares, sum(cost) AS cost FROM runs JOIN done USING (run) GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f"CAST(CASE WHEN d.text IS NOT NULL THEN coalesce(f.{c}, 0) END AS BIGINT) AS {c}" for c in ('n_known', 'known_chars', 'squares', 'cost'))}
FROM documents d LEFT JOIN found f USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    seg_counts = " UNION ALL ".join(f"SELECT '{s}' AS segment" for s in SEGMENTS)
    return {
        "clean_documents": f"SELECT doc_id, {sql_clean('text')} AS clean_text FROM documents",
        "clean_pages": f"SELECT page_id, {sql_clean('html')} AS clean_text FROM pages",
        "scrape_clean": f"SELECT page_id, {sql_scrape('html')} AS text FROM pages",
        "html_links": _html_links(),
        "parse_created_at": (
            "SELECT event_id, created_at_text, strftime(strptime(substr(created_at_text, 5), '%b %d %H:%M:%S +0000 %Y')"
            " + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS local_minute FROM ("
            "SELECT event_id, strftime(ts, '%a %b %d %H:%M:%S +0000 %Y') AS created_at_text FROM events)"),
        "parse_jp_time": (
            "SELECT event_id, jp_text, strftime(strptime(jp_text, '%H:%M - %Y年%m月%d日'), '%Y-%m-%d %H:%M') AS minute FROM ("
            "SELECT event_id, strftime(ts, '%-H:%M - %Y年%-m月%-d日') AS jp_text FROM events)"),
        "parse_counts": (
            "SELECT o_orderkey, count_text, TRY_CAST(replace(replace(regexp_replace(count_text, '<[^<]+?>', '', 'g'),"
            " ' いいね', ''), ',', '') AS BIGINT) AS favorites FROM ("
            "SELECT o_orderkey, '<span>' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || ' いいね</span>'"
            " AS count_text FROM orders)"),
        "flatten_json": (
            "SELECT event_id AS tweet_id, user_id, 'u' || user_id AS screen_name, 'User ' || user_id AS user_name,"
            " user_id * 100 AS followers, CAST(length(props) AS BIGINT) AS retweets,"
            " CAST(floor(value) AS BIGINT) AS favorites, strftime(date_trunc('second', ts), " + TS + ") AS created_at,"
            f" props AS text, 'ja' AS lang, event_type IN {RT_TYPES} AS is_retweet FROM events"),
        "drop_retweets": (
            "SELECT event_id AS tweet_id, user_id, 'u' || user_id AS screen_name, CAST(floor(value) AS BIGINT) AS favorites,"
            f" strftime(date_trunc('second', ts), {TS}) AS created_at FROM events WHERE event_type NOT IN {RT_TYPES}"),
        "only_text": f"SELECT event_id AS tweet_id, props AS text FROM events WHERE event_type NOT IN {RT_TYPES}",
        "exclude_replies": "SELECT conv_id, turn, role, text FROM conversations WHERE turn = 0",
        "list_members": ("SELECT c_nationkey AS list_id, c_custkey AS user_id, 'c' || c_custkey AS screen_name,"
                         " c_name AS user_name FROM customer"),
        "search_predicate": (f"SELECT doc_id, source, n_chars FROM documents WHERE contains(text, '{Q.SEARCH['keyword']}')"
                             f" AND n_chars >= {Q.SEARCH['min_faves']} AND lang = '{Q.SEARCH['lang']}'"),
        "stats_by_source": """
SELECT name, count(v) AS n, round(avg(v), 6) AS mean, median(v) AS median, round(stddev_samp(v), 6) AS stddev FROM (
  SELECT source AS name, n_chars::DOUBLE AS v FROM documents UNION ALL SELECT event_type, floor(value)::DOUBLE FROM events)
WHERE v IS NOT NULL GROUP BY name""",
        "keyword_table_label": f"""
WITH w AS (SELECT lang, unnest(list_distinct(regexp_split_to_array(text, '[^a-z]+'))) AS keyword FROM documents),
kw AS (SELECT keyword, list(DISTINCT lang) FILTER (WHERE lang IS NOT NULL) AS langs FROM w WHERE length(keyword) >= 6
       GROUP BY keyword HAVING count(*) BETWEEN {Q.KEYWORD_DF[0]} AND {Q.KEYWORD_DF[1]}),
t AS (SELECT DISTINCT lang || '-' || substr(keyword, 1, 1) AS category, keyword FROM (SELECT unnest(langs) AS lang, keyword FROM kw))
SELECT d.doc_id, t.category, '__label__' || t.category AS label, count(*) AS n_keywords, min(t.keyword) AS first_keyword, max(t.keyword) AS last_keyword
FROM documents d JOIN t ON contains(d.text, t.keyword) GROUP BY d.doc_id, t.category""",
        "lattice_words": LATTICE_WORDS,
        "keyword_label": (f"WITH {_kw_values()} SELECT d.doc_id, kw.category, kw.keyword, '__label__' || kw.category AS label"
                          " FROM documents d JOIN kw ON contains(d.text, kw.keyword)"),
        "user_timeline": (
            "SELECT o.o_orderkey AS tweet_id, o.o_custkey AS user_id, c.c_name AS screen_name, c.c_acctbal AS followers,"
            f" strftime(o.o_orderdate, {TS}) AS created_at FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"),
        "retweeter_edges": (
            "SELECT p.conv_id AS parent_id, r.turn AS retweeter_turn, r.role AS retweeter_name,"
            " 'https://twitter.com/' || p.role || '/status/' || CAST(p.conv_id AS VARCHAR) AS post_url"
            " FROM conversations p JOIN conversations r ON p.conv_id = r.conv_id AND p.turn = 0 AND r.turn > 0"),
        "retweeters_json": (
            "SELECT p.conv_id AS parent_id, CAST(CAST(r.conv_id AS VARCHAR) || '0' || CAST(r.turn AS VARCHAR) AS BIGINT) AS user_id,"
            " r.role AS user_name, r.role || CAST(r.turn AS VARCHAR) AS screen_name,"
            " 'https://twitter.com/' || p.role || '/status/' || CAST(p.conv_id AS VARCHAR) AS post_url"
            " FROM conversations p JOIN conversations r ON p.conv_id = r.conv_id AND p.turn = 0 AND r.turn > 0"),
        "unresolved_users": (
            "SELECT c.c_custkey AS user_id, c.c_name AS screen_name FROM customer c"
            " WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')"),
        "dedupe_first": _dedupe("user_id"),
        "dedupe_first_two_keys": _dedupe("user_id, event_type"),
        "dedupe_last": (
            "SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM (SELECT coalesce(o_custkey, 0) AS o_custkey,"
            " o_orderkey, o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY coalesce(o_custkey, 0)"
            " ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1"),
        "dedupe_then_min_faves": _dedupe("user_id", f"AND value >= {Q.MIN_FAVES}"),
        "cap_per_query": (
            "SELECT event_id, user_id, rank FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id"
            f" ORDER BY event_id DESC) AS rank FROM events WHERE event_type <> 'click') WHERE rank <= {Q.CAP_PER_USER}"),
        "rotate_order": (
            "WITH n AS (SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id)"
            " SELECT c.conv_id, c.turn, n.n_turns, (c.turn + 1) % n.n_turns AS seq FROM conversations c JOIN n USING (conv_id)"),
        "union_sources": (
            "WITH u AS (SELECT c_custkey AS user_id, c_name AS user_name, c_acctbal AS followers, c_mktsegment AS segment,"
            " 1 AS src_priority FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, 2 FROM supplier"
            " UNION ALL SELECT n_nationkey, n_name, NULL, NULL, 3 FROM nation)"
            " SELECT followers, segment, src_priority, user_id, user_name FROM (SELECT coalesce(followers, 0) AS followers,"
            " segment, src_priority, coalesce(user_id, 0) AS user_id, user_name, row_number() OVER (PARTITION BY"
            " coalesce(user_id, 0) ORDER BY src_priority DESC) AS rn FROM u) WHERE rn = 1"),
        "activity_floor": (
            "SELECT o_orderkey AS tweet_id, o_custkey AS user_id FROM orders WHERE o_custkey IN"
            " (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(o_orderkey) > 5)"),
        "tokens_lexicon": (f"SELECT doc_id, array_to_string(w, ' ') AS words, CAST(len(w) AS BIGINT) AS n_words FROM"
                           f" (SELECT doc_id, {_words('text')} AS w FROM documents)"),
        "training_lines": _training(True),
        "weak_training_lines": (
            f"WITH {_kw_values()}, m AS (SELECT d.doc_id, d.source, d.text, kw.category, kw.keyword FROM documents d"
            " JOIN kw ON contains(d.text, kw.keyword)),"
            " c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category, keyword ORDER BY doc_id DESC) AS rn"
            f" FROM m) WHERE rn <= {Q.TRAINING_CAP}),"
            " dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category, keyword, source ORDER BY doc_id DESC)"
            " AS r2 FROM c) WHERE r2 = 1)"
            f" SELECT category, keyword, doc_id, '__label__' || category || ', ' || array_to_string({_words('text')}, ' ')"
            " AS line FROM dd"),
        "training_corpus": _training(False),
        "vocabulary": (f"SELECT token, count(*) AS n FROM (SELECT unnest({_words('text')}) AS token FROM documents)"
                       " GROUP BY token HAVING count(*) >= 10"),
        "ngram_counts": VOCAB_WORDS + "SELECT ngram, count(*) AS n FROM (SELECT unnest(g) AS ngram FROM grams) GROUP BY ngram",
        "lr_features": VOCAB_WORDS + ("SELECT doc_id, CAST(len(g) AS BIGINT) AS n_grams, CAST(len(list_distinct(g)) AS BIGINT) AS n_distinct"
                                      " FROM grams"),
        "lr_holdout": ("SELECT count(*) AS n_scored, (SELECT count(DISTINCT quality) FROM labels WHERE doc_id % 5 <> 0) AS n_classes,"
                       " true AS beats_majority FROM labels JOIN documents USING (doc_id) WHERE doc_id % 5 = 0"),
        "nb_reload_predict": NB + "SELECT doc_id, prediction, score FROM pred",
        "nb_repeated_ids": NB + "SELECT CASE WHEN doc_id % 50 <> 7 THEN doc_id % 50 END AS id, prediction, score FROM pred",
        "tokens_lexicon_join": (f"SELECT CASE WHEN doc_id % 50 <> 7 THEN doc_id % 50 END AS id, array_to_string({_words('text')}, ' ') AS words"
                                " FROM documents"),
        "cap_per_search": ("SELECT event_id, search FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN 'a' ELSE 'b' END AS search,"
                           " row_number() OVER (PARTITION BY event_type = 'click' ORDER BY event_id DESC) AS nth FROM events)"
                           f" WHERE nth <= {Q.TRAINING_CAP}"),
        "search_since": (f"SELECT event_id, user_id, strftime(ts, {TS}) AS ts FROM events WHERE contains(props, '7') AND value >= 10"
                         f" AND ts >= TIMESTAMP '{Q.SINCE}' AND event_type = 'view'"),
        "scrape_posts": _scrape_posts(),
        "scrape_nested": SCRAPE_NESTED,
        "row_counts": f"WITH {LAB} SELECT l.label, count(*) AS n_rows FROM documents d JOIN lab l USING (doc_id) GROUP BY l.label",
        "nb_predict": NB + "SELECT doc_id, prediction, score FROM pred",
        "nb_topk": NB + ("SELECT doc_id, rk AS rank, '__label__' || label AS label, CAST(round(score, 3) AS DOUBLE) AS score"
                         " FROM ranked WHERE rk <= 3"),
        "class_split": NB + (f"SELECT doc_id, source, prediction, CASE WHEN contains(prediction, '{Q.TARGET_CLASS}')"
                             " THEN 'target' ELSE 'other' END AS split, contains(prediction, '__label__') AS measurable FROM pred"),
        "class_share": NB + "SELECT source AS screen_name, n_target, n_measurable, share FROM share2",
        "share_stats": NB + ("SELECT count(share) AS n_users, round(avg(share), 9) AS mean_share,"
                             " round(median(share), 9) AS median_share, round(stddev_samp(share), 9) AS std_share FROM share2"),
        "segment_users": FLAG + "SELECT * FROM seg",
        "segment_counts": FLAG + (f", dim AS ({seg_counts}) SELECT dim.segment, coalesce(n, 0) AS n_users FROM dim LEFT JOIN"
                                " (SELECT segment, count(*) AS n FROM seg GROUP BY segment) c USING (segment)"),
        "batched_sinks": FLAG + (f", dim AS ({seg_counts}) SELECT dim.segment, coalesce(n, 0) AS n_users, coalesce(n, 0) AS n_observed FROM dim LEFT JOIN"
                                " (SELECT segment, count(*) AS n FROM seg GROUP BY segment) c USING (segment)"),
        "partitioned_sinks": FLAG + "SELECT segment, count(*) AS n_users FROM seg GROUP BY segment",
        "nfkc_documents": "SELECT doc_id, text AS text_nfkc FROM documents",
        "tidy_output": f"SELECT CAST(doc_id AS VARCHAR) AS tweet_id, source AS screen_name, {sql_tidy('text')} AS text FROM documents",
        "timeline_json": ("SELECT o_orderkey AS tweet_id, o_custkey AS user_id, o_orderpriority AS text,"
                          f" strftime(o_orderdate, {TS}) AS created_at FROM orders"),
        "csv_round_trip": ("SELECT doc_id, CASE doc_id % 10 WHEN 4 THEN source || ' a+b=50%/c' WHEN 5 THEN NULL ELSE source END AS source,"
                           " CASE doc_id % 10 WHEN 1 THEN 'NA' WHEN 2 THEN '' WHEN 3 THEN '  ' || text || ' ' || chr(9) ELSE text END AS text,"
                           " n_chars FROM documents"),
        "search_cursor_stream": SEARCH_CURSOR,
        "search_cursor_batch": SEARCH_CURSOR,
        "stream_ingest": ("SELECT event_id, user_id, CAST(floor(value) AS BIGINT) AS favorites,"
                          " strftime(ts, '%a %b %d %H:%M:%S +0000 %Y') AS created_at_raw FROM events"
                          f" WHERE event_type NOT IN {RT_TYPES}"),
    }
