"""The same results in plain SQL, written apart from the Spark plans."""

from __future__ import annotations

from tidewire.functions.vectors import projection_matrix

FIRST_MS = 1_704_067_200_000
HOUR_MS = 3_600_000
DAY_MS = 86_400_000
SEED = 7

_SPACE = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


def _collapsed(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{_SPACE}', ' ', 'g'))"


def _plain(expr: str) -> str:
    """Markup removed and the entities that occur in the pages decoded."""
    bare = f"regexp_replace({expr}, '<[^>]+>', ' ', 'g')"
    for entity, char in (("&copy;", "chr(169)"), ("&middot;", "chr(183)"), ("&quot;", "chr(34)")):
        bare = f"replace({bare}, '{entity}', {char})"
    return _collapsed(f"regexp_replace({bare}, '&amp;?', '&', 'g')")


def _hash60(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15) AS BIGINT)"


_N_DOCS = "(SELECT count(*) FROM documents)"
_N_VECS = "(SELECT count(*) FROM embeddings)"
_STAMP = f"({FIRST_MS} + doc_id * {HOUR_MS})"
_AS_OF = f"({FIRST_MS} + {_N_DOCS} * {HOUR_MS})"

_ARTICLES = f"""
articles AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, split_part(text, chr(10), 1) AS title,
         text AS intro, [lang, source] AS tags, {_STAMP} AS stamp
  FROM documents)"""

_CORPUS = f"""
corpus AS MATERIALIZED (
  SELECT CAST(doc_id AS VARCHAR) AS article_id, doc_id,
         CASE WHEN doc_id % 7 = 0 THEN '' ELSE split_part(text, chr(10), 1) END AS title,
         CASE WHEN doc_id % 5 <> 0 THEN substr({_plain('text')}, 1, 1000) END AS summary,
         [lang, source] AS tags,
         CASE WHEN doc_id % 11 <> 0 THEN {_STAMP} END AS stamp,
         CAST(t.embedding AS DOUBLE[]) AS v0, CAST(d.embedding AS DOUBLE[]) AS v1,
         CAST(g.embedding AS DOUBLE[]) AS v2
  FROM documents
  JOIN embeddings t ON t.vec_id = doc_id % {_N_VECS}
  JOIN embeddings d ON d.vec_id = (doc_id * 7 + 3) % {_N_VECS}
  JOIN embeddings g ON g.vec_id = (doc_id * 13 + 5) % {_N_VECS})"""

_REQUESTS = f"""
clicks AS (
  SELECT user_id, event_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events WHERE event_type = 'click'),
asked AS (
  SELECT CAST(user_id AS VARCHAR) AS request_id, event_id % {_N_DOCS} AS clicked_id,
         CASE WHEN user_id % 3 = 0 THEN ['src' || CAST(user_id % 20 AS VARCHAR)]
              ELSE CAST([] AS VARCHAR[]) END AS categories,
         CASE WHEN user_id % 4 = 0 THEN ({_N_DOCS} // 24 + 1) // 2 + 1 END AS days,
         user_id % 5 = 0 AS use_latest
  FROM clicks WHERE rn = 1),
requests AS (
  SELECT asked.*, CAST(embedding AS DOUBLE[]) AS q
  FROM asked JOIN embeddings ON vec_id = clicked_id % {_N_VECS})"""

_TAGS_OK = "(len(r.categories) = 0 OR list_has_any(c.tags, r.categories))"
_RECENT_OK = f"(r.days IS NULL OR coalesce(c.stamp >= {_AS_OF} - r.days * {DAY_MS}, false))"


def _hits(name: str, vector: str, k: int, where: str, source: str = "requests") -> str:
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT request_id, article_id, score,
           row_number() OVER (PARTITION BY request_id ORDER BY score DESC, article_id) AS place
    FROM (SELECT r.request_id, c.article_id,
                 CASE WHEN list_dot_product(r.q, r.q) * list_dot_product(c.{vector}, c.{vector}) > 0
                      THEN round(list_cosine_similarity(r.q, c.{vector}), 9) ELSE 0 END AS score
          FROM {source} r JOIN corpus c ON {where}))
  WHERE place <= {k})"""


def _topk(vector: str, k: int, where: str) -> str:
    return f"""WITH {_CORPUS}, {_REQUESTS}, {_hits('hits', vector, k, where)}
SELECT request_id, article_id, round(score, 6) AS retrieval_score, place AS retrieval_rank
FROM hits"""


def _fused(k: int, where: str, source: str = "requests") -> str:
    lists = ", ".join(_hits(f"l{i}", f"v{i}", 2 * k, where, source) for i in range(3))
    return f"""{lists},
fused AS (
  SELECT * FROM (
    SELECT request_id, article_id, q,
           row_number() OVER (PARTITION BY request_id ORDER BY q DESC, article_id) AS rr
    FROM (SELECT request_id, article_id, round(sum(1.0::DOUBLE / (2 + place - 1)), 9) AS q
          FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)
          GROUP BY ALL))
  WHERE rr <= {k})"""


_FEED = """
feed AS MATERIALIZED (
  SELECT article_id, row_number() OVER (ORDER BY coalesce(stamp, 0) DESC, article_id) AS rr
  FROM corpus ORDER BY rr LIMIT 100)"""

_SEARCHING = "searching AS (SELECT * FROM requests WHERE NOT use_latest)"

_CANDIDATES = f"""{_SEARCHING}, {_fused(50, f'{_TAGS_OK} AND {_RECENT_OK}', 'searching')}, {_FEED},
cands AS (
  SELECT request_id, article_id, q, rr FROM fused
  UNION ALL
  SELECT request_id, article_id, NULL, rr FROM feed JOIN requests ON use_latest)"""

_DOT_SCORED = """
scored AS (
  SELECT cands.*, 0.5 * (1 + list_dot_product(r.q, c.v0)) AS n
  FROM cands JOIN requests r USING (request_id) JOIN corpus c USING (article_id))"""


def _ranked(k: int) -> str:
    return f"""
blended AS (
  SELECT request_id, article_id, rr,
         round(CASE WHEN n < 0.01 THEN coalesce(q, 0) * 0.8 + n * 0.2
                    ELSE coalesce(q, 0) * 0.5 + n * 0.5 END, 6) AS score
  FROM scored),
ranked AS (
  SELECT * FROM (
    SELECT request_id, article_id, score,
           row_number() OVER (PARTITION BY request_id ORDER BY score DESC, rr, article_id) AS rank
    FROM blended)
  WHERE rank <= {k})"""


_FILLED = """CASE WHEN c.title <> '' THEN c.title ELSE a.title END AS title,
       md5(CASE WHEN c.summary <> '' THEN c.summary ELSE a.intro END) AS summary_digest,
       array_to_string(c.tags, '|') AS category, coalesce(c.stamp, a.stamp) AS "timestamp" """

_RESULTS = f"""
SELECT r.request_id, r.rank, r.article_id, {_FILLED}, r.score, length(a.intro) AS full_chars
FROM ranked r JOIN corpus c USING (article_id) JOIN articles a ON a.id = r.article_id"""

_RECOMMEND = f"""WITH {_ARTICLES}, {_CORPUS}, {_REQUESTS}, {_CANDIDATES}, {_DOT_SCORED},
{_ranked(50)} {_RESULTS}"""


_COSINE = f"""WITH {_ARTICLES}, {_CORPUS}, {_REQUESTS}, {_SEARCHING},
{_fused(50, f'{_TAGS_OK} AND {_RECENT_OK}', 'searching').replace('(2 + place - 1)', '(61 + place - 1)')}, {_FEED},
cands AS (
  SELECT request_id, article_id, rr FROM fused
  UNION ALL
  SELECT r.request_id, c.article_id, f.rr FROM feed f JOIN corpus c USING (article_id)
  JOIN requests r ON r.use_latest AND {_TAGS_OK} AND {_RECENT_OK}),
scored AS (
  SELECT cands.*, list_cosine_similarity(r.q, c.v0) AS q, 0.5 * (1 + list_dot_product(r.q, c.v0)) AS n
  FROM cands JOIN requests r USING (request_id) JOIN corpus c USING (article_id)),
{_ranked(20)} {_RESULTS}"""


def _weights(layer: int, fan_out: int, fan_in: int) -> str:
    """A layer of seeded Xavier-uniform weights as one list per unit."""
    unit = (
        f"CAST('0x' || substr(md5(concat_ws(':', '{SEED}', '{layer}', i, j)), 1, 8) AS BIGINT)"
        " / 4294967296.0::DOUBLE"
    )
    limit = f"sqrt(6.0::DOUBLE / {fan_in + fan_out})"
    return f"""
w{layer} AS MATERIALIZED (
  SELECT i, list({limit} * (2 * ({unit}) - 1) ORDER BY j) AS w
  FROM (SELECT range AS i FROM range({fan_out})), (SELECT range AS j FROM range({fan_in}))
  GROUP BY i)"""


def _normed_relu(name: str, source: str, size: int) -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT request_id, article_id,
         list_transform(z, lambda x: greatest((x - m) / sqrt(s + 1e-5), 0)) AS a
  FROM (SELECT *, list_sum(list_transform(z, lambda x: (x - m) * (x - m))) / {size} AS s
        FROM (SELECT *, list_sum(z) / {size} AS m FROM {source})))"""


_MLP = f"""WITH {_ARTICLES}, {_CORPUS}, {_REQUESTS}, {_CANDIDATES},
{_weights(0, 512, 128)}, {_weights(1, 128, 512)}, {_weights(2, 32, 128)}, {_weights(3, 1, 32)},
pu AS MATERIALIZED (
  SELECT request_id, list(list_dot_product(r.q, w[1:64]) ORDER BY i) AS p
  FROM requests r, w0 GROUP BY request_id),
pn AS MATERIALIZED (
  SELECT article_id, list(list_dot_product(c.v0, w[65:128]) ORDER BY i) AS p
  FROM corpus c, w0 GROUP BY article_id),
z0 AS (
  SELECT request_id, article_id, list_transform(list_zip(pu.p, pn.p), lambda x: x[1] + x[2]) AS z
  FROM cands JOIN pu USING (request_id) JOIN pn USING (article_id)),
{_normed_relu('a0', 'z0', 512)},
z1 AS (
  SELECT request_id, article_id, list(list_dot_product(a, w) ORDER BY i) AS z
  FROM a0, w1 GROUP BY request_id, article_id),
{_normed_relu('a1', 'z1', 128)},
a2 AS (
  SELECT request_id, article_id, list(greatest(list_dot_product(a, w), 0) ORDER BY i) AS a
  FROM a1, w2 GROUP BY request_id, article_id),
scored AS (
  SELECT cands.*, 1 / (1 + exp(-list_dot_product(a2.a, w3.w))) AS n
  FROM cands JOIN a2 USING (request_id, article_id), w3),
{_ranked(50)} {_RESULTS}"""

_WORDS = r"[\p{L}\p{N}]+"


def _encoded(source: str, key: str, field: str) -> str:
    """Components of hashed vectors of (key, field, text) rows, in single precision."""
    return f"""
words AS (
  SELECT {key}, {field}, md5(unnest(regexp_extract_all(lower(txt), '{_WORDS}'))) AS h FROM {source}),
slots AS (
  SELECT {key}, {field}, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 64 AS slot,
         sum(CASE WHEN CAST('0x' || substr(h, 9, 1) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS n
  FROM words GROUP BY ALL),
parts AS (
  SELECT {key}, {field}, slot,
         CAST(n / nullif(sqrt(CAST(sum(n * n) OVER (PARTITION BY {key}, {field}) AS DOUBLE)), 0) AS FLOAT) AS value
  FROM slots)"""


def _components(key: str, field: str) -> str:
    return f"""SELECT {key}, {field}, CAST(slot AS INTEGER) AS slot, round(CAST(value AS DOUBLE), 5) AS value
FROM parts WHERE value <> 0"""


_FIELDS = """
texts AS (
  SELECT id AS article_id, 'title' AS field, title AS txt FROM articles
  UNION ALL SELECT id, 'description', intro FROM articles
  UNION ALL SELECT id, 'tags', array_to_string(tags, ' ') FROM articles)"""

_SAID = """
said AS (
  SELECT CAST(conv_id AS VARCHAR) AS request_id, arg_min(text, turn) AS interests
  FROM conversations WHERE role = 'user' GROUP BY conv_id)"""

_QUERY_TEXTS = f"""{_SAID},
query_texts AS (
  SELECT asked.*, array_to_string(list_filter([
           {_plain('d.text')}, {_plain("coalesce(interests, '')")}, array_to_string(categories, ' ')],
           lambda x: x <> ''), '. ') AS txt
  FROM asked JOIN documents d ON d.doc_id = clicked_id LEFT JOIN said USING (request_id))"""


def _encoded_corpus(query_rows: str) -> str:
    """The corpus and the requests as vectors of the hashing encoder."""
    return f"""{_FIELDS},
everything AS (
  SELECT 'a' || article_id AS key, field, txt FROM texts
  UNION ALL SELECT 'q' || request_id, 'query', txt FROM {query_rows}),
{_encoded('everything', 'key', 'field')},
keys AS (SELECT key, field FROM everything),
vecs AS MATERIALIZED (
  SELECT key, field, list(coalesce(CAST(value AS DOUBLE), 0) ORDER BY s.slot) AS v
  FROM keys CROSS JOIN (SELECT range AS slot FROM range(64)) s
  LEFT JOIN parts USING (key, field, slot) GROUP BY key, field),
corpus AS (
  SELECT a.id AS article_id, title, substr({_plain('intro')}, 1, 1000) AS summary, tags, stamp,
         t.v AS v0, d.v AS v1, g.v AS v2
  FROM articles a
  JOIN vecs t ON t.key = 'a' || a.id AND t.field = 'title'
  JOIN vecs d ON d.key = 'a' || a.id AND d.field = 'description'
  JOIN vecs g ON g.key = 'a' || a.id AND g.field = 'tags'),
requests AS (
  SELECT x.*, v.v AS q FROM {query_rows} x JOIN vecs v ON v.key = 'q' || x.request_id AND v.field = 'query')"""


_CONTEXT = f"""WITH {_ARTICLES}, {_REQUESTS.rsplit('requests AS (', 1)[0].rstrip().rstrip(',')},
{_QUERY_TEXTS}, {_encoded_corpus('query_texts')}, {_CANDIDATES}, {_DOT_SCORED}, {_ranked(10)} {_RESULTS}"""

_PORTFOLIO_PARTS = """
lines AS (
  SELECT o_custkey AS cust, l_orderkey, l_partkey, min(l_linenumber) AS line
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
held AS (
  SELECT cust, p_name, p_type, min(row(l_orderkey, line, l_partkey)) AS first_at
  FROM lines JOIN part ON p_partkey = l_partkey GROUP BY ALL),
placed AS (
  SELECT cust, 1 AS section, row_number() OVER (PARTITION BY cust ORDER BY first_at) * 2 AS pos, p_name AS txt FROM held
  UNION ALL
  SELECT cust, 1, row_number() OVER (PARTITION BY cust ORDER BY first_at) * 2 + 1, p_type FROM held
  UNION ALL
  SELECT c_custkey, 2, 1, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 2 = 0
  UNION ALL SELECT c_custkey, 2, 2, c_mktsegment FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT c_custkey, 3, 1, c_name FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey, 3, 2, lower('TERM ' || replace(c_mktsegment, '_', ' ')) FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey, 3, 3, 'LIFE' FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey, 4, 1, 'SAVINGS account' FROM customer WHERE c_custkey % 5 = 0
  UNION ALL SELECT c_custkey, 4, 2, c_mktsegment FROM customer WHERE c_custkey % 5 = 0
  UNION ALL SELECT DISTINCT cust, 5, 1, 'Indian stock market equities shares' FROM held
  UNION ALL SELECT c_custkey, 5, 2, 'mutual funds SIP investment' FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT c_custkey, 5, 3, 'insurance life cover financial planning' FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey, 5, 4, 'bank savings deposit interest rate' FROM customer WHERE c_custkey % 5 = 0
  UNION ALL SELECT c_custkey, 6, 1, 'gold' FROM customer WHERE c_custkey % 7 = 0),
firsts AS (SELECT cust, txt, min(row(section, pos)) AS first_at FROM placed WHERE cust % 11 <> 0 GROUP BY ALL),
portfolio_texts AS (
  SELECT CAST(c_custkey AS VARCHAR) AS request_id, coalesce(txt, '') AS txt
  FROM customer LEFT JOIN (
    SELECT cust, string_agg(txt, '. ' ORDER BY first_at) AS txt FROM firsts GROUP BY cust)
  ON cust = c_custkey)"""

_PORTFOLIO = f"""WITH {_ARTICLES}, {_PORTFOLIO_PARTS},
accepted AS (
  SELECT request_id, txt, CAST([] AS VARCHAR[]) AS categories, CAST(NULL AS INTEGER) AS days,
         false AS use_latest
  FROM portfolio_texts WHERE txt <> ''),
{_encoded_corpus('accepted')}, {_CANDIDATES}, {_DOT_SCORED}, {_ranked(10)} {_RESULTS}"""

_INCOMING = f"""{_ARTICLES},
incoming AS (
  SELECT id, doc_id, title, doc_id AS seq FROM articles
  UNION ALL SELECT id, doc_id, title || '*', doc_id + 1000000000000 FROM articles WHERE doc_id % 10 = 0),
fresh AS (
  SELECT id, arg_max(title, seq) AS title, max(seq) AS seq FROM incoming
  WHERE NOT (doc_id % 2 = 0 AND doc_id % 3 = 0) GROUP BY id)"""

_PAIRS = f"""
tagged AS (
  SELECT CAST(doc_id AS VARCHAR) AS article_id,
         CASE WHEN doc_id % 17 <> 0 THEN [lang, source] ELSE CAST([] AS VARCHAR[]) END AS tags
  FROM documents),
indexed AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', '{SEED}', article_id)), article_id) - 1 AS idx
  FROM tagged),
anchors AS MATERIALIZED (
  SELECT pair, article_id AS anchor_id, tags AS anchor_tags, idx AS anchor_idx
  FROM (SELECT range AS pair, {_hash60(f"'{SEED}'", "'anchor'", 'range')} % {_N_DOCS} AS idx
        FROM range({_N_DOCS})) JOIN indexed USING (idx)),
drawn AS (
  SELECT pair, anchor_tags, t.range AS try,
         {_hash60(f"'{SEED}'", "'try'", 'pair', 't.range')} % {_N_DOCS} AS idx
  FROM anchors CROSS JOIN range(1, 16) t WHERE len(anchor_tags) > 0),
found AS (
  SELECT pair, arg_min(article_id, try) AS found_id
  FROM drawn JOIN indexed USING (idx) WHERE NOT list_has_any(anchor_tags, tags) GROUP BY pair),
negatives AS (
  SELECT a.pair, a.anchor_id, coalesce(found_id, o.article_id) AS negative_id
  FROM (SELECT *, (anchor_idx + 1 + {_hash60(f"'{SEED}'", "'other'", 'pair')} % ({_N_DOCS} - 1)) % {_N_DOCS} AS idx
        FROM anchors) a
  JOIN indexed o USING (idx) LEFT JOIN found USING (pair))"""


_LOSSES = f"""WITH {_CORPUS}, {_PAIRS},
{_weights(0, 512, 128)}, {_weights(1, 128, 512)}, {_weights(2, 32, 128)}, {_weights(3, 1, 32)},
pairs AS MATERIALIZED (
  SELECT pair * 2 AS request_id, anchor_id AS user_id, anchor_id AS article_id, 1.0::DOUBLE AS label FROM negatives
  UNION ALL SELECT pair * 2 + 1, anchor_id, negative_id, 0.0::DOUBLE FROM negatives),
halves AS MATERIALIZED (
  SELECT article_id, list(list_dot_product(c.v0, w[1:64]) ORDER BY i) AS pu, list(list_dot_product(c.v0, w[65:128]) ORDER BY i) AS pn
  FROM corpus c, w0 GROUP BY article_id),
z0 AS (
  SELECT request_id, p.article_id, list_transform(list_zip(u.pu, n.pn), lambda x: x[1] + x[2]) AS z
  FROM pairs p JOIN halves u ON u.article_id = p.user_id JOIN halves n ON n.article_id = p.article_id),
{_normed_relu('a0', 'z0', 512)},
z1 AS (
  SELECT request_id, article_id, list(list_dot_product(a, w) ORDER BY i) AS z
  FROM a0, w1 GROUP BY request_id, article_id),
{_normed_relu('a1', 'z1', 128)},
a2 AS (
  SELECT request_id, article_id, list(greatest(list_dot_product(a, w), 0) ORDER BY i) AS a
  FROM a1, w2 GROUP BY request_id, article_id),
scored AS (
  SELECT request_id, 1 / (1 + exp(-list_dot_product(a2.a, w3.w))) AS n FROM a2, w3)
SELECT label, count(*) AS pairs, round(avg(-ln(CASE WHEN label = 1 THEN n ELSE 1 - n END)), 6) AS mean_loss
FROM pairs JOIN scored USING (request_id) GROUP BY label"""


def _tables(summary: str) -> str:
    """Both tables after a whole ingest, side by side."""
    return f"""WITH {_ARTICLES}
SELECT id AS article_id, length(intro) AS full_chars, stamp AS published_time_unix, doc_id AS point_id,
       title, length({summary}) AS summary_chars, array_to_string(tags, '|') AS tags,
       stamp AS "timestamp", 64 AS width
FROM articles"""


_SUMMARY = f"substr({_plain('intro')}, 1, 1000)"


def _projected(width: int) -> str:
    """Rows of the seeded matrix, by component of the result."""
    matrix = projection_matrix(64, width, SEED)
    rows = ", ".join(f"({j}, [{', '.join(repr(float(x)) for x in matrix[:, j])}]::DOUBLE[])" for j in range(width))
    return f"matrix(j, m) AS (VALUES {rows})"


_TRUSTS = """WITH held AS (
  SELECT c_custkey AS cust, n_name, c_mktsegment, c_name FROM customer JOIN nation ON n_nationkey = c_nationkey),
placed AS (
  SELECT cust, 1 AS pos, n_name AS txt FROM held WHERE cust % 2 = 0
  UNION ALL SELECT cust, 2, c_mktsegment FROM held WHERE cust % 2 = 0
  UNION ALL SELECT cust, 3, n_name FROM held WHERE cust % 3 = 0
  UNION ALL SELECT cust, 4, c_mktsegment FROM held WHERE cust % 3 = 0
  UNION ALL SELECT cust, 5, c_name FROM held WHERE cust % 5 = 0
  UNION ALL SELECT cust, 6, 'mutual funds SIP investment' FROM held WHERE cust % 2 = 0
  UNION ALL SELECT cust, 7, 'real estate investment trust REIT' FROM held WHERE cust % 3 = 0
  UNION ALL SELECT cust, 8, 'infrastructure investment trust InvIT' FROM held WHERE cust % 5 = 0),
firsts AS (SELECT cust, txt, min(pos) AS pos FROM placed GROUP BY cust, txt),
texts AS (SELECT cust, string_agg(txt, '. ' ORDER BY pos) AS txt FROM firsts GROUP BY cust)
SELECT CAST(c_custkey AS VARCHAR) AS request_id, coalesce(txt, '') AS query_text,
       CASE WHEN c_custkey % 2 = 0 THEN 1 END AS sip, CASE WHEN c_custkey % 3 = 0 THEN 1 END AS reit,
       CASE WHEN c_custkey % 5 = 0 THEN 1 END AS invit
FROM customer LEFT JOIN texts ON cust = c_custkey"""


def all_sql() -> dict[str, str]:
    return {
        "article_normalise": f"""WITH raw AS (
  SELECT CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 2 = 0 THEN 'doc-' || doc_id
              ELSE CAST(doc_id AS VARCHAR) END AS id, *, {_STAMP} AS stamp FROM documents)
SELECT id, coalesce(try_cast(id AS BIGINT), CAST('0x' || substr(md5(id), 1, 15) AS BIGINT)) AS point_id,
       length(split_part(text, chr(10), 1)) AS title_chars,
       CASE WHEN doc_id % 4 <> 0 THEN '["' || lang || '","' || source || '"]' ELSE '' END AS tags,
       strftime(make_timestamp(stamp * 1000), '%Y-%m-%d %H:%M:%S') AS published_time,
       CASE WHEN doc_id % 5 NOT IN (0, 3) THEN stamp END AS published_time_unix,
       sha256(text) AS content_key
FROM raw WHERE id <> ''""",
        "payload_projection": f"""SELECT CAST(page_id AS VARCHAR) AS article_id, url AS title,
       substr({_plain('html')}, 1, 1000) AS summary, 'page|' || split_part(url, '/', 3) AS tags
FROM pages""",
        "html_text": f"""SELECT page_id, length(t) AS chars, md5(t) AS digest
FROM (SELECT page_id, {_plain('html')} AS t FROM pages)""",
        "news_text": f"""WITH {_ARTICLES}, whole AS (
  SELECT id, CASE WHEN {_plain('intro')} <> '' THEN {_plain('title')} || '. ' || {_plain('intro')}
                  ELSE {_plain('title')} END AS t FROM articles)
SELECT id, length(t) AS chars, md5(t) AS digest, substr(t, 1, 2000) AS within_context FROM whole""",
        "query_text": f"""WITH {_REQUESTS}, {_QUERY_TEXTS}
SELECT request_id, length(txt) AS chars, md5(txt) AS digest FROM query_texts""",
        "tags_parse": """WITH t AS (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN [lang, source, 'x'] WHEN 2 THEN ['True', '12', source]
                                 ELSE [lang, source] END AS tags FROM documents)
SELECT doc_id, CAST(len(tags) AS INTEGER) AS n, array_to_string(tags, '|') AS tags,
       array_to_string(tags, ' ') AS tags_text FROM t""",
        "typed_articles": """WITH d AS (SELECT *, CAST(doc_id % 10 AS VARCHAR) AS digit FROM documents)
SELECT doc_id,
       CASE WHEN doc_id % 4 < 2 THEN digit END AS economy_score,
       CASE doc_id % 4 WHEN 0 THEN source || ' up' WHEN 1 THEN lang WHEN 2 THEN 'note ' || lang END AS economy_reason,
       CASE WHEN doc_id % 2 = 0 THEN lang || '=' || source || ';Bear=down' ELSE lang || '=' || source END AS perception,
       CASE WHEN doc_id % 2 = 0
            THEN 'Sector:' || source || '/' || digit || '/cuts/' || lang || ',Air/2/fuel/weak'
            ELSE 'S:' || source || '/' || digit || '/r/' || lang END AS impact,
       CASE WHEN doc_id % 2 = 0
            THEN '[{"tag":"' || lang || '","text":"' || source || '"},{"tag":"Bear","text":"down"}]'
            ELSE '[{"tag":"' || lang || '","text":"' || source || '"}]' END AS perception_json
FROM d""",
        "hour_keys": """SELECT strftime(ts + INTERVAL 330 MINUTE, '%Y/%m/%d/%H') AS hour,
       strftime(ts + INTERVAL 330 MINUTE, '%Y/%m/%d/et_%H.json') AS path, count(*) AS events
FROM events GROUP BY ALL""",
        "article_by_id": f"""WITH {_ARTICLES}
SELECT id, title, stamp AS published_time_unix FROM articles WHERE id = '7'""",
        "articles_by_ids": f"""WITH {_ARTICLES}
SELECT id, title, stamp AS published_time_unix FROM articles
WHERE doc_id IN (SELECT doc_id * 2 FROM labels WHERE quality = 1)""",
        "tag_counts": """SELECT tag, count(*) AS articles
FROM (SELECT lang AS tag FROM documents UNION ALL SELECT source FROM documents WHERE source <> lang)
GROUP BY tag""",
        "tag_index": """SELECT lang AS tag, doc_id AS article_id FROM documents
UNION ALL SELECT source, doc_id FROM documents WHERE source <> lang""",
        "vector_stats": """SELECT count(*) AS points_count, count(*) AS title_vec_count,
       count(*) AS description_vec_count, count(*) FILTER (WHERE doc_id % 2 = 0) AS tags_vec_count
FROM documents""",
        "vector_quality": """SELECT vec_id, vec_id % 10 NOT IN (0, 1, 3) AS valid,
       CASE WHEN vec_id % 10 = 2 THEN 0 WHEN vec_id % 10 > 3 THEN round(3 * n, 5) END AS norm,
       CASE WHEN vec_id % 10 = 2 THEN 0 WHEN vec_id % 10 > 3 THEN round(embedding[1]::DOUBLE / n, 5) END AS unit_0,
       CASE WHEN vec_id % 10 = 2 THEN 0 WHEN vec_id % 10 > 3 THEN 1 END::DOUBLE AS cosine,
       CASE WHEN vec_id % 10 = 0 THEN 63 ELSE 64 END AS scoring_width
FROM (SELECT *, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)""",
        "score_blend": """WITH d AS (
  SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 97) / 97.0::DOUBLE ELSE 0 END AS q,
         (doc_id % 53) / 1000.0::DOUBLE AS n FROM documents)
SELECT doc_id, round(CASE WHEN n < 0.01 THEN q * 0.8 + n * 0.2 ELSE q * 0.5 + n * 0.5 END, 6) AS score,
       greatest(0, least(15, doc_id % 31 - 10)) AS clamped, round(n * 100, 1) AS match_percent,
       CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'p' END AS result_id
FROM d""",
        "topk_title": _topk("v0", 50, _TAGS_OK),
        "topk_filtered": _topk("v1", 20, f"{_TAGS_OK} AND {_RECENT_OK}"),
        "topk_by_cells": _topk("v2", 50, f"{_TAGS_OK} AND {_RECENT_OK}"),
        "fusion_topk": f"""WITH {_CORPUS}, {_REQUESTS}, {_fused(50, f'{_TAGS_OK} AND {_RECENT_OK}')}
SELECT request_id, article_id, round(q, 6) AS retrieval_score, rr AS retrieval_rank FROM fused""",
        "latest_feed": f"""WITH {_ARTICLES}, {_CORPUS}, {_FEED}
SELECT f.article_id, {_FILLED}, 1.0::DOUBLE AS score, length(a.intro) AS full_chars
FROM feed f JOIN corpus c USING (article_id) JOIN articles a ON a.id = f.article_id WHERE rr <= 50""",
        "feed_display": f"""WITH {_ARTICLES}, {_CORPUS}, {_FEED}
SELECT f.article_id, CASE WHEN c.title <> '' THEN c.title WHEN a.title <> '' THEN a.title
                          ELSE 'Untitled Article' END AS title,
       length(CASE WHEN c.summary <> '' THEN c.summary ELSE a.intro END) AS summary_chars,
       array_to_string(c.tags[1:3], '|') AS categories,
       strftime(make_timestamp(a.stamp * 1000), '%b %-d, %Y') AS display_date,
       100.0::DOUBLE AS match_percent
FROM feed f JOIN corpus c USING (article_id) JOIN articles a ON a.id = f.article_id WHERE rr <= 50""",
        "recommend": _RECOMMEND,
        "recommend_cosine": _COSINE,
        "recommend_mlp": _MLP,
        "recommend_latest": f"""WITH {_CORPUS}, {_REQUESTS}, {_FEED}
SELECT r.request_id, c.article_id, f.rr AS retrieval_rank
FROM feed f JOIN corpus c USING (article_id) JOIN requests r ON {_TAGS_OK} AND {_RECENT_OK}""",
        "recommend_context": _CONTEXT,
        "recommend_portfolio": _PORTFOLIO,
        "portfolio_text": f"""WITH {_PORTFOLIO_PARTS}
SELECT request_id, txt AS query_text FROM portfolio_texts""",
        "portfolio_trusts": _TRUSTS,
        "portfolio_rejected": f"""WITH {_PORTFOLIO_PARTS}
SELECT request_id, 'no content to search for' AS reason FROM portfolio_texts WHERE txt = ''""",
        "portfolio_sections": """WITH equities AS (
  SELECT o_custkey AS cust, CAST(count(DISTINCT o_orderkey) AS INTEGER) AS n
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY cust)
SELECT CAST(c_custkey AS VARCHAR) AS request_id,
       CASE WHEN c_custkey % 5 = 0 AND c_custkey % 11 <> 0 THEN 1 END AS deposits,
       CASE WHEN c_custkey % 11 <> 0 THEN n END AS equities,
       CASE WHEN c_custkey % 2 = 0 AND c_custkey % 11 <> 0 THEN 1 END AS mutualfunds,
       CASE WHEN c_custkey % 3 = 0 AND c_custkey % 11 <> 0 THEN 1 END AS insurance_policies,
       CAST(NULL AS INTEGER) AS sip
FROM customer LEFT JOIN equities ON cust = c_custkey""",
        "idempotent_new": f"WITH {_INCOMING} SELECT id, title, seq FROM fresh",
        "capped_new": f"WITH {_INCOMING} SELECT id, seq FROM fresh ORDER BY seq LIMIT 500",
        "incremental_since": f"""WITH {_ARTICLES}
SELECT id, stamp AS published_time_unix, length(title) AS title_chars FROM articles
WHERE stamp > {FIRST_MS} + {_N_DOCS} // 2 * {HOUR_MS}""",
        "oldest_articles": f"""WITH {_ARTICLES}
SELECT id, stamp AS published_time_unix FROM articles ORDER BY stamp, id LIMIT 100""",
        "nested_text": """SELECT doc_id, '{"score":' || doc_id % 10 || ',"reason":"' || lang || '"}' AS economyimpact,
       '[{"type":"Sector","entity":[{"name":"' || source || '","score":"' || doc_id % 5
         || '","reason":"r"}]}]' AS impact_matrix,
       '[{"tag":"' || lang || '","text":"' || source || '"}]' AS perception_lines,
       '["' || lang || '","' || source || '"]' AS tags
FROM documents""",
        "max_published": f"""WITH {_ARTICLES}
SELECT max(stamp) AS max_published, count(*) AS n, max(stamp) FILTER (WHERE stamp % 2 = 0) AS mark
FROM articles""",
        "run_metrics": """WITH o AS (
  SELECT CASE WHEN doc_id % 13 = 0 THEN 'error' WHEN doc_id % 6 = 0 THEN 'skipped'
              WHEN doc_id % 2 = 0 THEN 'ingested' ELSE 'left' END AS o FROM documents),
c AS (SELECT count(*) AS total, count(*) FILTER (WHERE o = 'ingested') AS ingested,
             count(*) FILTER (WHERE o = 'skipped') AS skipped,
             count(*) FILTER (WHERE o = 'error') AS errors,
             count(*) FILTER (WHERE o = 'left') AS remaining FROM o)
SELECT *, round(100.0::DOUBLE * (ingested + skipped) / total, 1) AS percent_done FROM c""",
        "embed_corpus": f"""WITH {_ARTICLES}, {_FIELDS}, {_encoded('texts', 'article_id', 'field')}
{_components('article_id', 'field')}""",
        "embed_common": f"""WITH {_ARTICLES}, whole AS (
  SELECT id AS article_id, 'common' AS field,
         CASE WHEN {_plain('intro')} <> '' THEN {_plain('title')} || '. ' || {_plain('intro')}
              ELSE {_plain('title')} END AS txt FROM articles),
{_encoded('whole', 'article_id', 'field')} {_components('article_id', 'field')}""",
        "projected_vectors": f"""WITH {_ARTICLES}, titles AS (SELECT id AS article_id, 'projected' AS field, title AS txt FROM articles),
{_encoded('titles', 'article_id', 'field')}, {_projected(8)},
whole AS (
  SELECT article_id, field, list(coalesce(CAST(value AS DOUBLE), 0) ORDER BY s.slot) AS v
  FROM (SELECT DISTINCT article_id, field FROM parts) CROSS JOIN (SELECT range AS slot FROM range(64)) s
  LEFT JOIN parts USING (article_id, field, slot) GROUP BY article_id, field),
moved AS (SELECT article_id, field, j, list_dot_product(v, m) AS z FROM whole, matrix)
SELECT article_id, field, CAST(j AS INTEGER) AS slot,
       round(CAST(CAST(z / sqrt(sum(z * z) OVER (PARTITION BY article_id)) AS FLOAT) AS DOUBLE), 5) AS value
FROM moved""",
        "training_scan": f"""WITH {_ARTICLES}
SELECT id, title, md5(intro) AS intro_digest, '["' || tags[1] || '","' || tags[2] || '"]' AS tags FROM articles""",
        "dry_run_counts": """SELECT 'backfill' AS job, count(*) AS total, 0::BIGINT AS runs FROM documents
UNION ALL SELECT 'drop_in', count(*), 0 FROM documents""",
        "hourly_without_ids": f"""WITH {_ARTICLES}
SELECT CASE WHEN doc_id % 3 <> 0 THEN id END AS given_id,
       CASE WHEN doc_id % 3 = 0 THEN CAST(row_number() OVER (PARTITION BY doc_id // 24 ORDER BY doc_id) - 1 AS INTEGER) END AS place, title
FROM articles""",
        "hourly_reread": f"""WITH {_ARTICLES} SELECT title, 2::BIGINT AS runs FROM articles""",
        "embed_dedupe": f"""WITH whole AS (SELECT doc_id, 'text' AS field, text AS txt FROM documents),
{_encoded('whole', 'doc_id', 'field')} {_components('doc_id', 'field')}""",
        "content_groups": """SELECT sha256(text) AS content_key, count(*) AS copies
FROM documents GROUP BY 1""",
        "training_pairs": f"""WITH {_PAIRS}
SELECT pair * 2 AS pair_id, anchor_id AS user_id, anchor_id AS news_id, 1.0::DOUBLE AS label FROM negatives
UNION ALL
SELECT pair * 2 + 1, anchor_id, negative_id, 0.0::DOUBLE FROM negatives""",
        "pair_losses": _LOSSES,
        "training_sample": f"""WITH {_PAIRS}
SELECT article_id, array_to_string(tags, '|') AS tags FROM indexed WHERE idx < 500""",
        "ingest_lake": _tables(_SUMMARY),
        "ingest_backfill": _tables(_SUMMARY),
        "ingest_json": _tables(_SUMMARY),
        "csv_stream": _tables(_SUMMARY),
        "ingest_drop_in": _tables(_SUMMARY),
        "quarantined": """SELECT CAST(doc_id AS VARCHAR) AS article_id,
       CASE WHEN doc_id % 7 = 0 THEN 'unreadable article' ELSE 'stored' END AS outcome FROM documents""",
        "ingest_runs": f"""WITH {_ARTICLES}, c AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE doc_id % 3 = 0) AS part, max(stamp) AS top,
         max(stamp) FILTER (WHERE doc_id % 3 = 0) AS part_top FROM articles)
SELECT 0 AS batch, part AS total, part AS ingested, 0::BIGINT AS skipped, 0::BIGINT AS errors,
       part_top AS mark, 'done' AS status FROM c
UNION ALL
SELECT 1, n, n - part, part, 0, (SELECT max(stamp) FROM articles WHERE doc_id % 3 <> 0), 'done' FROM c""",
        "hourly_stream": f"""WITH {_ARTICLES}
SELECT id AS article_id, doc_id AS point_id,
       CASE WHEN doc_id % 3 <> 0 AND title <> '' THEN title ELSE 'original ' || id END AS title,
       length({_SUMMARY}) AS summary_chars, array_to_string(tags, '|') AS tags, stamp AS "timestamp",
       strftime(make_timestamp(stamp * 1000), '%Y-%m-%d %H:%M:%S.%f') AS published_time,
       CAST(doc_id % 10 AS INTEGER) AS economy_impact, 64 AS width
FROM articles""",
    }
