"""The same rows as the queries, in DuckDB's SQL."""

from __future__ import annotations

from tidewire.llm.licenses import PHRASES, TEMPLATES, block_words, template_words
from tidewire.llm.quality import STOP_WORDS

_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

OP8 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         row_number() OVER () AS r
  FROM documents
), windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM windows) WHERE n > 1
), places AS (
  SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS p FROM twice
), repeats AS (
  SELECT r, count(*) AS n FROM places GROUP BY r
), m AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines,
         len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop_words
  FROM d LEFT JOIN repeats USING (r)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars >= 2.0 * n_words AND word_chars <= 16.0 * n_words
       AND n_symbols <= 0.1::DOUBLE * n_words AND n_stop_words >= 0.01::DOUBLE * n_words
       AND n_dup_lines <= 0.5::DOUBLE * n_lines AS kept
FROM b
"""

OP1 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 9))::BIGINT AS place
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source
), steps AS (
  SELECT w, source_size, 3.0 * source_size / w AS stops,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER a, 0))::DOUBLE AS left_over,
         (sum(w) OVER () - coalesce(sum(w) OVER a, 0))::DOUBLE AS share
  FROM s WINDOW a AS (ORDER BY 3.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT min_by(left_over / share, stops) AS v FROM steps WHERE w * (left_over / share) <= 3 * source_size
), goals AS (
  SELECT source, source_size, least(w * v, (3 * source_size)::DOUBLE) AS target,
         CASE WHEN source_size > 0 THEN floor(least(w * v, (3 * source_size)::DOUBLE) / source_size) ELSE 0 END::BIGINT AS whole
  FROM s, level
), tied AS (
  SELECT source, place, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY place) AS past
  FROM d GROUP BY source, place
), taken AS (
  SELECT t.source, place,
         past <= g.target - whole * source_size
         OR (past - n <= g.target - whole * source_size
             AND 2 * (g.target - whole * source_size - (past - n)) >= n) AS more
  FROM tied t JOIN goals g ON t.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, (size * (whole + (more AND size > 0)::INT))::BIGINT AS taken
FROM d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
JOIN taken t ON d.source IS NOT DISTINCT FROM t.source AND d.place = t.place
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w
  FROM documents
), g AS (
  SELECT DISTINCT r, array_to_string(w[i:i + 2], ' ') AS t
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT r, count(*) AS n FROM g GROUP BY r
), near AS (
  SELECT a.r AS a, b.r AS b FROM g a JOIN g b ON a.t = b.t AND a.r < b.r
  JOIN n na ON na.r = a.r JOIN n nb ON nb.r = b.r
  WHERE 100 * least(na.n, nb.n) >= 90 * greatest(na.n, nb.n)
  GROUP BY a.r, b.r, na.n, nb.n HAVING 190 * count(*) >= 90 * (na.n + nb.n)
), links AS (
  SELECT a, b FROM near UNION SELECT b, a FROM near
), reach AS (
  SELECT a, b FROM links UNION SELECT x.a, l.b FROM reach x JOIN links l ON x.b = l.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, min(o.doc_id)) AS component_id
FROM d LEFT JOIN n USING (r) LEFT JOIN reach ON reach.a = d.r LEFT JOIN d o ON o.r = reach.b
GROUP BY d.r, d.doc_id, n.n
"""

_SIGN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP4 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_SIGN_WORD}') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_SIGN_WORD}') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT k FROM windows
), runs AS (
  SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS t
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d JOIN sizes ON len(w) >= k)
), found AS (
  SELECT r, i, runs.k, item_id FROM runs JOIN windows USING (k, t)
), hit AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM found) GROUP BY r
), items AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

_NOTICES = ", ".join(
    f"({i}, '{label}', {template_words(text)!r}, {block_words(text)})" for i, (label, text) in enumerate(TEMPLATES)
)
_PHRASES = ", ".join(f"('{label}', '{phrase}', {len(phrase.split())})" for phrase, label in PHRASES.items())

OP9 = rf"""
WITH t(template, label, words, span) AS (VALUES {_NOTICES}),
p(label, phrase, k) AS (VALUES {_PHRASES}),
d AS (
  SELECT row_number() OVER () AS r, doc_id, text,
         regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_SIGN_WORD}') AS w
  FROM documents
), places AS (
  SELECT r, label, i - 1 AS place
  FROM (SELECT r, w, label, phrase, k,
               unnest(list_filter(range(1, len(w) - k + 2), lambda i: w[i] = split_part(phrase, ' ', 1))) AS i
        FROM d, p WHERE len(w) >= k)
  WHERE array_to_string(w[i:i + k - 1], ' ') = phrase
), base AS (
  SELECT r, count(*) AS n, min(place) AS a, max(place) AS z,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY r
), distinct_words AS MATERIALIZED (
  SELECT r, w, list_distinct(w) AS held FROM d
), close AS MATERIALIZED (
  SELECT r, w, label, words, span, len(words) AS size FROM distinct_words, t
  WHERE len(list_intersect(words, held)) >= ceil(round(0.9::DOUBLE * len(words), 9))
), windows AS (
  SELECT r, label, words, size, list_distinct(w[i:i + span - 1]) AS s
  FROM (SELECT *, unnest(list_filter(range(1, len(w) + 1), lambda i: list_contains(words, w[i]))) AS i FROM close)
), found AS (
  SELECT r, label, len(list_intersect(s, words)) AS n, size FROM windows
), notices AS (
  SELECT r, label, n / size AS share FROM found WHERE n >= ceil(round(0.9::DOUBLE * size, 9))
), labels AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT r, label FROM notices UNION SELECT r, label FROM places) GROUP BY r
), best AS (
  SELECT r, max(share) AS share FROM notices GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word,
       coalesce(base.labels, '') AS base_labels, coalesce(labels.labels, '') AS labels,
       CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN labels USING (r) LEFT JOIN best USING (r)
"""


def _crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII text, bit by bit."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(({text})[i])::UBIGINT)"
    steps = "list_reduce(list_prepend(xor(a, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {codes}), lambda a, b: {steps}), 4294967295::UBIGINT)::BIGINT"


OP11 = rf"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id
           ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations
), own AS (
  SELECT c, list({{'role': role, 'text': text}} ORDER BY place) AS turns FROM t GROUP BY c
), h AS (
  SELECT c, turns, {_crc32("c::VARCHAR")} % 4 AS h FROM own
), rebuilt AS (
  SELECT h.c, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns
  FROM h LEFT JOIN own b ON b.c = h.c - h.c % 20
), members AS (
  SELECT c, len(turns) AS n, turns[1:d] AS prefix, d
  FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT prefix, d, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256,
         CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(prefix[d].text, '[^\x20\x09-\x0D]+')) END AS words
  FROM members GROUP BY prefix, d
), kids AS (
  SELECT prefix[1:d - 1] AS prefix, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), valued AS (
  SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN kids USING (prefix, d)
), above AS (
  SELECT prefix[1:e] AS prefix, e AS d, n_children = 0 AS leaf, (n_convs - 1) * words AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM valued)
), totals AS (
  SELECT prefix, d, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY ALL
)
SELECT v.conv_id, v.d::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM valued v JOIN totals USING (prefix, d)
LEFT JOIN nodes p ON v.d > 0 AND p.d = v.d - 1 AND p.prefix = v.prefix[1:v.d - 1]
"""


def _digest(values: list[str]) -> str:
    parts = [f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in values]
    return f"sha256({' || '.join(parts)})"


_LEVELS = """
  SELECT {key}, 0 AS lvl, pos, h FROM {leaves}
  UNION ALL
  SELECT {key}, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, max(pos) OVER (PARTITION BY {key}) AS top FROM {name}) WHERE top > 0 GROUP BY {key}, lvl, pos // 2
"""
# A fold takes one level at a time: the digest beside its siblings, in order.
_FOLDS = """
  SELECT doc_id, {key}, 0 AS lvl, pos, new, '' AS proof FROM {leaves}
  UNION ALL
  SELECT f.doc_id, f.{key}, f.lvl + 1, f.pos // 2,
         sha256(CASE WHEN f.pos % 2 = 1 THEN s.h || f.new ELSE f.new || coalesce(s.h, '') END),
         f.proof || coalesce(s.h, '')
  FROM {name} f JOIN heights t ON t.{key} IS NOT DISTINCT FROM f.{key} AND f.lvl < t.height
  LEFT JOIN up s ON s.{key} IS NOT DISTINCT FROM f.{key} AND s.lvl = f.lvl AND s.pos = xor(f.pos, 1)
"""
OP12 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS k, {_digest(["doc_id", "source", "lang", "n_chars", "text"])} AS h,
         CASE WHEN {_crc32("doc_id::VARCHAR")} % 7 = 0 THEN
           {_digest(["doc_id", "source", "lang", "(n_chars + 1)", "text"])} END AS other
  FROM documents
), leaves AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, h, coalesce(other, h) AS new FROM d
), up AS ({_LEVELS.format(key="k", leaves="leaves", name="up")}
), heights AS (
  SELECT k, max(lvl) AS height FROM up GROUP BY k
), low AS ({_FOLDS.format(key="k", leaves="leaves", name="low")}
), subroots AS (
  SELECT k, h AS subroot, row_number() OVER (ORDER BY k) - 1 AS pos FROM up JOIN heights USING (k) WHERE lvl = height
), groups AS (
  SELECT 0 AS g, pos, subroot AS h FROM subroots
), over AS ({_LEVELS.format(key="g", leaves="groups", name="over")}
), tallest AS (
  SELECT max(lvl) AS height FROM over
), high AS (
  SELECT doc_id, low.k, 0 AS lvl, s.pos, new, proof FROM low JOIN heights t ON t.k = low.k AND lvl = height JOIN subroots s ON s.k = low.k
  UNION ALL
  SELECT f.doc_id, f.k, f.lvl + 1, f.pos // 2,
         sha256(CASE WHEN f.pos % 2 = 1 THEN s.h || f.new ELSE f.new || coalesce(s.h, '') END),
         f.proof || coalesce(s.h, '')
  FROM high f JOIN tallest t ON f.lvl < t.height LEFT JOIN over s ON s.lvl = f.lvl AND s.pos = xor(f.pos, 1)
)
SELECT high.doc_id, leaves.h AS leaf, subroot, over.h AS root, sha256(proof) AS proof_sha256, high.new AS folded_root, high.new = over.h AS verified
FROM high JOIN tallest ON lvl = height JOIN over ON over.lvl = height JOIN leaves USING (doc_id) JOIN subroots ON subroots.k = leaves.k
"""


def all_sql() -> dict[str, str]:
    return {
        "op1_mixing": OP1,
        "op4_decontaminate": OP4,
        "op6_ngram_join": OP6,
        "op8_quality_rules": OP8,
        "op9_licenses": OP9,
        "op11_prefix_trie": OP11,
        "op12_merkle_manifest": OP12,
    }
