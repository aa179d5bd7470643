"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

#: Words of every document, numbered from 1; {words} is the expression of a text's words.
_SPLIT = "list_filter(regexp_split_to_array({t}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"
_TEXT = "coalesce(text, '')"
_LOWER = f"translate({_TEXT}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TEXT} AS t, {_SPLIT.format(t=_TEXT)} AS w FROM documents),
lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^ \\t\\n\\x0B\\f\\r]')) AS ls FROM d),
words AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
triples AS (SELECT r, p, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM words WINDOW o AS (PARTITION BY r ORDER BY p)),
repeated AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, x, y, z) AS c FROM triples WHERE z IS NOT NULL) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM repeated) GROUP BY r),
m AS (
  SELECT d.r, doc_id, t, w, ls, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM d JOIN lines USING (r) LEFT JOIN covered USING (r)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 5 * word_chars OR 2 * n_dup_lines > len(ls)
            OR 2 * len(list_filter(w, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) > n_words
            OR 2 * len(list_filter(w, lambda x: NOT regexp_matches(x, '\\p{{L}}'))) > n_words OR word_chars > 100 * n_words) AS kept
FROM m"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_SPLIT.format(t=_TEXT)} AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
windows AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS p
            FROM (SELECT doc_id, list_transform(range(1, len(w) - 18), lambda q: array_to_string(w[q:q + 19], ' ')) AS s FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM windows) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM later),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPLIT.format(t=_LOWER)} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda q: array_to_string(w[q:q + 3], ' ')))
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
           FROM tokens a JOIN tokens b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
edges AS (SELECT a, b FROM common UNION ALL SELECT b, a FROM common),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)"""

_BASE32 = "substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substring(h, 1 + 5 * k, 5))::BIGINT >> {shift}) & 31)::INTEGER, 1)"
WARC = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, url, html, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS response FROM p)
SELECT page_id, url, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 8), lambda k: {' || '.join(_BASE32.format(shift=s) for s in (15, 10, 5, 0))}), '') AS payload_digest,
       CASE WHEN response = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN response <> page_id THEN response END AS refers_to
FROM h"""

_ESCAPES = "len(regexp_extract_all({x}, '<\\\\*\\|'))"
CHAT = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(24 + length(role) + {_ESCAPES.format(x='role')} + length(text) + {_ESCAPES.format(x='text')})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""
