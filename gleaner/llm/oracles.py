"""DuckDB SQL for those of this folder's queries that SQL can express on whole tables."""

from __future__ import annotations

OP1 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k)
),
m AS (SELECT doc_id, i, p.k, item_id FROM dw JOIN p ON dw.k = p.k AND dw.win = p.win),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM m) GROUP BY doc_id),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN o ON d.doc_id = o.doc_id
"""

OP10 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS max_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.max_doc AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

OP7 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + least(5, len(w)) - 1], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(s::VARCHAR, ',' ORDER BY s)) AS whole FROM s GROUP BY doc_id),
c AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY whole, n) AS rep FROM n),
r AS (SELECT doc_id, n FROM c WHERE doc_id = rep),
-- of similar sets the shorter holds 3/4 of its shingles in the other, so they share one of its rarest quarter and a bit
f AS (SELECT s, count(*) AS df FROM s JOIN r USING (doc_id) GROUP BY s HAVING count(*) > 1),
t AS (SELECT s.doc_id, s.s, r.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY coalesce(f.df, 1), s.s) AS nth FROM s JOIN r USING (doc_id) LEFT JOIN f USING (s)),
p AS (SELECT * FROM t WHERE nth <= n - CAST(ceil(0.75 * n) AS BIGINT) + 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn FROM p a JOIN p b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)),
i AS (SELECT a, b, an, bn, count(*) AS shared FROM cand JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND x.s = y.s GROUP BY a, b, an, bn),
e AS (SELECT a, b FROM i WHERE 100 * shared >= 75 * (an + bn - shared)),
u AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS x, doc_id AS y FROM r UNION SELECT reach.x, u.y FROM reach JOIN u ON reach.y = u.x),
comp AS (SELECT x AS rep, min(y) AS root FROM reach GROUP BY x)
SELECT w.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, coalesce(comp.root, w.doc_id) AS component_id, coalesce(comp.root, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN c ON w.doc_id = c.doc_id LEFT JOIN comp ON c.rep = comp.rep
"""

OP9 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400)),
r AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
s AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM w SEMI JOIN r USING (k)),
g AS (SELECT doc_id, i, count(*) FILTER (WHERE prev IS NULL OR i > prev + 200) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM s),
sp AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM g GROUP BY doc_id, g),
kept AS (SELECT sp.doc_id, lag(z, 1, 0) OVER (PARTITION BY sp.doc_id ORDER BY a) AS f, a AS t FROM sp UNION ALL SELECT doc_id, max(z), NULL FROM sp GROUP BY doc_id),
k AS (SELECT d.doc_id, string_agg(substr(h, 2 * f + 1, 2 * (coalesce(t, len(h) // 2) - f)), '' ORDER BY f) AS kept FROM kept JOIN d USING (doc_id) GROUP BY d.doc_id),
n AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM sp GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(from_hex(coalesce(k.kept, h))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""

STOPS = """
  'the', 'and', 'of', 'to', 'in', 'is', 'that', 'it', 'was', 'for', 'on', 'are', 'as', 'with', 'be', 'this', 'from', 'by', 'at', 'or', 'an', 'not',
  'der', 'die', 'und', 'das', 'den', 'von', 'zu', 'mit', 'sich', 'des', 'auf', 'für', 'ist', 'im', 'nicht', 'dem', 'ein', 'eine', 'als',
  'de', 'la', 'le', 'et', 'les', 'du', 'un', 'une', 'que', 'est', 'pour', 'qui', 'dans', 'par', 'sur', 'pas', 'au', 'avec',
  'el', 'los', 'las', 'del', 'se', 'y', 'por', 'con', 'una', 'su', 'para', 'es', 'al', 'lo', 'no', 'en'"""

OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
t AS (SELECT r, i, w[i : i + 2] AS win FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM t) WHERE n > 1),
m AS (SELECT r, count(DISTINCT pos) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS pos FROM p) GROUP BY r),
f AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    CAST(len(list_filter(w, lambda x: x IN ({STOPS}))) AS BIGINT) AS n_stop_words
  FROM d LEFT JOIN l ON l.r = d.r LEFT JOIN m ON m.r = d.r
),
b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    concat_ws(',', CASE WHEN 1000 * word_chars NOT BETWEEN 2000 * n_words AND 12000 * n_words THEN 'word length' END, CASE WHEN 1000 * n_symbols > 100 * n_words THEN 'symbols' END,
      CASE WHEN 1000 * n_stop_words < 10 * n_words THEN 'stop words' END, CASE WHEN 1000 * n_dup_lines > 500 * n_lines THEN 'repeated lines' END, CASE WHEN 1000 * n_words < 1500 * n_lines THEN 'words a line' END) AS broken_rules
  FROM f
)
SELECT *, NOT base_failed AND broken_rules = '' AS kept FROM b
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1, "op7_near_dedup": OP7, "op9_substring_dedup": OP9, "op10_line_dedup": OP10, "op12_quality_rules": OP12}
