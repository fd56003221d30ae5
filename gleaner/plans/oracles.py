"""DuckDB SQL for the queries of ``catalog.py``."""

from __future__ import annotations

from gleaner.functions.urls import OPEN_POLICIES, POLICIES
from gleaner.sources.manifest import KINDS

MEMBERS = ["docs/a.html", "/etc/a.md", "a/../b.txt", "docs/img.png", "README.md", "x.PDF", "docs/sub/b.htm", "noext", "docs/.md"]
GLOBS = ["", "docs/*.html", "*.md,docs/*", "?.PDF"]
PATHS = ["README.md", "setup.py", "src/a/b.py", "src/a/__pycache__/b.pyc", "docs/x.part", "data/raw/open/a.pdf", "tests/data/raw/a.py", ".gitignore", "evaluation/q.yaml", "docs/.DS_Store"]
WRITTEN_IN = ["utf-8", "cp1252", "cp850", "mac_roman"]
RARE = ["zzzunknownzzz", "https", "password"]


def _q(v: object) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


def _values(rows: list[tuple], *names: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_q, r)) + ')' for r in rows)}) v({', '.join(names)}))"


def squeezed(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def normal(x: str) -> str:
    return squeezed(f"replace(lower({x}), 'ß', 'ss')")


def tokens(x: str) -> str:
    return rf"regexp_extract_all({normal(x)}, '[a-z0-9ı]+(?:[._/+\-][a-z0-9ı]+)*|[\x{{3400}}-\x{{9fff}}]+')"


LINES = f"lines AS (SELECT doc_id, pos - 1 AS pos, {squeezed('line')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents))"

BM25 = f"""
tok AS (SELECT doc_id AS chunk_id, unnest({tokens("source || ' ' || text")}) AS token FROM documents),
post AS (SELECT chunk_id, token, count(*) AS tf FROM tok GROUP BY ALL),
len AS (SELECT d.doc_id AS chunk_id, count(t.token) AS dl FROM documents d LEFT JOIN tok t ON t.chunk_id = d.doc_id GROUP BY d.doc_id),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
raw AS (SELECT token, count(*) AS df, ln((SELECT n FROM corpus) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post GROUP BY token),
stats AS (SELECT n, avgdl, (SELECT avg(raw) FROM raw) AS avg_idf, (SELECT count(*) FROM raw) AS n_terms FROM corpus),
vocab AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * avg_idf ELSE raw END AS idf FROM raw, stats)"""


def bm25(questions: str, k: int, name: str = "lexical", tie: str = "chunk_id") -> str:
    return f"""{BM25},
asked AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest({tokens("query")}) AS token FROM {questions}) GROUP BY ALL),
hits AS (
  SELECT query_id, chunk_id, CAST(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS FLOAT) AS score
  FROM asked JOIN vocab USING (token) JOIN post USING (token) JOIN len USING (chunk_id), stats GROUP BY query_id, chunk_id
),
every AS (SELECT q.query_id, d.doc_id AS chunk_id, coalesce(h.score, 0) AS score FROM {questions} q CROSS JOIN documents d LEFT JOIN hits h ON h.query_id = q.query_id AND h.chunk_id = d.doc_id),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {tie}) AS rank FROM every) WHERE rank <= {k})"""


QUESTIONS = "(SELECT item_id AS query_id, text AS query FROM benchmark)"


def dense(k: int, name: str = "dense") -> str:
    return f"""{name} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
      SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score
      FROM embeddings q, embeddings e WHERE q.vec_id IN (SELECT item_id FROM benchmark))) WHERE rank <= {k})"""


FUSED = f"""{bm25(QUESTIONS, 50)}, {dense(50)},
fused AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
      SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, max(CASE WHEN stage = 'bm25' THEN rank END) AS bm25_rank, max(CASE WHEN stage = 'dense' THEN rank END) AS dense_rank
      FROM (SELECT query_id, chunk_id, rank, 'bm25' AS stage FROM lexical UNION ALL SELECT query_id, chunk_id, rank, 'dense' FROM dense) GROUP BY query_id, chunk_id)) WHERE rank <= 50)"""


def excerpts(pairs: str, size: int) -> str:
    """``pairs``: pid, query, text. Gives (pid, excerpt)."""
    stride = max(120, size // 2)
    return f"""terms AS (SELECT DISTINCT pid, term FROM (SELECT pid, unnest({tokens("query")}) AS term FROM {pairs}) WHERE length(term) >= 2),
starts AS (SELECT DISTINCT pid, s FROM (SELECT pid, unnest(list_append(range(0, greatest(1, length(text) - {size} + 1), {stride}), greatest(0, length(text) - {size}))) AS s FROM {pairs} WHERE length(text) > {size})),
weights AS (
  SELECT s.pid, s.s, coalesce(sum(length(term) * (length(lower(substr(text, s.s + 1, {size}))) - length(replace(lower(substr(text, s.s + 1, {size})), term, '')))), 0) AS w
  FROM starts s JOIN {pairs} p ON p.pid = s.pid LEFT JOIN terms t ON t.pid = s.pid GROUP BY s.pid, s.s
),
best AS (SELECT pid, s, w FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY w DESC, s) AS nth FROM weights) WHERE nth = 1),
shown AS (SELECT p.pid, CASE WHEN length(p.text) <= {size} THEN p.text ELSE substr(p.text, best.s + 1, {size}) END AS excerpt FROM {pairs} p LEFT JOIN best ON best.pid = p.pid)"""


EVIDENCE = f"""{bm25(QUESTIONS, 5)},
near AS (SELECT l.query_id, b.text AS query, l.rank, l.chunk_id, d.text, d.source AS title, d.lang FROM lexical l JOIN benchmark b ON b.item_id = l.query_id JOIN documents d ON d.doc_id = l.chunk_id),
spend AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM near),
evidence AS (SELECT query_id, query, rank, chunk_id, title, lang, 'S' || place AS citation, substr(text, 1, CAST(6500 - spent AS BIGINT)) AS text FROM spend WHERE place <= 5 AND spent < 6500)"""

def measured(ranking: str, keys: str = "query_id") -> str:
    """``per``: the metrics of each of ``keys`` (columns of the ranking: query_id, chunk_id, rank) against ``rel`` (query_id, chunk_id)."""
    own = ", ".join(f"d.{k}" for k in keys.split(", "))
    return f"""n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY query_id),
j AS (SELECT {own}, d.rank, r.chunk_id IS NOT NULL AS hit, coalesce(n.n, 0) AS n FROM {ranking} d LEFT JOIN rel r ON r.query_id = d.query_id AND r.chunk_id = d.chunk_id LEFT JOIN n ON n.query_id = d.query_id),
per AS (
  SELECT {keys}, {", ".join(f"CASE WHEN max(n) > 0 THEN count(*) FILTER (WHERE hit AND rank <= {k}) / max(n)::DOUBLE ELSE 0 END AS recall_at_{k}, CASE WHEN count(*) FILTER (WHERE hit AND rank <= {k}) > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit_at_{k}" for k in (5, 10, 20))},
    coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE hit AND rank <= 10), 0) AS mrr_at_10,
    CASE WHEN max(n) > 0 THEN coalesce(sum(1.0::DOUBLE / log2(rank + 1)) FILTER (WHERE hit AND rank <= 10), 0) / (SELECT sum(1.0::DOUBLE / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= max(j.n)) ELSE 0 END AS ndcg_at_10
  FROM j GROUP BY {keys})"""


METRICS = f"""{dense(20)},
rel AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
{measured("dense")}"""
NAMES = [*(f"recall_at_{k}" for k in (5, 10, 20)), *(f"hit_at_{k}" for k in (5, 10, 20)), "mrr_at_10", "ndcg_at_10"]
STOPS = ["chr(10) || chr(10)", "'。'", "'！'", "'？'", "'. '", "'! '", "'? '", "'；'", "'; '"]


def _last_stop(low: str, high: str) -> str:
    """End of the latest stop within [low, high) of s, or NULL."""
    w = f"substr(s, {low} + 1, {high} - ({low}))"
    return f"(SELECT max({low} + length({w}) - instr(reverse({w}), reverse(d)) + 1) FROM (VALUES {', '.join(f'({d})' for d in STOPS)}) v(d) WHERE instr({w}, d) > 0)"


def _end(start: str) -> str:
    return f"CASE WHEN {start} + 900 >= length(s) THEN length(s) ELSE coalesce({_last_stop(f'({start} + 540)', f'({start} + 900)')}, {start} + 900) END"


def chunks_of(text: str) -> str:
    """``pieces``: the chunks of an expression over each document."""
    return f"""docs AS (SELECT doc_id, {text} AS s FROM documents),
RECURSIVE_STEP AS (
  SELECT doc_id, s, 0 AS i, 0 AS a, {_end("0")} AS z FROM docs WHERE length(s) > 0
  UNION ALL
  SELECT doc_id, s, i + 1, b, {_end("b")} FROM (
    SELECT doc_id, s, i, CASE WHEN length(s) - aim < 180 THEN greatest(a + 1, length(s) - 180) ELSE aim END AS b FROM (
      SELECT *, coalesce({_last_stop("greatest(a + 1, greatest(a + 1, z - 120) - 60)", "z")}, greatest(a + 1, z - 120)) AS aim FROM RECURSIVE_STEP WHERE z < length(s)))
),
pieces AS (
  SELECT doc_id AS document_id, i AS chunk_index, a + length(raw) - length(ltrim(raw)) AS char_start, z - (length(raw) - length(rtrim(raw))) AS char_end, trim(raw) AS text, s
  FROM (SELECT *, substr(s, a + 1, z - a) AS raw FROM RECURSIVE_STEP)
)""".replace("RECURSIVE_STEP", "step")


CHUNKS = chunks_of(squeezed("text"))

HEADING = r"length(line) BETWEEN 1 AND 100 AND right(line, 1) NOT IN ('。', '！', '？', '.', '!', '?', '；', ';', '，', ',') AND (regexp_matches(line, '^第[一二三四五六七八九十百零〇0-9]+(?:章|节|部分|篇)') OR regexp_matches(line, '^[一二三四五六七八九十]+[、.]\s*\S+') OR regexp_matches(line, '^\(?[0-9]{1,2}\)?[、.]\s*\S+') OR regexp_matches(line, '^(?i:chapter|section|part|appendix)\s+(?i:[A-Z0-9IVX]+)') OR regexp_matches(line, '^[A-Z][A-Z0-9 /&(),.-]{5,80}$'))"
MARKDOWN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '^\s*>\s?', ''), '[*_~]{1,3}', '', 'g')"
_OPEN = ", ".join(map(_q, OPEN_POLICIES))
_HOST = r"regexp_extract(url, '^https?://([^/?#]+)', 1)"
_SRC = f"""(SELECT CAST(page_id AS INTEGER) AS pos, CASE WHEN page_id % 11 = 0 THEN 'Bad Id ' || page_id WHEN page_id % 11 = 5 THEN 'twice_' || (page_id // 22) ELSE 'src_' || page_id END AS id,
  CASE WHEN page_id % 7 = 0 THEN 'unknown' ELSE [{", ".join(map(_q, POLICIES))}][1 + page_id % 4] END AS policy, page_id % 3 <> 0 AS enabled, CASE WHEN page_id % 13 = 0 THEN 'ftp' WHEN page_id % 2 = 0 THEN 'file' ELSE 'webpage' END AS kind,
  CASE WHEN page_id % 17 <> 0 THEN url END AS url, CASE WHEN page_id % 9 = 0 THEN '' ELSE {_HOST} END AS hosts, CASE WHEN page_id % 5 = 0 THEN page_id % 20 + 0.5 END AS mb FROM pages)"""
_HOSTS = "('thther.example.org', 'm.therou.example.com', 'therin.example.net')"
_FIRST = "CASE WHEN doc_id % 3 > 0 THEN doc_id % 7 + 1 END"
_LAST = f"CASE WHEN doc_id % 5 > 0 THEN {_FIRST} + (doc_id % 3 - 1) END"

_TIE = "CAST(chunk_id AS VARCHAR)"
_BARE = r"replace(lower(regexp_replace(text, '\s+', '', 'g')), 'ß', 'ss')"
_ROUNDED = ", ".join(f"round({n}, 9) AS {n}" for n in NAMES)
_MEANS = ", ".join(f"round(avg({n}), 9) AS {n}" for n in NAMES)

#: The evaluation job: benchmark texts bound to the documents that hold them, ranked by BM25 and reranked, with metrics and their means.
EVALUATED = f"""
WITH forms AS (SELECT doc_id, length(text) AS size, {_BARE} AS f FROM documents),
wanted AS (SELECT item_id, text, {_BARE} AS f FROM benchmark),
near AS (SELECT item_id AS query_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY size, CAST(doc_id AS VARCHAR)) AS place FROM wanted w JOIN forms d ON contains(d.f, w.f)),
rel AS (SELECT * FROM near WHERE place <= 4),
bound AS (SELECT b.item_id AS query_id, b.text AS query, d.lang AS language FROM benchmark b JOIN rel ON rel.query_id = b.item_id AND place = 1 JOIN documents d ON d.doc_id = rel.chunk_id),
{bm25("bound", 30, tie=_TIE)},
pair AS (SELECT l.query_id || '/' || l.chunk_id AS pid, l.query_id, l.chunk_id, b.query, d.text FROM lexical l JOIN bound b ON b.query_id = l.query_id JOIN documents d ON d.doc_id = l.chunk_id),
{excerpts("pair", 420)},
weighed AS (SELECT s.pid, CAST(coalesce(sum(length(term) * (length(lower(excerpt)) - length(replace(lower(excerpt), term, '')))), 0) AS DOUBLE) AS score FROM shown s LEFT JOIN terms t ON t.pid = s.pid GROUP BY s.pid),
ranked AS (
  SELECT 'bm25' AS mode, query_id, chunk_id, rank FROM lexical WHERE rank <= 20
  UNION ALL SELECT 'rerank', query_id, chunk_id, rank FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {_TIE}) AS rank FROM pair JOIN weighed USING (pid)) WHERE rank <= 20),
{measured("ranked", "mode, query_id")},
lists AS (SELECT mode, query_id, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY rank) AS retrieved, min_by(source, rank) AS first_source FROM ranked JOIN documents ON doc_id = chunk_id GROUP BY mode, query_id),
own AS (SELECT query_id, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY place) AS relevant FROM rel GROUP BY query_id),
rows AS (SELECT * FROM per JOIN lists USING (mode, query_id) JOIN own USING (query_id) JOIN bound USING (query_id))
SELECT mode, language, CAST(query_id AS VARCHAR) AS query_id, 1 AS query_count, relevant AS relevant_chunk_ids, retrieved AS retrieved_chunk_ids, first_source AS first_result_source_id, {_ROUNDED} FROM rows
UNION ALL SELECT mode, language, NULL, count(*), NULL, NULL, NULL, {_MEANS} FROM rows GROUP BY GROUPING SETS ((mode), (mode, language))
"""

_NUMBER = r"^(?:第\s*)?[-—–]?\s*[0-9]{1,4}\s*(?:页|/\s*[0-9]{1,4})?\s*[-—–]?$"
_ENDED = "(f.alone OR (f.size > 240 AND right(f.line, 1) IN ('。', '！', '？', '.', '!', '?', '；', ';', '：', ':')))"
OUTLINES = f"""{LINES},
outlines AS (SELECT doc_id, pos, line FROM lines UNION ALL SELECT -1 - p_partkey // 20, p_partkey % 20, {squeezed("CASE WHEN p_partkey % 4 = 0 THEN 'Chapter ' || p_size || ' ' || p_name WHEN p_partkey % 4 = 1 THEN p_type WHEN p_partkey % 4 = 2 THEN p_size || '. ' || p_name ELSE p_name || '.' END")} FROM part)"""


def end_paths(test: str, level: str) -> str:
    """``ends``: doc_id, n, path of every document of the outlines, folded over the lines that meet a test."""
    return f"""{OUTLINES},
own AS (SELECT doc_id, coalesce(list(line ORDER BY pos) FILTER (WHERE {test}), []) AS t, coalesce(list({level} ORDER BY pos) FILTER (WHERE {test}), []) AS l FROM outlines GROUP BY doc_id),
fold AS (SELECT doc_id, t, l, 0 AS i, CAST([] AS VARCHAR[]) AS path FROM own UNION ALL SELECT doc_id, t, l, i + 1, list_append(path[1 : l[i + 1] - 1], t[i + 1]) FROM fold WHERE i < len(t)),
ends AS (SELECT doc_id, len(t) AS n, array_to_string(path, ' > ') AS path FROM fold WHERE i = len(t))"""


#: ``blocks``: page_id, pos, kind, level, line. The pages hold paragraphs and a title in one article, some paragraphs are left open; an opened one ends with the paragraph that closes it, or the article.
PAGE_BLOCKS = f"""tok AS (SELECT page_id, unnest(l) AS t, generate_subscripts(l, 1) AS nr FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>|[^<]+') AS l FROM pages)),
deep AS (SELECT *, sum(CASE WHEN t IN ('<p>', '<h1>') THEN 1 WHEN t IN ('</p>', '</h1>') THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY nr) AS depth FROM tok),
placed AS (SELECT *, count(*) FILTER (WHERE t IN ('<p>', '<h1>') AND depth = 1) OVER (PARTITION BY page_id ORDER BY nr) AS block FROM deep),
named AS (SELECT page_id, block, t = '<h1>' AS title FROM placed WHERE t IN ('<p>', '<h1>') AND depth = 1),
shown AS (SELECT page_id, block, {squeezed("string_agg(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', chr(39)), '&amp;', '&'), ' ' ORDER BY nr)")} AS line FROM placed WHERE NOT starts_with(t, '<') AND depth > 0 GROUP BY page_id, block),
blocks AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY block) - 1 AS pos, CASE WHEN title OR ({HEADING}) THEN 'heading' ELSE 'paragraph' END AS kind,
    CASE WHEN title THEN 1 WHEN {HEADING} THEN CASE WHEN length(line) <= 35 THEN 1 ELSE 2 END END AS level, line FROM shown JOIN named USING (page_id, block) WHERE line <> '')"""

SQL: dict[str, str] = {
    "zip_member_filter": f"""
WITH r AS (SELECT page_id, replace([{", ".join(map(_q, MEMBERS))}][1 + page_id % {len(MEMBERS)}], 'a', 'p' || page_id) AS name, globs FROM pages, {_values([(g,) for g in GLOBS], "globs")} b)
SELECT page_id, name, globs, NOT starts_with(name, '/') AND NOT list_contains(string_split(name, '/'), '..') AND lower(regexp_extract(name, '\\.([^.]+)$', 1)) IN ('pdf', 'html', 'htm', 'md', 'txt')
  AND regexp_matches(regexp_extract(name, '[^/]*$'), '^.+\\.[^.]+$') AND (globs = '' OR len(list_filter(string_split(globs, ','), lambda g: name GLOB replace(g, '[', '[[]'))) > 0) AS allowed FROM r""",
    "page_links": r"""
WITH a AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+') AS base, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS l FROM pages),
u AS (SELECT page_id, base, unnest(l) AS l, generate_subscripts(l, 1) - 1 AS pos FROM a)
SELECT page_id, CAST(pos AS INTEGER) AS pos, base || regexp_extract(l, 'href="([^"]*)"', 1) AS href, trim(regexp_extract(l, '>([^<]*)<', 1)) AS text FROM u""",
    "page_titles": rf"SELECT page_id, nullif({squeezed("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '') AS title FROM pages",
    "page_blocks": f"""
WITH RECURSIVE {PAGE_BLOCKS},
heads AS (SELECT page_id, list(line ORDER BY pos) AS t, list(level ORDER BY pos) AS l FROM blocks WHERE level IS NOT NULL GROUP BY page_id),
fold AS (SELECT page_id, t, l, 0 AS i, CAST([] AS VARCHAR[]) AS path FROM heads UNION ALL SELECT page_id, t, l, i + 1, list_append(path[1 : l[i + 1] - 1], t[i + 1]) FROM fold WHERE i < len(t)),
c AS (SELECT *, count(level) OVER (PARTITION BY page_id ORDER BY pos) AS nth FROM blocks)
SELECT c.page_id, CAST(pos AS INTEGER) AS pos, kind, coalesce(array_to_string(path, ' > '), '') AS path, sha256(line) AS sha256 FROM c LEFT JOIN fold ON fold.page_id = c.page_id AND fold.i = c.nth""",
    "build_report_of_pages": f"""
WITH {PAGE_BLOCKS},
p AS (SELECT page_id, {_HOST} AS source_id, coalesce(n, 0) AS n FROM pages LEFT JOIN (SELECT page_id, sum(length(line) + 2) - 2 AS n FROM blocks GROUP BY page_id) USING (page_id))
SELECT source_id, 'html' AS file_type, count(*) AS documents, count(*) FILTER (WHERE n >= 40) AS accepted, count(*) FILTER (WHERE n < 40) AS rejected, CAST(coalesce(sum(n) FILTER (WHERE n >= 40), 0) AS BIGINT) AS characters,
  0 AS warnings, CASE WHEN count(*) FILTER (WHERE n < 40) > 0 THEN 'text too short: x ' || count(*) FILTER (WHERE n < 40) ELSE '' END AS errors FROM p GROUP BY source_id""",
    "content_receipts": "SELECT page_id, url, strlen(html) AS bytes, sha256(html) AS sha256 FROM pages",
    "safe_filename": "SELECT page_id, coalesce(nullif(substr(trim(regexp_replace(url_decode(replace(url, '+', '%2B')), '[^A-Za-z0-9._-]+', '-', 'g'), '-._'), 1, 180), ''), 'download') AS filename FROM pages",
    "url_guard": f"SELECT page_id, starts_with(url, 'https://') AND {_HOST} IN {_HOSTS} AS https_only, {_HOST} IN {_HOSTS} AS any_scheme FROM pages",
    "manifest_violations": f"""
WITH s AS {_SRC}
SELECT pos, id, 'id' AS rule FROM s WHERE NOT regexp_matches(id, '^[a-z0-9][a-z0-9_-]*$') UNION ALL SELECT pos, id, 'policy' FROM s WHERE policy NOT IN ({", ".join(map(_q, POLICIES))})
UNION ALL SELECT pos, id, 'kind' FROM s WHERE kind NOT IN ({", ".join(map(_q, KINDS))}) UNION ALL SELECT pos, id, 'urls' FROM s WHERE url IS NULL UNION ALL SELECT pos, id, 'hosts' FROM s WHERE hosts = ''
UNION ALL SELECT pos, id, 'repeated' FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM s) WHERE n > 1""",
    "source_selection": f"SELECT pos, id FROM {_SRC} s WHERE enabled AND policy IN ({_OPEN})",
    "policy_group": f"SELECT pos, CASE WHEN policy IN ({_OPEN}) THEN 'open' ELSE 'restricted' END AS output_group FROM {_SRC} s",
    "effective_settings": f"SELECT id, CAST(coalesce(mb, 100) * 1048576 AS BIGINT) AS max_file_size_bytes, 60.0::DOUBLE AS timeout_seconds, 5 AS retries FROM {_SRC} s",
    "clean_text": f"SELECT doc_id, sha256({squeezed('text')}) AS sha256 FROM documents",
    "normalize_text": f"SELECT doc_id, sha256({normal('text')}) AS sha256 FROM documents",
    "strip_markdown": f"SELECT doc_id, sha256({squeezed(MARKDOWN)}) AS sha256 FROM documents",
    "tokenize_documents": f"SELECT doc_id, len(w) AS n_tokens, sha256(array_to_string(w, ' ')) AS sha256 FROM (SELECT doc_id, {tokens('text')} AS w FROM documents)",
    "token_frequencies": f"SELECT token, count(*) AS n FROM (SELECT unnest({tokens('text')}) AS token FROM documents) GROUP BY token",
    "decoded_pages": f"SELECT page_id, [{', '.join(map(_q, WRITTEN_IN))}][1 + page_id % {len(WRITTEN_IN)}] AS written_in, true AS right FROM pages",
    "stable_ids": "SELECT doc_id, 'doc_' || substr(sha1(source || '::' || doc_id), 1, 20) AS document_id, 'chk_' || substr(sha1(source || chr(31) || doc_id || chr(31) || text), 1, 20) AS chunk_id FROM documents",
    "heading_lines": f"WITH {OUTLINES} SELECT doc_id, CAST(pos AS INTEGER) AS pos, line, CASE WHEN length(line) <= 35 THEN 1 ELSE 2 END AS level FROM outlines WHERE {HEADING}",
    "section_paths": f"WITH RECURSIVE {end_paths('true', 'CAST(pos AS INTEGER) * 7 % 4 + 1')} SELECT doc_id, path FROM ends",
    "heading_paths": f"WITH RECURSIVE {end_paths(HEADING, 'CASE WHEN length(line) <= 35 THEN 1 ELSE 2 END')} SELECT doc_id, CAST(n AS INTEGER) AS n_headings, path FROM ends",
    "page_char_stats": """
SELECT conv_id AS document_id, count(*) AS pages, count(*) FILTER (WHERE length(text) < 30) AS sparse_pages, round(avg(length(text)), 6) AS mean_chars,
  count(*) FILTER (WHERE length(text) < 30) / count(*)::DOUBLE >= 0.4 OR avg(length(text)) < 80 AS ocr_recommended FROM conversations GROUP BY conv_id""",
    "repeated_edge_lines": rf"""
WITH {LINES},
p AS (SELECT doc_id, doc_id // 10 AS document_id, list(line ORDER BY pos) AS l FROM lines WHERE length(line) > 0 GROUP BY doc_id),
e AS (SELECT document_id, unnest(list_concat(l[1:3], l[greatest(1, len(l) - 2) : len(l)])) AS line FROM p),
b AS (SELECT document_id, greatest(3, floor(count(*) * 0.4 + 0.999)) AS bound FROM p GROUP BY document_id)
SELECT document_id, line, count(*) AS times FROM e JOIN b USING (document_id) WHERE length(line) BETWEEN 2 AND 100 AND NOT regexp_matches(line, '^(?:第\s*)?[-—–]?\s*[0-9]{{1,4}}\s*(?:页|/\s*[0-9]{{1,4}})?\s*[-—–]?$') GROUP BY document_id, line, bound HAVING count(*) >= bound""",
    "page_line_blocks": rf"""
WITH RECURSIVE {OUTLINES},
raw AS (
  SELECT conv_id AS d, turn AS p, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM conversations
  UNION ALL SELECT CAST(floor((doc_id + 1) / 3.0) AS BIGINT) - 1, (-(doc_id + 1)) % 3, line, pos FROM outlines WHERE doc_id < 0),
said AS (SELECT d, p, no, {squeezed("line")} AS line FROM raw WHERE {squeezed("line")} <> ''),
whole AS (SELECT d, p, list(line ORDER BY no) AS l FROM said GROUP BY d, p),
ends AS (SELECT d, unnest(list_concat(l[1:3], l[greatest(1, len(l) - 2) : len(l)])) AS line FROM whole),
bound AS (SELECT d, greatest(3, floor(count(*) * 0.4 + 0.999)) AS most FROM whole GROUP BY d),
again AS (SELECT d, line FROM ends JOIN bound USING (d) WHERE length(line) BETWEEN 2 AND 100 AND NOT regexp_matches(line, '{_NUMBER}') GROUP BY d, line, most HAVING count(*) >= most),
k AS (SELECT d, p, line, row_number() OVER (PARTITION BY d, p ORDER BY no) AS k, {HEADING} AS alone FROM said ANTI JOIN again USING (d, line) WHERE NOT regexp_matches(line, '{_NUMBER}')),
f AS (
  SELECT d, p, k, line, alone, 1 AS n, length(line) + 1 AS size FROM k WHERE k = 1
  UNION ALL
  SELECT k.d, k.p, k.k, k.line, k.alone, f.n + CASE WHEN k.alone OR {_ENDED} THEN 1 ELSE 0 END, CASE WHEN k.alone OR {_ENDED} THEN 0 ELSE f.size END + length(k.line) + 1 FROM f JOIN k ON k.d = f.d AND k.p = f.p AND k.k = f.k + 1),
b AS (SELECT d, p, n, bool_or(alone) AS alone, string_agg(line, ' ' ORDER BY k) AS text, row_number() OVER (PARTITION BY d ORDER BY p, n) - 1 AS pos FROM f GROUP BY d, p, n),
t AS (SELECT *, CASE WHEN alone THEN CASE WHEN length(text) <= 35 THEN 1 ELSE 2 END END AS level FROM b),
heads AS (SELECT d, list(text ORDER BY pos) AS t, list(level ORDER BY pos) AS l FROM t WHERE alone GROUP BY d),
fold AS (SELECT d, t, l, 0 AS i, CAST([] AS VARCHAR[]) AS path FROM heads UNION ALL SELECT d, t, l, i + 1, list_append(path[1 : l[i + 1] - 1], t[i + 1]) FROM fold WHERE i < len(t)),
c AS (SELECT *, count(level) OVER (PARTITION BY d ORDER BY pos) AS nth FROM t)
SELECT c.d AS document_id, CAST(pos AS INTEGER) AS pos, CASE WHEN alone THEN 'heading' ELSE 'paragraph' END AS kind, CAST(p AS INTEGER) AS page, coalesce(array_to_string(path, ' > '), '') AS path, sha256(text) AS sha256
FROM c LEFT JOIN fold ON fold.d = c.d AND fold.i = c.nth""",
    "text_blocks": f"SELECT doc_id, 0 AS pos, 'paragraph' AS kind, sha256(t) AS sha256 FROM (SELECT doc_id, {squeezed(MARKDOWN)} AS t FROM documents) WHERE t <> ''",
    "assembled_spans": f"""
WITH {LINES}, l AS (SELECT doc_id, pos, length(line) AS n FROM lines WHERE length(line) > 0),
s AS (SELECT doc_id, n, coalesce(sum(n + 2) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, sum(n + 2) OVER (PARTITION BY doc_id) - 2 AS total FROM l)
SELECT doc_id AS document_id, CAST(total AS INTEGER) AS character_count, CAST(a AS INTEGER) AS start, CAST(a + n AS INTEGER) AS "end" FROM s""",
    "document_gate": f"SELECT doc_id, length({squeezed('text')}) >= 40 AS kept FROM documents",
    "chunk_documents": f"WITH RECURSIVE {CHUNKS} SELECT document_id, chunk_index, CAST(char_start AS INTEGER) AS char_start, CAST(char_end AS INTEGER) AS char_end, 'chk_' || substr(sha1(document_id || chr(31) || char_start || chr(31) || char_end || chr(31) || text), 1, 20) AS chunk_id FROM pieces",
    "chunk_span_overlap": f"WITH RECURSIVE {CHUNKS} SELECT document_id, chunk_index, CAST(char_start // 500 AS INTEGER) AS page_start, CAST((char_end - 1) // 500 AS INTEGER) AS page_end, 0 AS n_paths FROM pieces",
    "processing_report_by_source": "SELECT source, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents GROUP BY source",
    "processing_report_by_lang": "SELECT lang, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents GROUP BY lang",
    "build_report": f"""
WITH d AS (SELECT source, length({squeezed(MARKDOWN)}) AS n FROM documents)
SELECT source AS source_id, 'txt' AS file_type, count(*) AS documents, count(*) FILTER (WHERE n >= 40) AS accepted, count(*) FILTER (WHERE n < 40) AS rejected, CAST(coalesce(sum(n) FILTER (WHERE n >= 40), 0) AS BIGINT) AS characters,
  0 AS warnings, CASE WHEN count(*) FILTER (WHERE n < 40) > 0 THEN 'text too short: x ' || count(*) FILTER (WHERE n < 40) ELSE '' END AS errors FROM d GROUP BY source""",
    "chunk_id_uniqueness": "SELECT sha1(text) AS chunk_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1",
    "topk_per_query": "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT event_type AS query_id, event_id AS chunk_id, value AS score, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5",
    "ranking_projection": f"WITH {dense(3)} SELECT query_id, rank, chunk_id, source AS source_id, source AS title, sha256(text) AS text_sha256, lang AS section FROM dense JOIN documents ON doc_id = chunk_id",
    "compact_results": f"WITH {dense(3)} SELECT query_id, rank, round(score, 6) AS score, replace(substr(text, 1, 240), chr(10), ' ') AS preview FROM dense JOIN documents ON doc_id = chunk_id",
    "bm25_index_stats": f"WITH {BM25} SELECT n, round(avgdl, 6) AS avgdl, round(avg_idf, 6) AS avg_idf, n_terms FROM stats",
    "bm25_vocab": f"WITH {BM25} SELECT token, df, round(idf, 6) AS idf FROM vocab",
    "bm25_topk": f"WITH {bm25(QUESTIONS, 10)} SELECT query_id, chunk_id, rank, round(score::DOUBLE, 5) AS score FROM lexical",
    "bm25_zero_padding": f"WITH {bm25(_values(list(enumerate(RARE)), 'query_id', 'query'), 10)} SELECT query_id, chunk_id, rank, round(score::DOUBLE, 5) AS score FROM lexical",
    "dense_topk": f"WITH {dense(10)} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM dense",
    "rrf_fusion": f"WITH {FUSED} SELECT query_id, chunk_id, rank, round(score, 9) AS score FROM fused",
    "hybrid_topk": f"WITH {FUSED} SELECT query_id, chunk_id, rank, bm25_rank, dense_rank FROM fused WHERE rank <= 10",
    "rerank_topk": f"""
WITH {FUSED},
pair AS (SELECT f.query_id || '/' || f.chunk_id AS pid, f.query_id, f.chunk_id, f.rank AS pre_rerank_rank, b.text AS query, d.text FROM fused f JOIN benchmark b ON b.item_id = f.query_id JOIN documents d ON d.doc_id = f.chunk_id WHERE f.rank <= 30),
{excerpts("pair", 420)},
score AS (SELECT s.pid, CAST(coalesce(sum(length(term) * (length(lower(excerpt)) - length(replace(lower(excerpt), term, '')))), 0) AS DOUBLE) AS score FROM shown s LEFT JOIN terms t ON t.pid = s.pid GROUP BY s.pid)
SELECT query_id, chunk_id, rank, score, pre_rerank_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM pair JOIN score USING (pid)) WHERE rank <= 10""",
    "query_excerpts": f"WITH {bm25(QUESTIONS, 5)}, pair AS (SELECT query_id || '/' || chunk_id AS pid, query_id, chunk_id, rank, b.text AS query, d.text FROM lexical JOIN benchmark b ON item_id = query_id JOIN documents d ON d.doc_id = chunk_id), {excerpts('pair', 420)} SELECT query_id, rank, chunk_id, excerpt FROM pair JOIN shown USING (pid)",
    "locators": f"""
SELECT doc_id, CASE WHEN p IS NOT NULL THEN CASE WHEN coalesce(z <> 0 AND z <> p, false) THEN 'pp. ' || p || '-' || z ELSE 'p. ' || p END WHEN doc_id % 2 = 0 THEN source || ' > ' || lang ELSE 'web page' END AS locator
FROM (SELECT *, {_FIRST} AS p, {_LAST} AS z FROM documents)""",
    "evidence_budget": f"WITH {EVIDENCE} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, citation, CAST(length(text) AS INTEGER) AS characters FROM evidence",
    "extractive_answers": rf"""
WITH {EVIDENCE},
cutup AS (SELECT query_id, query, citation, regexp_split_to_array(regexp_replace(text, '([。！？!?；;.])\s+', '\1' || chr(1), 'g'), '\x01|\n+') AS p FROM evidence),
s AS (SELECT query_id, query, citation, trim(unnest(p), ' ' || chr(9) || chr(10)) AS sentence, generate_subscripts(p, 1) - 1 AS place FROM cutup),
o AS (SELECT *, len(list_intersect(list_distinct({tokens("query")}), list_distinct({tokens("sentence")}))) AS share FROM s WHERE length(sentence) >= 20),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id, regexp_replace(sentence, '\s+', '', 'g') ORDER BY share DESC, place, sentence DESC, citation DESC) AS nth FROM o),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY share DESC, place, sentence DESC, citation DESC) AS n FROM u WHERE nth = 1)
SELECT item_id AS query_id, coalesce(a, '未在当前检索证据中找到足以回答该问题的内容。') AS answer FROM benchmark LEFT JOIN (SELECT query_id, string_agg(sentence || ' [' || citation || ']', ' ' ORDER BY n) AS a FROM b WHERE n <= 2 GROUP BY query_id) x ON x.query_id = item_id""",
    "prompt_context": f"""
WITH {EVIDENCE},
c AS (SELECT query_id, string_agg('[' || citation || '] ' || title || ' | ' || lang || ' | doc://' || chunk_id || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS c FROM evidence GROUP BY query_id)
SELECT item_id AS query_id, sha256('问题：' || text || chr(10) || chr(10) || '证据：' || chr(10) || coalesce(c, '')) AS prompt_sha256 FROM benchmark LEFT JOIN c ON c.query_id = item_id""",
    "answer_sources": f"WITH {EVIDENCE}, pair AS (SELECT query_id || '/' || citation AS pid, * FROM evidence), {excerpts('pair', 600)} SELECT query_id, citation, title, chunk_id, lang AS locator, excerpt AS evidence FROM pair JOIN shown USING (pid)",
    "page_distance": """
WITH p AS (SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN doc_id % 10 + 1 END AS s, CASE WHEN doc_id % 6 > 0 THEN (doc_id % 10 + 1) * (doc_id % 3) END AS e, CASE WHEN doc_id % 5 > 0 THEN doc_id % 15 END AS h FROM documents),
q AS (SELECT doc_id, s, h, coalesce(nullif(e, 0), s) AS e FROM p)
SELECT doc_id, CASE WHEN h IS NULL OR s IS NULL OR h BETWEEN s AND e THEN 0 ELSE least(abs(s - h), abs(e - h)) END AS distance FROM q""",
    "query_id_summary": "SELECT count(*) AS questions, count(DISTINCT lang) AS distinct_ids, count(DISTINCT source) AS sources FROM documents",
    "bind_questions": r"""
WITH d AS (SELECT doc_id, source, length(text) AS n, replace(lower(regexp_replace(text, '\s+', '', 'g')), 'ß', 'ss') AS f FROM documents),
b AS (SELECT item_id, replace(lower(regexp_replace(text, '\s+', '', 'g')), 'ß', 'ss') AS f FROM benchmark),
m AS (SELECT item_id || ':' || source AS query_id, doc_id, row_number() OVER (PARTITION BY item_id, source ORDER BY n, doc_id) AS place FROM b JOIN d ON contains(d.f, b.f))
SELECT query_id, string_agg(doc_id::VARCHAR, ',' ORDER BY place) AS relevant, min_by(doc_id, place) AS primary_chunk_id, 'web_section' AS locator_type FROM m WHERE place <= 4 GROUP BY query_id""",
    "ir_metrics_per_query": f"WITH {METRICS} SELECT query_id, {', '.join(f'round({n}, 9) AS {n}' for n in NAMES)} FROM per",
    "metric_summary": f"WITH {METRICS} SELECT 'dense' AS mode, count(*) AS query_count, {', '.join(f'round(avg({n}), 9) AS {n}' for n in NAMES)} FROM per",
    "metric_by_language": f"WITH {METRICS} SELECT 'dense' AS mode, label AS language, count(*) AS query_count, {', '.join(f'round(avg({n}), 9) AS {n}' for n in NAMES)} FROM per JOIN embeddings ON vec_id = query_id GROUP BY GROUPING SETS ((), (label))",
    "latency_percentiles": "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS max FROM events GROUP BY event_type",
    "corpus_summary": "SELECT lang AS language, count(*) AS chunks, count(DISTINCT source) AS sources FROM documents GROUP BY lang",
    "release_allowlist": f"""
WITH p AS (SELECT page_id, CASE WHEN contains(base, '/') THEN regexp_replace(base, '^([^/]+)/', '\\1/' || page_id || '/') ELSE base END AS path FROM (SELECT page_id, [{", ".join(map(_q, PATHS))}][1 + page_id % {len(PATHS)}] AS base FROM pages))
SELECT page_id, path, NOT regexp_matches(path, '(^|/)(\\.DS_Store|__pycache__)(/|$)') AND NOT regexp_matches(path, '\\.(pyc|part)$')
  AND CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] IN ('configs', 'docs', 'evaluation', 'scripts', 'src', 'tests') ELSE path IN ('.gitignore', 'README.md', 'requirements.txt', 'source_manifest.yaml') END AS allowed,
  regexp_matches(path, 'data/raw/|data/processed/|data/cache/|\\.venv/|artifacts/') AS forbidden FROM p""",
    "demo_sample": "SELECT doc_id AS chunk_id, source AS title, text FROM documents WHERE source = 'src1' ORDER BY doc_id LIMIT 12",
}

for _name in ("evidence_budget", "extractive_answers", "prompt_context", "answer_sources"):
    SQL[f"retrieved_{_name}"] = SQL[_name]
SQL["retrieved_excerpts"] = SQL["query_excerpts"]
