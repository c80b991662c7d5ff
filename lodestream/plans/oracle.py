"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

_T = """
tok AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9]*')) AS term FROM documents),
len AS (SELECT doc_id AS id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9]*')) AS length FROM documents),
post AS (SELECT id, term, count(*) AS tf, any_value(length) AS length FROM tok JOIN len USING (id) GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
q AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9]*')) AS term FROM benchmark)
"""
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)"
_BM25 = f"""
bm AS (
  SELECT query_id, id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avgl))) AS score
  FROM (SELECT DISTINCT query_id, term FROM q) JOIN df USING (term) JOIN post USING (term), (SELECT count(*) AS n, avg(length) AS avgl FROM len)
  GROUP BY query_id, id
), bmr AS (SELECT query_id, {_RANK} AS rank, id, score FROM bm)
"""
_TFIDF = f"""
idf AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1 AS idf FROM df),
w AS (SELECT id, term, tf / length * idf AS w FROM post JOIN idf USING (term)),
ql AS (SELECT query_id, count(*) AS n FROM q GROUP BY query_id),
qw AS (SELECT query_id, term, count(*) / any_value(n) * any_value(idf) AS qw FROM q JOIN ql USING (query_id) JOIN idf USING (term) GROUP BY query_id, term),
ti AS (
  SELECT query_id, id, sum(w * qw) / (any_value(nw) * any_value(nq)) AS score
  FROM qw JOIN w USING (term) JOIN (SELECT id, sqrt(sum(w * w)) AS nw FROM w GROUP BY id) USING (id) JOIN (SELECT query_id, sqrt(sum(qw * qw)) AS nq FROM qw GROUP BY query_id) USING (query_id)
  GROUP BY query_id, id
), tir AS (SELECT query_id, {_RANK} AS rank, id, score FROM ti)
"""


def _bm25_of(name: str, rows: str) -> str:
    """BM25 over the documents that `rows` chooses, as the tables `name`_p, `name`_d and `name` (query_id, id, rank)."""
    return f"""
{name}_p AS (SELECT post.* FROM post JOIN documents ON doc_id = id WHERE {rows}), {name}_d AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
{name} AS (SELECT query_id, id, {_RANK} AS rank FROM (
  SELECT query_id, id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avgl))) AS score
  FROM (SELECT DISTINCT query_id, term FROM q) JOIN {name}_d USING (term) JOIN {name}_p USING (term), (SELECT count(*) AS n, avg(length) AS avgl FROM len JOIN documents ON doc_id = id WHERE {rows})
  GROUP BY query_id, id))"""


_LINES = "lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"
_KIND = r"""CASE WHEN trim(line) = '' THEN 'blank' WHEN length(line) - length(replace(line, '|', '')) >= 2 THEN 'table'
  WHEN regexp_matches(line, '^\s*([-*+] |[0-9]{1,4}\. )') THEN 'list' ELSE 'prose' END"""
def _chunks(name: str, most: int, ceiling: int, crumb: str) -> str:
    """The chunks of documents without headings and blank lines, as table `name`; both folds step through paragraphs and through their parts."""
    n = name
    return rf"""
{n}_f AS (
  SELECT doc_id, p, CASE WHEN length(para) <= {ceiling} THEN length(para) ELSE 0 END AS held, p AS first, length(para) > {ceiling} AS alone FROM paras WHERE p = 1
  UNION ALL
  SELECT b.doc_id, b.p, CASE WHEN fits THEN grown ELSE 0 END, CASE WHEN fits AND f.held > 0 THEN f.first ELSE b.p END, NOT fits
  FROM {n}_f f JOIN paras b ON b.doc_id = f.doc_id AND b.p = f.p + 1, LATERAL (SELECT f.held + CASE WHEN f.held > 0 THEN 1 ELSE 0 END + length(b.para) AS grown), LATERAL (SELECT grown <= {ceiling} AS fits)
), {n}_g AS (
  SELECT f.doc_id, f.first AS p, 0 AS piece, 1 AS pieces, string_agg(para, chr(10) ORDER BY b.p) AS body, 'text' AS block_type FROM {n}_f f JOIN paras b USING (doc_id, p) WHERE NOT alone GROUP BY f.doc_id, f.first
), {n}_t AS (
  SELECT doc_id, p, kind, ps, unnest(ps) AS part, unnest(range(len(ps))) AS k FROM (
    SELECT doc_id, p, kind, CASE WHEN length(para) <= {most} THEN [para] WHEN kind = 'prose' THEN string_split(regexp_replace(para, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) ELSE string_split(para, chr(10)) END AS ps
    FROM {n}_f JOIN paras USING (doc_id, p) WHERE alone)
), {n}_q AS (
  SELECT doc_id, p, k, length(part) AS n, 0 AS piece FROM {n}_t WHERE k = 0
  UNION ALL
  SELECT t.doc_id, t.p, t.k, CASE WHEN q.n + 1 + length(t.part) <= {most} THEN q.n + 1 + length(t.part) ELSE length(t.part) END, q.piece + CASE WHEN q.n + 1 + length(t.part) <= {most} THEN 0 ELSE 1 END
  FROM {n}_q q JOIN {n}_t t ON t.doc_id = q.doc_id AND t.p = q.p AND t.k = q.k + 1
), {n}_s AS (
  SELECT doc_id, p, piece, count(*) OVER (PARTITION BY doc_id, p) AS pieces, body, kind AS block_type FROM (
    SELECT doc_id, p, piece, kind, CASE WHEN kind = 'prose' THEN string_agg(part, ' ' ORDER BY k) ELSE string_agg(part, chr(10) ORDER BY k) END AS body FROM {n}_q JOIN {n}_t USING (doc_id, p, k) GROUP BY doc_id, p, piece, kind)
), {n}_m AS (
  SELECT doc_id, p, piece, block_type, CASE WHEN pieces = 1 THEN body ELSE '[' || mark || ':' || CASE WHEN piece = 0 THEN 'start' ELSE 'cont' END || ']' || chr(10) || body || chr(10) || '[' || mark || ':' || CASE WHEN piece = pieces - 1 THEN 'end' ELSE 'cont' END || ']' END AS body
  FROM (SELECT *, CASE block_type WHEN 'table' THEN 'TABLE' WHEN 'list' THEN 'LIST' ELSE 'PARA' END AS mark FROM (SELECT * FROM {n}_g UNION ALL SELECT * FROM {n}_s))
), {n} AS (
  SELECT m.doc_id, 'doc_' || m.doc_id AS document_name, row_number() OVER (PARTITION BY m.doc_id ORDER BY m.p, piece) - 1 AS chunk_index, block_type, body, {crumb} AS content,
    CAST(octet_length(encode({crumb})) AS BIGINT) AS source_length, octet_length(encode(substr(text, 1, strpos(text, para) - 1))) AS source_offset
  FROM {n}_m m JOIN paras b USING (doc_id, p) JOIN documents d ON d.doc_id = m.doc_id
)"""


_CRUMB = "'[doc_' || m.doc_id || ']' || chr(10) || chr(10) || body"
#: Paragraphs: neighbouring lines of tables and of lists are one.
_PARAS = f"""
{_LINES}, ki AS (SELECT doc_id, pos, line, {_KIND} AS kind FROM lines),
st AS (SELECT *, CASE WHEN kind IN ('table', 'list') AND lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) = kind THEN 0 ELSE 1 END AS starts FROM ki),
bl AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM st),
paras AS (SELECT doc_id, any_value(kind) AS kind, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS p, trim(string_agg(line, chr(10) ORDER BY pos)) AS para FROM bl WHERE kind <> 'blank' GROUP BY doc_id, block)
"""
_STRATEGIES = {"naive_small": (300, 345, "body"), "naive_medium": (800, 919, "body"), "naive_large": (1600, 1840, "body"), "context_small": (300, 345, _CRUMB), "context_medium": (800, 919, _CRUMB), "context_large": (1600, 1840, _CRUMB), "context_wide": (1200, 1380, _CRUMB)}
_VOCAB = "voc AS (SELECT term, count(DISTINCT id) AS df FROM tok WHERE length(term) >= 6 GROUP BY term HAVING 50 * count(DISTINCT id) >= (SELECT count(*) FROM documents))"
#: Every run of letters and digits with its place; a match is a run that is in the vocabulary.
_MATCH = rf"""
{_T}, {_VOCAB},
piece AS (SELECT id, p, k FROM (SELECT doc_id AS id, string_split(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]', ' ', 'g'), ' ') AS ps FROM documents) a, LATERAL (SELECT unnest(ps) AS p, unnest(range(len(ps))) AS k)),
run AS (SELECT id, p, sum(length(p) + 1) OVER (PARTITION BY id ORDER BY k) - length(p) - 1 AS s FROM piece),
hit AS (SELECT id, CAST(id AS VARCHAR) AS chunk_id, 'ent_' || p AS entity_id, p, CAST(s AS BIGINT) AS s, CAST(s + length(p) AS BIGINT) AS e FROM run WHERE p IN (SELECT term FROM voc)),
m AS (SELECT chunk_id, entity_id, count(*) AS frequency, min(s) AS first, max(s) AS last FROM hit GROUP BY chunk_id, entity_id)
"""
_SCORED = f"""{_MATCH},
edf AS (SELECT entity_id, count(*) AS df FROM m GROUP BY entity_id),
sc AS (
  SELECT chunk_id, entity_id, df, 0.4 * ln(1 + frequency) + 0.3 * (1 - first / greatest(length(text), 1)) + 0.3 * ln((SELECT count(*) FROM documents) / df) AS score
  FROM m JOIN edf USING (entity_id) JOIN documents ON CAST(doc_id AS VARCHAR) = chunk_id
), best AS (SELECT entity_id, chunk_id, score, row_number() OVER (PARTITION BY entity_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc)
"""
_PAIRS = """
edf2 AS (SELECT entity_id, count(*) AS df FROM m GROUP BY entity_id),
pr AS (
  SELECT a, b, n, x.df AS df_a, y.df AS df_b, n / (x.df + y.df - n) AS jaccard, log2(n / t / ((x.df / t) * (y.df / t))) AS pmi
  FROM (SELECT a.entity_id AS a, b.entity_id AS b, count(*) AS n FROM m a JOIN m b ON a.chunk_id = b.chunk_id AND a.entity_id < b.entity_id GROUP BY ALL HAVING count(*) >= 2)
  JOIN edf2 x ON x.entity_id = a JOIN edf2 y ON y.entity_id = b, (SELECT count(*) AS t FROM documents)
)
"""
_CLUSTERS = """
di AS (SELECT a, b, greatest(0, 1 - CASE WHEN hi > lo THEN (jaccard - lo) / (hi - lo) ELSE 1 END) AS d FROM pr, (SELECT min(jaccard) AS lo, max(jaccard) AS hi FROM pr)),
ed AS (SELECT a, b FROM di WHERE d <= 0.6 UNION ALL SELECT b, a FROM di WHERE d <= 0.6),
re AS (SELECT 'ent_' || term AS v, 'ent_' || term AS l FROM voc UNION SELECT ed.a, re.l FROM re JOIN ed ON ed.b = re.v),
cl AS (SELECT v AS entity_id, min(l) AS label FROM re GROUP BY v)
"""
_RESULTS = """
vec AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
near AS (
  SELECT q.vec_id AS query_id, r.vec_id AS id, list_cosine_similarity(q.v, r.v) AS score, q.label AS ql, r.label AS l, r.v
  FROM vec q, vec r WHERE q.vec_id % 50 = 0
), top AS (
  SELECT *, CASE WHEN l = ql THEN 2 WHEN abs(l - ql) = 1 THEN 1 ELSE 0 END AS relevance, id % 97 AS n_chars FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM near) WHERE rank <= 10
), nd AS (
  SELECT query_id, CASE WHEN sum(relevance / log2(ideal + 1)) > 0 THEN sum(relevance / log2(rank + 1)) / sum(relevance / log2(ideal + 1)) ELSE 0 END AS ndcg
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, rank) AS ideal FROM top) GROUP BY query_id
), sco AS (
  SELECT query_id, avg(CASE WHEN relevance > 0 THEN 1.0 ELSE 0.0 END) AS scope, CASE WHEN sum(n_chars) > 0 THEN sum(CASE WHEN relevance > 0 THEN n_chars ELSE 0 END) / sum(n_chars) ELSE 0 END AS efficiency FROM top GROUP BY query_id
), coh AS (
  SELECT a.query_id, avg(list_cosine_similarity(a.v, b.v)) AS coherence FROM top a JOIN top b ON a.query_id = b.query_id AND a.rank < b.rank GROUP BY a.query_id
)
"""
_CONTEXT = "coalesce(text, '')"

SQL: dict[str, str] = {
    "paragraph_explode": f"WITH {_LINES} SELECT doc_id, pos, length(line) AS n_chars FROM lines",
    "sentence_split_stats": r"""
SELECT doc_id, len(ps) AS n_sentences, list_max(list_transform(ps, lambda x: length(x))) AS longest
FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \t\n\f\r]+', '\1' || chr(1), 'g'), chr(1)) AS ps FROM documents)""",
    "line_classify": f"WITH {_LINES} SELECT doc_id, {_KIND} AS kind, count(*) AS n FROM lines GROUP BY ALL",
    "merge_blocks_islands": f"""
WITH {_LINES}, k AS (SELECT doc_id, pos, {_KIND} AS kind FROM lines),
s AS (SELECT *, CASE WHEN kind IN ('table', 'list') AND lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) = kind THEN 0 ELSE 1 END AS starts FROM k),
b AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS block FROM s)
SELECT doc_id, block, any_value(kind) AS kind, count(*) AS n_lines, min(pos) AS first_pos FROM b GROUP BY doc_id, block""",
    "markdown_sections": "SELECT doc_id, len(list_filter(string_split('# ' || replace(text, '.', chr(10) || '#'), chr(10)), lambda x: starts_with(x, '#'))) AS n_sections FROM documents",
    "naive_windows": r"""
WITH t AS (SELECT doc_id, string_split(trim(regexp_replace(text, '[\s\x0B]+', ' ', 'g')), ' ') AS ts FROM documents),
w AS (SELECT doc_id, ts, unnest(range(0, len(ts), 224)) AS a FROM t WHERE ts[1] <> '')
SELECT doc_id, a // 224 AS "window", least(256, len(ts) - a) AS n_tokens, md5(array_to_string(ts[a + 1:a + 256], ' ')) AS digest FROM w""",
    "chunk_documents": f"""
WITH RECURSIVE {_PARAS}, {_chunks("c", 1200, 1380, _CRUMB)}
SELECT document_name, chunk_index, CAST(NULL AS VARCHAR) AS section, '[doc_' || doc_id || ']' AS breadcrumb, content, block_type, source_offset, source_length FROM c""",
    "chunk_size_histogram": f"""
WITH RECURSIVE {_PARAS}, {_chunks("c", 1200, 1380, _CRUMB)}
SELECT length(body) // 200 AS size_class, block_type, count(*) AS n, CAST(sum(source_length) AS BIGINT) AS bytes FROM c GROUP BY ALL""",
    "strategy_matrix": f"""
WITH RECURSIVE {_PARAS}, {", ".join(_chunks(k, *v) for k, v in _STRATEGIES.items())}
{" UNION ALL ".join(f"SELECT '{k}' AS strategy, count(*) AS n_chunks, CAST(sum(source_length) AS BIGINT) AS bytes, CAST(max(length(body)) AS BIGINT) AS longest FROM {k}" for k in _STRATEGIES)}""",
    "json_outline": """
SELECT event_id, md5(CASE WHEN props IS NULL THEN '' ELSE array_to_string(list_transform(json_keys(props), lambda k: '# ' || k || chr(10) || chr(10) || json_extract_string(props, '$."' || k || '"')), chr(10) || chr(10)) END) AS digest,
  CAST(NULL AS VARCHAR) AS error FROM events""",
    "enrich_prefix": f"""
SELECT doc_id, md5('Document: ' || source || chr(10) || CASE WHEN lang <> 'en' THEN 'Section: ' || lang || chr(10) ELSE '' END || chr(10) || {_CONTEXT}) AS digest FROM documents""",
    "enrich_inline": f"SELECT doc_id, md5('[' || source || CASE WHEN lang <> 'en' THEN ' > ' || lang ELSE '' END || '] ' || {_CONTEXT}) AS digest FROM documents",
    "chunk_ids": "SELECT doc_id, source || '_' || doc_id || '_' || substr(sha256(source || ':' || doc_id || ':' || substr(text, 1, 100)), 1, 16) AS chunk_id FROM documents",
    "mime_detect": r"""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'html' WHEN page_id % 3 = 1 THEN 'json'
  ELSE CASE regexp_extract(lower(regexp_replace(regexp_replace(path, '[?#].*$', ''), '^.*/', '')), '\.([^.]*)$', 1)
    WHEN 'html' THEN 'html' WHEN 'htm' THEN 'html' WHEN 'pdf' THEN 'pdf' WHEN 'json' THEN 'json' WHEN 'xml' THEN 'xml' WHEN 'md' THEN 'markdown' WHEN 'csv' THEN 'csv' ELSE 'text' END END AS doc_type
FROM (SELECT page_id, url || CASE WHEN page_id % 5 = 0 THEN '.PDF?x=1' ELSE '' END AS path FROM pages)""",
    "url_normalize": r"""
SELECT page_id, CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*$') THEN u || '/' ELSE u END AS url
FROM (SELECT page_id, regexp_replace(regexp_replace(url || CASE WHEN page_id % 2 = 0 THEN '/' ELSE '' END, '[?#].*$', ''), '/+$', '') AS u FROM pages)""",
    "html_links": r"""
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"''#?][^"'']*)["'']', 1)) AS href FROM pages)
SELECT page_id, href, count(*) AS n FROM h WHERE NOT regexp_matches(lower(href), '^\s*(javascript|mailto|tel):') GROUP BY page_id, href""",
    "page_links": r"""
WITH h AS (SELECT page_id, url, unnest(hs) AS href, unnest(range(len(hs))) AS place FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"''#?][^"'']*)["'']', 1) AS hs FROM pages)),
u AS (SELECT page_id, place, CASE WHEN regexp_matches(href, '^https?://') THEN href ELSE regexp_extract(url, '^https?://[^/?#]+') || trim(href) END AS url FROM h
  WHERE NOT regexp_matches(lower(href), '^\s*(javascript|mailto|tel):')),
p AS (SELECT *, regexp_replace(url, '[?#].*$', '') AS bare, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*', '') AS path FROM u)
SELECT page_id, arg_min(url, place) AS url, CASE WHEN regexp_matches(bare, '^[A-Za-z]+://[^/]*/*$') THEN regexp_replace(bare, '/*$', '') || '/' ELSE regexp_replace(bare, '/+$', '') END AS target FROM p
WHERE NOT regexp_matches(lower(path), '\.(png|jpg|jpeg|gif|svg|webp|ico|bmp|mp4|mp3|wav|ogg|avi|mov|mkv|zip|tar|gz|bz2|7z|rar|exe|dmg|pkg|deb|rpm|woff|woff2|ttf|eot|css)$')
  AND NOT regexp_matches(path, '^/(cdn-cgi|wp-json|api|static|assets|media|uploads|fonts)/')
GROUP BY page_id, 3""",
    "first_of_name": "SELECT arg_min(p_partkey, p_partkey) AS p_partkey, ' ' || upper(arg_min(p_type, p_partkey)) AS name, arg_min(p_brand, p_partkey) AS p_brand FROM part WHERE trim(p_type) <> '' GROUP BY lower(trim(p_type))",
    "table_to_markdown": """
SELECT r_regionkey, '| n_nationkey | n_name | r_name |' || chr(10) || '| --- | --- | --- |' || chr(10) ||
  string_agg('| ' || n_nationkey || ' | ' || trim(n_name) || ' | ' || trim(r_name) || ' |', chr(10) ORDER BY n_nationkey) AS text
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey""",
    "conversation_documents": "SELECT conv_id, count(*) AS n_turns, md5(string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY conv_id",
    "link_bfs": r"""
WITH RECURSIVE h AS (SELECT DISTINCT 'p' || page_id AS p, 'h' || href AS h FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"''#?][^"'']*)["'']', 1)) AS href FROM pages)
  WHERE NOT regexp_matches(lower(href), '^\s*(javascript|mailto|tel):')),
e AS (SELECT p AS s, h AS t FROM h UNION ALL SELECT h, p FROM h),
r AS (SELECT 'p0' AS url, CAST(0 AS BIGINT) AS depth UNION SELECT e.t, r.depth + 1 FROM r JOIN e ON e.s = r.url WHERE r.depth < 4)
SELECT url, min(depth) AS depth FROM r GROUP BY url""",
    "vector_topk": f"WITH {_RESULTS} SELECT query_id, rank, id, round(score, 6) AS score FROM top",
    "bm25_topk": f"WITH {_T}, {_BM25} SELECT query_id, rank, id, round(score, 6) AS score FROM bmr WHERE rank <= 5",
    "tfidf_topk": f"WITH {_T}, {_TFIDF} SELECT query_id, rank, id, round(score, 6) AS score FROM tir WHERE rank <= 5",
    "rrf_hybrid": f"""
WITH {_T}, {_BM25}, {_TFIDF},
f AS (SELECT query_id, id, min(r1) AS r1, min(r2) AS r2 FROM (
  SELECT query_id, id, rank AS r1, NULL AS r2 FROM bmr WHERE rank <= 15 UNION ALL SELECT query_id, id, NULL, rank FROM tir WHERE rank <= 15) GROUP BY query_id, id),
s AS (SELECT *, (coalesce(1 / (60 + r1), 0) + coalesce(1 / (60 + r2), 0)) / (2 / 61) AS score FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, r1 NULLS LAST, r2 NULLS LAST, id) AS rank FROM s)
SELECT query_id, rank, id, round(score, 9) AS score FROM o WHERE rank <= 5""",
    "federated_search": f"""
WITH {_T}, {_bm25_of("en", "lang = 'en'")}, {_bm25_of("ot", "lang IS DISTINCT FROM 'en'")},
l AS (SELECT query_id, 'english' AS library, id, 1 / (60 + rank) AS part FROM en WHERE rank <= 5 UNION ALL SELECT query_id, 'others', id, 1 / (60 + rank) FROM ot WHERE rank <= 5),
s AS (SELECT query_id, library, id, sum(part) * 61 / 2 AS score FROM l GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, library, id) AS rank FROM s)
SELECT query_id, rank, library, id, round(score, 9) AS score FROM o WHERE rank <= 5""",
    "rerank_topk": rf"""
WITH {_T}, {_BM25}, f AS (SELECT query_id, id, b.text AS q, d.text AS c FROM bmr JOIN benchmark b ON item_id = query_id JOIN documents d ON doc_id = id WHERE rank <= 20),
g AS (SELECT query_id, id, len(list_intersect(list_filter(string_split_regex(lower(q), '\s+'), lambda x: x <> ''), string_split_regex(lower(c), '\s+')))
  / greatest(1, len(list_distinct(list_filter(string_split_regex(q, '\s+'), lambda x: x <> '')))) AS score FROM f)
SELECT query_id, rank, id, round(score, 6) AS score FROM (SELECT *, {_RANK} AS rank FROM g) WHERE rank <= 5""",
    "store_upsert_first_wins": """
WITH r AS (SELECT md5(text) AS chunk_id, doc_id FROM documents), o AS (SELECT chunk_id, min(doc_id) AS doc_id FROM r WHERE doc_id % 3 = 0 GROUP BY chunk_id)
SELECT * FROM o UNION ALL SELECT chunk_id, min(doc_id) FROM r WHERE chunk_id NOT IN (SELECT chunk_id FROM o) GROUP BY chunk_id""",
    "delete_by_document": "SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 7 = 0 AND source IN ('src1', 'src2'))",
    "breadcrumb_migration": """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '[' || source || ' > a]' END AS breadcrumb,
  md5(CASE WHEN doc_id % 3 = 1 THEN '[TABLE:start]' || chr(10) || chr(10) || text ELSE text END) AS digest FROM documents""",
    "vocab_match": f"WITH {_MATCH} SELECT chunk_id, entity_id, frequency, first, last FROM m",
    "entity_scores": f"WITH {_SCORED} SELECT chunk_id, entity_id, df, round(score, 6) AS score FROM sc",
    "entity_topn": f"WITH {_SCORED} SELECT entity_id, rank, chunk_id, round(score, 6) AS score FROM best WHERE rank <= 3",
    "merge_matches_overlap": f"""
WITH {_MATCH}, v AS (SELECT chunk_id, entity_id, s, e FROM hit WHERE p IN (SELECT term FROM voc WHERE df / (SELECT count(*) FROM documents) >= 0.04)),
g AS (SELECT chunk_id, 'gen_' || p AS entity_id, s, e FROM hit)
SELECT * FROM v UNION ALL SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.chunk_id = g.chunk_id AND v.s < g.e AND g.s < v.e)""",
    "cooccurrence": f"WITH {_MATCH}, {_PAIRS} SELECT a, b, n, df_a, df_b, round(jaccard, 6) AS jaccard, round(pmi, 6) AS pmi FROM pr",
    "cluster_dbscan": f"WITH RECURSIVE {_MATCH}, {_PAIRS}, {_CLUSTERS} SELECT entity_id, printf('cluster_%04d', dense_rank() OVER (ORDER BY label) - 1) AS cluster_id FROM cl",
    "cluster_cohesion": f"""
WITH RECURSIVE {_MATCH}, {_PAIRS}, {_CLUSTERS}
SELECT label, any_value(size) AS size, round(coalesce(avg(jaccard), 0), 4) AS cohesion
FROM (SELECT label, count(*) AS size FROM cl GROUP BY label) LEFT JOIN (
  SELECT x.label AS l, jaccard FROM pr JOIN cl x ON x.entity_id = a JOIN cl y ON y.entity_id = b WHERE x.label = y.label) ON l = label GROUP BY label""",
    "structural_neighbors": """
SELECT DISTINCT CAST(0 AS BIGINT) AS query_id, b.conv_id || '_' || b.turn AS chunk_id FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) = 1 WHERE a.turn % 3 = 0""",
    "entity_expand": f"""
WITH {_SCORED}, o AS (SELECT DISTINCT doc_id AS query_id, entity_id FROM documents JOIN m ON chunk_id = CAST(doc_id AS VARCHAR) WHERE doc_id % 50 = 0)
SELECT query_id, rank AS place, chunk_id, entity_id FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank, entity_id) AS k FROM o JOIN best USING (entity_id) WHERE rank <= 3) WHERE k = 1""",
    "cluster_expand": f"""
WITH RECURSIVE {_SCORED}, {_PAIRS}, {_CLUSTERS}, o AS (SELECT DISTINCT doc_id AS query_id, entity_id FROM documents JOIN m ON chunk_id = CAST(doc_id AS VARCHAR) WHERE doc_id % 50 = 0),
n AS (SELECT DISTINCT o.query_id, y.entity_id, y.label FROM o JOIN cl x ON x.entity_id = o.entity_id JOIN cl y ON y.label = x.label WHERE NOT EXISTS (SELECT 1 FROM o p WHERE p.query_id = o.query_id AND p.entity_id = y.entity_id)),
f AS (SELECT query_id, chunk_id, entity_id, label, score, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY round(score, 9) DESC, entity_id) AS k
  FROM n JOIN best USING (entity_id) WHERE rank = 1 AND chunk_id <> CAST(query_id AS VARCHAR)),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS place FROM f WHERE k = 1)
SELECT query_id, place, chunk_id, entity_id, label FROM p WHERE place <= 10""",
    "ndcg_scope_efficiency": f"WITH {_RESULTS} SELECT query_id, round(ndcg, 6) AS ndcg, round(scope, 6) AS scope, round(efficiency, 6) AS efficiency FROM nd JOIN sco USING (query_id)",
    "marginal_relevance": f"""
WITH {_RESULTS} SELECT query_id, round(ms, 6) AS mean_score, round(coherence, 6) AS redundancy, round(ms - coherence, 6) AS marginal
FROM (SELECT query_id, avg(score) AS ms FROM top GROUP BY query_id) JOIN coh USING (query_id)""",
    "cluster_quality": """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT round(avg(s) FILTER (same), 6) AS intra, round(avg(s) FILTER (NOT same), 6) AS inter
FROM (SELECT list_cosine_similarity(a.v, b.v) AS s, a.label = b.label AS same FROM v a JOIN v b ON a.vec_id < b.vec_id)""",
    "rqi_rollup": f"""
WITH {_RESULTS}, s AS (
  SELECT CASE WHEN query_id % 3 = 0 THEN 'scoped' WHEN query_id % 3 = 1 THEN 'synthesis' ELSE 'broad' END AS category, (0.30 * ndcg + 0.15 * coherence + 0.20 * scope + 0.10 * efficiency) / 0.75 AS q
  FROM nd JOIN sco USING (query_id) JOIN coh USING (query_id)
), p AS (SELECT category, count(*) AS n, avg(q) AS rqi FROM s GROUP BY category),
w AS (SELECT *, CASE category WHEN 'scoped' THEN 0.4 ELSE 0.3 END AS w FROM p)
SELECT category, n, round(rqi, 6) AS rqi FROM p UNION ALL SELECT 'all', CAST(sum(n) AS BIGINT), round(sum(rqi * w) / sum(w), 6) FROM w""",
    "first_hit": f"""
WITH {_RESULTS}, o AS (SELECT *, lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS next FROM top)
SELECT query_id, CASE WHEN relevance > 0 THEN 1 ELSE 0 END AS precision_at_1, round(score - coalesce(next, 0), 6) AS margin FROM o WHERE rank = 1""",
    "stratified_sample": """
WITH s AS (SELECT source, count(*) AS size FROM documents GROUP BY source),
t AS (SELECT *, least(size, greatest(1, CAST(floor(100 * size / sum(size) OVER ()) AS BIGINT))) AS take FROM s),
u AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY size DESC, source) = 1 THEN least(size, take + greatest(100 - sum(take) OVER (), 0)) ELSE take END AS n FROM t),
p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents)
SELECT doc_id, source FROM p JOIN u USING (source) WHERE place <= n""",
    "event_windows": "SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "event_sessions": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS starts FROM events),
s AS (SELECT user_id, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY user_id, k)
SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM c GROUP BY user_id""",
    "marker_strip": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "url_visitable": "SELECT page_id, regexp_matches(url, '/(en|de)/') AND NOT regexp_matches(url, '[?]utm_') AND NOT regexp_matches(url, '#top$') AS keep FROM pages",
    "record_sections": """
SELECT p_partkey, md5('# ' || p_name || chr(10) || chr(10) || '## Brand' || chr(10) || chr(10) || p_brand || chr(10) || chr(10) || '## Kind' || chr(10) || chr(10)
  || replace(p_type, ' ', chr(10) || chr(10))) AS digest FROM part""",
    "latest_of_form": """
SELECT o_custkey, CAST(max_by(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) FILTER (o_orderstatus = 'F') AS VARCHAR) AS newest FROM orders GROUP BY o_custkey""",
    "embedding_cache_missing": "SELECT doc_id, lang AS model FROM documents WHERE doc_id % 2 <> 0",
    "entity_scores_after_removal": f"""
WITH {_MATCH}, left_docs AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, length(text) AS n FROM documents WHERE source <> 'src1' OR source IS NULL),
l AS (SELECT m.*, n FROM m JOIN left_docs USING (chunk_id)), f AS (SELECT entity_id, count(*) AS df FROM l GROUP BY entity_id)
SELECT chunk_id, entity_id, df, round(0.4 * ln(1 + frequency) + 0.3 * (1 - first / greatest(n, 1)) + 0.3 * ln((SELECT count(*) FROM left_docs) / df), 6) AS score FROM l JOIN f USING (entity_id)""",
    "cluster_neighbors": f"WITH RECURSIVE {_MATCH}, {_PAIRS}, {_CLUSTERS} SELECT a.entity_id, b.entity_id AS neighbor FROM cl a JOIN cl b ON a.label = b.label AND a.entity_id <> b.entity_id",
    "cross_context_pairs": f"""
WITH {_RESULTS} SELECT a.query_id, count(*) FILTER (list_cosine_similarity(a.v, b.v) > 0.1 AND a.l IS DISTINCT FROM b.l) AS activated
FROM top a JOIN top b ON a.query_id = b.query_id AND a.rank < b.rank GROUP BY a.query_id""",
    "graded_relevance": """
WITH g AS (SELECT doc_id, contains(lower(coalesce(source, '')), 'src1') OR contains(lower(coalesce(source, '')), 'src2') AS ind,
  doc_id % 2 = 0 AND (contains(lower(coalesce(lang, '')), 'en') OR contains(lower(coalesce(text, '')), 'en') OR contains(lower(coalesce(lang, '')), 'the ') OR contains(lower(coalesce(text, '')), 'the ')) AS ins FROM documents)
SELECT doc_id, CAST(CASE WHEN ind AND (ins OR doc_id % 2 <> 0) THEN 2 WHEN ind OR ins THEN 1 ELSE 0 END AS BIGINT) AS grade FROM g""",
    "answers_by_type": "SELECT event_type, count(*) AS n, round(avg(value) FILTER (event_id % 10 <> 0), 6) AS value FROM events GROUP BY event_type",
    "strategy_advantage": """
WITH a AS (SELECT month(ts) AS size, CASE WHEN event_type = 'view' THEN 'contextual' ELSE event_type END AS strategy, avg(value) AS rqi FROM events GROUP BY ALL),
b AS (SELECT size, max(rqi) FILTER (strategy <> 'contextual') AS bn, max(rqi) FILTER (strategy = 'contextual') AS c, max_by(strategy, rqi) FILTER (strategy <> 'contextual') AS naive FROM a GROUP BY size)
SELECT size, round(bn, 6) AS best_naive, round(c, 6) AS contextual, naive, round(CASE WHEN bn > 0 THEN 100 * (c / bn - 1) END, 6) AS percent FROM b""",
    "evidence_passages": "SELECT substr(sha256(text), 1, 16) AS evidence_id, count(DISTINCT conv_id) AS n_records FROM conversations WHERE trim(text) <> '' GROUP BY text",
}
