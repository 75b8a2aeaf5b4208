"""The registered queries as DuckDB SQL over the same tables, written apart from the engine."""

from __future__ import annotations

from ravelin.operators.answer import FAILED, HEADER, NOTHING, STUB_ANSWER

SIZE, OVERLAP, TOP_K = 512, 64, 6
STEP = SIZE - OVERLAP

# What a named phrase and a tag of the corpus look like.
PHRASE = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"
TEXT = "coalesce(text, '')"
LONG_WORDS = r"list_filter(regexp_extract_all({t}, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Za-z]{{4,}}'))"

CHUNKS = rf"""
tk AS (SELECT doc_id, regexp_extract_all({TEXT}, '\S+') AS tk FROM documents),
nk AS (SELECT doc_id, tk, len(tk) AS n, CASE WHEN len(tk) = 0 THEN 0 WHEN len(tk) <= {SIZE} THEN 1 ELSE CAST(ceil((len(tk) - {SIZE}) / {STEP}.0) AS INTEGER) + 1 END AS k FROM tk),
od AS (SELECT doc_id, tk, n, unnest(range(k)) AS ord FROM nk),
chunk AS (SELECT doc_id || '-' || ord AS chunk_id, doc_id, CAST(ord AS INTEGER) AS ord, array_to_string(tk[ord * {STEP} + 1:ord * {STEP} + {SIZE}], ' ') AS text,
                 CAST(least({SIZE}, n - ord * {STEP}) AS INTEGER) AS window_tokens FROM od)"""
MENTIONS = rf"""{CHUNKS},
comb AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY ord) AS t FROM chunk GROUP BY doc_id),
ph AS (SELECT doc_id, unnest(regexp_extract_all(t, '{PHRASE}')) AS p FROM comb),
sp AS (SELECT doc_id, regexp_split_to_array(p, '\s+') AS a FROM ph),
sf AS (SELECT doc_id, a, unnest(range(2, len(a) + 1)) AS i FROM sp),
mention AS (SELECT doc_id, lower(p) AS entity FROM ph UNION SELECT doc_id, lower(array_to_string(a[i:], ' ')) FROM sf UNION SELECT doc_id, lower(unnest({LONG_WORDS.format(t="t")})) FROM comb)"""
ABOUT = f"""{MENTIONS},
about AS (SELECT c.chunk_id, c.doc_id, c.ord, m.entity FROM mention m JOIN chunk c USING (doc_id) WHERE contains(lower(c.text), m.entity)),
degree AS (SELECT entity, count(*) AS degree FROM about GROUP BY entity)"""
PLANS = rf"""{ABOUT},
rare AS (SELECT d.source, min(m.entity) AS entity FROM mention m JOIN degree g USING (entity) JOIN documents d USING (doc_id) WHERE g.degree < 3 AND regexp_full_match(m.entity, '[a-z]{{4,}}') GROUP BY d.source),
question AS (SELECT 'c-' || conv_id || '-' || turn AS q_id, text AS question, CAST(NULL AS INTEGER) AS top_k FROM conversations WHERE role = 'user'
  UNION ALL SELECT 'b-' || item_id, text, 4 FROM benchmark
  UNION ALL SELECT 'r-' || source, 'is ' || entity || ' in it', 3 FROM rare
  UNION ALL SELECT DISTINCT 's-' || source, 'is it in or by us', NULL FROM documents WHERE source IS NOT NULL),
qp AS (SELECT q_id, unnest(regexp_extract_all(coalesce(question, ''), '{PHRASE}')) AS p FROM question),
qs AS (SELECT q_id, a, unnest(range(2, len(a) + 1)) AS i FROM (SELECT q_id, regexp_split_to_array(p, '\s+') AS a FROM qp)),
qe AS (SELECT q_id, lower(p) AS entity FROM qp UNION SELECT q_id, lower(array_to_string(a[i:], ' ')) FROM qs UNION SELECT q_id, lower(unnest({LONG_WORDS.format(t="coalesce(question, '')")})) FROM question),
qd AS (SELECT q_id, entity, degree FROM qe JOIN degree USING (entity)),
qm AS (SELECT q_id, max(degree) AS max_degree, count(*) AS n_entities, string_agg(entity, '|' ORDER BY entity) AS entities FROM qd GROUP BY q_id),
plan AS (SELECT q_id, question, coalesce(top_k, {TOP_K}) AS top_k, coalesce(max_degree, 0) AS max_degree, coalesce(n_entities, 0) AS n_entities, coalesce(entities, '') AS entities,
                CASE WHEN max_degree >= 3 THEN 'GRAPH' WHEN max_degree > 0 THEN 'HYBRID' ELSE 'VECTOR' END AS mode FROM question LEFT JOIN qm USING (q_id)),
graph AS (SELECT q_id, chunk_id, doc_id, ord, entity, CAST(row_number() OVER (PARTITION BY q_id ORDER BY entity, doc_id, ord) AS INTEGER) AS rank, top_k
          FROM qd JOIN about USING (entity) JOIN plan USING (q_id) QUALIFY rank <= top_k)"""
DISTANCE = "round(list_sum(list_transform(list_zip({a}, {b}), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))), 9)"
HITS = f"""{PLANS},
nv AS (SELECT max(vec_id) + 1 AS n FROM embeddings),
qv AS (SELECT q_id, top_k, mode, embedding AS e FROM plan, nv JOIN embeddings ON vec_id = length(question) % n WHERE mode <> 'GRAPH'),
cv AS (SELECT chunk_id, doc_id, ord, embedding AS e FROM chunk, nv JOIN embeddings ON vec_id = doc_id % n),
vd AS (SELECT q_id, mode, top_k, chunk_id, doc_id, ord, {DISTANCE.format(a="qv.e", b="cv.e")} AS score FROM qv, cv),
vector AS (SELECT q_id, mode, chunk_id, doc_id, ord, score, CAST(row_number() OVER (PARTITION BY q_id ORDER BY score, chunk_id) AS INTEGER) AS rank, top_k FROM vd QUALIFY rank <= top_k),
both_ AS (SELECT * FROM vector v WHERE mode = 'HYBRID' AND EXISTS (SELECT 1 FROM graph g WHERE g.q_id = v.q_id AND g.chunk_id = v.chunk_id)),
hybrid AS (SELECT * FROM both_ UNION ALL SELECT * FROM vector v WHERE mode = 'HYBRID' AND NOT EXISTS (SELECT 1 FROM both_ b WHERE b.q_id = v.q_id)),
sent AS (SELECT g.q_id, 'GRAPH' AS mode, 'graph' AS source, chunk_id, doc_id, ord, CAST(0 AS DOUBLE) AS score, rank FROM graph g JOIN plan p ON g.q_id = p.q_id AND p.mode = 'GRAPH'
  UNION ALL SELECT q_id, mode, 'hybrid', chunk_id, doc_id, ord, score, rank FROM hybrid
  UNION ALL SELECT q_id, mode, 'vector', chunk_id, doc_id, ord, score, rank FROM vector WHERE mode = 'VECTOR'),
cited AS (SELECT s.q_id, s.mode, s.chunk_id, s.doc_id, s.score, s.rank, c.text AS snippet, d.source AS title,
                 '[' || s.doc_id || ':' || s.chunk_id || '] ' || coalesce(nullif(d.source, ''), CAST(s.doc_id AS VARCHAR)) || ': ' || replace(c.text, chr(10), ' ') AS line
          FROM sent s JOIN chunk c USING (chunk_id) LEFT JOIN documents d ON d.doc_id = s.doc_id)"""


def _excerpt(text: str, most: int) -> str:
    line = rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"
    return f"CASE WHEN length({line}) <= {most} THEN {line} ELSE rtrim(substr({line}, 1, {most})) || '…' END"


def _replaced(text: str, pairs: list[tuple[str, str]]) -> str:
    for pattern, put in pairs:
        text = f"regexp_replace({text}, '{pattern}', '{put}', 'g')"
    return text


def _unescaped(text: str) -> str:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")):
        text = f"replace({text}, '{name}', '{char}')"
    return text


STRIPPED = [(r"^\s+|\s+$", "")]
SCHEME = r"lower(nullif(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1), ''))"
AUTHORITY = r"nullif(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '')"
NORMAL = r"coalesce(nullif(regexp_replace(regexp_replace({u}, '(?s)[?#].*$', ''), '/+$', ''), ''), regexp_replace({u}, '(?s)[?#].*$', ''))"
ORIGIN = f"({SCHEME} || '://' || {AUTHORITY})"
# Elements that are removed before anything is read.
_REMOVED = "script style noscript template nav footer form aside iframe".split()
_BARE = _replaced("coalesce(html, '')", [(rf"(?is)<{n}\b[^>]*>.*?</{n}\s*>", "") for n in _REMOVED])
_TEXTS = rf"list_filter(list_transform(regexp_split_to_array({{x}}, '<[^>]*>'), lambda t: {_replaced(_unescaped('t'), STRIPPED)}), lambda t: t <> '')"
TITLE = rf"coalesce(nullif(array_to_string({_TEXTS.format(x="regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)")}, ' '), ''), {NORMAL.format(u='url')})"
#: An open paragraph or heading holds all that comes before its end tag, so one without an end tag holds the rest of the article.
PAGES = rf"""
bare AS (SELECT page_id, url, {_BARE} AS h FROM pages),
inner_ AS (SELECT page_id, url, CASE WHEN regexp_extract(h, '(?is)<article\b[^>]*>(.*)</article>', 1) <> '' THEN regexp_extract(h, '(?is)<article\b[^>]*>(.*)</article>', 1) ELSE h END AS h FROM bare),
part AS (SELECT page_id, url, regexp_split_to_array(h, '(?i)<(?:p|h[1-6])\b[^>]*>')[2:] AS ps FROM inner_),
texts AS (SELECT page_id, url, list_transform(ps, lambda x: array_to_string({_TEXTS.format(x="x")}, ' ')) AS ts, list_transform(ps, lambda x: regexp_matches(x, '(?i)</(?:p|h[1-6])\s*>')) AS ended FROM part),
line AS (SELECT page_id, url, list_filter(list_transform(range(1, len(ts) + 1), lambda k: CASE WHEN ended[k] THEN ts[k] ELSE array_to_string(list_filter(ts[k:], lambda t: t <> ''), ' ') END), lambda t: t <> '') AS ls FROM texts),
page AS (SELECT page_id, url, array_to_string(ls, chr(10) || chr(10)) AS content FROM line)"""
#: The links that the pages of the crafted site are given.
SITE = f"""
host AS (SELECT *, {AUTHORITY.format(u='url')} AS host FROM pages),
nexts AS (SELECT page_id, url, host, html, lead(url, 1) OVER w AS u1, lead(url, 2) OVER w AS u2 FROM host WINDOW w AS (PARTITION BY host ORDER BY page_id)),
given AS (SELECT page_id, url, host, unnest([u1, u2, {ORIGIN.format(u='url')} || '/up/' || page_id]) AS u FROM nexts WHERE contains(html, '</article>')),
content_link AS (SELECT DISTINCT page_id, {NORMAL.format(u='u')} AS link FROM given WHERE u IS NOT NULL AND {SCHEME.format(u='url')} = {SCHEME.format(u='u')})"""
#: The site's texts: the links make a paragraph of their own at the end, which all open ones hold as well.
SITE_TEXTS = f"""{SITE},
pages_ AS (SELECT page_id, url, host, replace(coalesce(html, ''), '</article>', '<p>' || CASE WHEN u1 IS NULL THEN '' ELSE '<a>on</a>' END || ' ' || CASE WHEN u2 IS NULL THEN '' ELSE '<a>on</a>' END || ' <a>on</a> <a>on</a></p></article>') AS html FROM nexts),
{PAGES.replace("FROM pages)", "FROM pages_)").strip()}"""
#: The crawl as a queue: each step takes the first address of every root's queue and notes what becomes of it.
QUEUE = f"""WITH RECURSIVE {SITE_TEXTS.strip()},
named AS (SELECT page_id, CASE WHEN page_id % 3 = 1 AND contains(html, '<head>') THEN {ORIGIN.format(u='url')} || '/c/' || page_id // 9 ELSE {NORMAL.format(u='url')} END AS canonical FROM host),
found AS (SELECT page_id, list(DISTINCT link ORDER BY link) AS links FROM content_link GROUP BY page_id),
stored AS (SELECT {NORMAL.format(u='p.url')} AS addr, p.page_id, canonical, content, length(content) AS n, coalesce(links, []) AS links FROM page p JOIN named USING (page_id) LEFT JOIN found USING (page_id) QUALIFY row_number() OVER (PARTITION BY addr ORDER BY p.page_id) = 1),
root AS (SELECT arg_min(url, page_id) AS root FROM host GROUP BY host),
walk(root, todo, seen, texts, visit, total, ended, depth, address, reason, page_id, url, n, content) AS (
  SELECT root, [{{'url': {NORMAL.format(u='root')}, 'depth': 0}}], CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST(0 AS BIGINT), CAST(0 AS BIGINT), FALSE, 0, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM root
  UNION ALL
  SELECT root, CASE WHEN why = 'taken' AND d < 2 THEN list_concat(rest, list_transform(list_filter(links, lambda l: NOT list_contains(all_seen, l)), lambda l: {{'url': l, 'depth': d + 1}})) ELSE rest END, all_seen,
         CASE WHEN why IN ('taken', 'chars') THEN list_append(texts, content) ELSE texts END, visit + CASE WHEN why = 'taken' THEN 1 ELSE 0 END, total + CASE WHEN why = 'taken' THEN n ELSE 0 END, why = 'chars', d, u, why, page_id, canonical, n, content
  FROM (SELECT *, CASE WHEN why = 'taken' THEN list_append(now_seen, canonical) ELSE now_seen END AS all_seen FROM (
    SELECT *, CASE WHEN list_contains(seen, u) THEN 'seen' WHEN regexp_matches(u, '^[a-z]+://[^/]+/en/7') THEN 'robots' WHEN page_id IS NULL THEN 'missing' WHEN canonical <> u AND list_contains(now_seen, canonical) THEN 'canonical'
                   WHEN content = '' THEN 'empty' WHEN list_contains(texts, content) THEN 'text' WHEN total + n > 20000 THEN 'chars' ELSE 'taken' END AS why FROM (
      SELECT w.root, w.seen, list_append(w.seen, w.todo[1].url) AS now_seen, w.texts, w.visit, w.total, w.todo[1].url AS u, w.todo[1].depth AS d, w.todo[2:] AS rest, s.page_id, s.canonical, s.content, s.n, coalesce(s.links, []) AS links
      FROM walk w LEFT JOIN stored s ON s.addr = w.todo[1].url WHERE len(w.todo) > 0 AND w.visit < 5 AND NOT w.ended))))"""
LINKS = rf"""
href AS (SELECT page_id, url, trim(unnest(regexp_extract_all({{h}}, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1))) AS h FROM {{t}}),
whole AS (SELECT page_id, url, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN h LIKE '//%' THEN {SCHEME.format(u="url")} || ':' || h
               WHEN h LIKE '/%' THEN {SCHEME.format(u="url")} || '://' || {AUTHORITY.format(u="url")} || h END AS l FROM href WHERE h <> ''),
link AS (SELECT DISTINCT page_id, {NORMAL.format(u="l")} AS link FROM whole WHERE {SCHEME.format(u="url")} = {SCHEME.format(u="l")} AND {AUTHORITY.format(u="url")} = {AUTHORITY.format(u="l")})"""
BATCHES = "b AS (SELECT doc_id, source AS title, 1 AS seq FROM documents UNION ALL SELECT doc_id, source || ' (new)', 2 FROM documents WHERE doc_id % 2 = 1)"
SUMMARY = f"""{MENTIONS},
nc AS (SELECT doc_id, count(*) AS chunks FROM chunk GROUP BY doc_id), ne AS (SELECT doc_id, count(*) AS entities FROM mention GROUP BY doc_id),
summary AS (SELECT doc_id, coalesce(chunks, 0) AS chunks, coalesce(entities, 0) AS entities FROM documents LEFT JOIN nc USING (doc_id) LEFT JOIN ne USING (doc_id))"""

# Tags, hashes and marks that are cut out of answers.
_TAGS = [(r"(?i)\[doc_id:[^\]]*\]", ""), (r"(?i)\[chunk_id:[^\]]*\]", ""), (r"\[[^:\]]+:[^\]]*\]", "")]
_HEX = [(r"(?i)(?:\b[0-9a-f]{16,}\b:?)+", " "), (r"\s{2,}", " ")]
_POLISH = [(r"\(\s*\)", ""), (r":\s*-\s+", ": "), (r"([.!?])\s*-\s+", r"\1 "), (r"\s+-\s+", " "), (r"\s{2,}", " "), (r"\s+([,.;:])", r"\1"), (r"([,.;:])(\S)", r"\1 \2")]


def _untagged(text: str) -> str:
    return f"trim({_replaced(f'trim({_replaced(f"trim({_replaced(text, _TAGS)})", _HEX)})', _POLISH)})"


_PARSED = _replaced("text", STRIPPED)

ORACLE_SQL: dict[str, str] = {
    "chunk_windows": f"WITH {CHUNKS} SELECT chunk_id, doc_id, ord, window_tokens, md5(text) AS text_md5 FROM chunk",
    "chunk_approx_tokens": f"WITH {CHUNKS} SELECT chunk_id, CAST(greatest(window_tokens, 1, length(text) // 4) AS INTEGER) AS approx_tokens FROM chunk",
    "doc_size_guard": rf"SELECT doc_id, CAST(strlen({TEXT}) AS BIGINT) AS n_bytes, CASE WHEN strlen({TEXT}) > 5242880 THEN 'too_large' WHEN NOT regexp_matches({TEXT}, '\S') THEN 'empty' ELSE 'accepted' END AS status FROM documents",
    "page_count_formfeed": f"SELECT doc_id, CAST(CASE WHEN {TEXT} = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS INTEGER) AS n_pages FROM documents",
    "entity_phrases": f"WITH p AS (SELECT doc_id, unnest(regexp_extract_all({TEXT}, '{PHRASE}')) AS phrase FROM documents) SELECT phrase, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM p GROUP BY phrase",
    "entity_suffixes": rf"""WITH p AS (SELECT doc_id, regexp_split_to_array(unnest(regexp_extract_all({TEXT}, '{PHRASE}')), '\s+') AS a FROM documents),
        i AS (SELECT doc_id, a, unnest(range(2, len(a) + 1)) AS i FROM p), s AS (SELECT doc_id, array_to_string(a[i:], ' ') AS s FROM i)
        SELECT doc_id, count(*) AS n_suffixes, count(DISTINCT s) AS n_distinct, CAST(max(length(s)) AS BIGINT) AS longest FROM s GROUP BY doc_id""",
    "entity_words": f"WITH w AS (SELECT lower(unnest({LONG_WORDS.format(t=TEXT)})) AS word FROM documents) SELECT word, count(*) AS n FROM w GROUP BY word",
    "entity_candidates": f'WITH {MENTIONS} SELECT doc_id, count(*) AS n_entities, min(entity) AS "first", max(entity) AS "last" FROM mention GROUP BY doc_id',
    "mention_edges": f'WITH {ABOUT} SELECT chunk_id, doc_id, ord, count(*) AS n_edges, min(entity) AS "first", max(entity) AS "last" FROM about GROUP BY ALL',
    "entity_degrees": f"WITH {ABOUT} SELECT entity, degree FROM degree",
    "entity_neighbours": f"WITH {ABOUT}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY entity ORDER BY doc_id, ord) AS INTEGER) AS place FROM about QUALIFY place <= 3) SELECT r.entity, place, chunk_id, doc_id, d.source AS title FROM r LEFT JOIN documents d USING (doc_id)",
    "orphan_entities": f"WITH {ABOUT}, o AS (SELECT DISTINCT entity FROM mention ANTI JOIN about USING (entity)) SELECT md5(entity) AS entity_md5, CAST(length(entity) AS BIGINT) AS n_chars FROM o",
    "document_edges": f"WITH {CHUNKS} SELECT DISTINCT doc_id, chunk_id FROM chunk SEMI JOIN documents USING (doc_id)",
    "ingest_summary": f"WITH {SUMMARY} SELECT doc_id, chunks, entities, chunks AS vector_count, chunks AS chunks_ingested, entities AS entities_linked, chunks AS vectors_upserted, CAST(CASE WHEN {TEXT} = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS INTEGER) AS pages_ingested FROM summary JOIN documents USING (doc_id)",
    "ingest_totals": f"WITH {SUMMARY}, about AS (SELECT m.entity FROM mention m JOIN chunk c USING (doc_id) WHERE contains(lower(c.text), m.entity)), degree AS (SELECT entity, count(*) AS degree FROM about GROUP BY entity) SELECT count(*) AS n_documents, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(entities) AS BIGINT) AS entities, CAST(sum(chunks) AS BIGINT) AS vector_count, (SELECT count(*) FROM degree) AS linked_entities, (SELECT max(degree) FROM degree) AS max_degree FROM summary",
    "store_upsert_lww": f"WITH {BATCHES} SELECT doc_id, title, seq FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) = 1",
    "store_first_name_wins": f"WITH l AS (SELECT doc_id, regexp_extract_all({TEXT}, '{PHRASE}') AS l FROM documents), p AS (SELECT doc_id, unnest(l) AS name, unnest(range(len(l))) AS k FROM l) SELECT lower(name) AS entity_id, name, 'TERM' AS type FROM p QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY doc_id, k) = 1",
    "store_linked_edges": f"WITH {ABOUT} SELECT entity AS entity_id, degree AS n FROM degree WHERE degree >= 3",
    "ingest_entities": f"WITH {ABOUT}, m AS (SELECT entity, count(*) AS n_docs FROM mention GROUP BY entity) SELECT entity, n_docs, coalesce(degree, 0) AS degree FROM m LEFT JOIN degree USING (entity)",
    "key_constraints": f"WITH {ABOUT}, {BATCHES}, n AS (SELECT 'documents' AS t, count(*) - count(DISTINCT doc_id) AS n FROM documents UNION ALL SELECT 'chunks', count(*) - count(DISTINCT chunk_id) FROM chunk UNION ALL SELECT 'entities', 0 UNION ALL SELECT 'edges', count(*) - count(DISTINCT (chunk_id, entity)) FROM about UNION ALL SELECT 'batches', count(*) FROM (SELECT doc_id FROM b GROUP BY doc_id HAVING count(*) > 1)) SELECT t AS table_name, n AS n_broken FROM n",
    "edge_label_sanitise": "WITH k AS (SELECT event_type AS label FROM events UNION ALL SELECT source || '-x' FROM documents) SELECT coalesce(label, '') AS label, CASE WHEN coalesce(label, '') = '' THEN 'ABOUT' WHEN regexp_full_match(upper(label), '[A-Z_][A-Z0-9_]*') THEN upper(label) ELSE 'ABOUT' END AS rel, count(*) AS n FROM k GROUP BY ALL",
    "question_plan": f"WITH {PLANS} SELECT q_id, mode, CASE mode WHEN 'GRAPH' THEN 'an entity has degree ' || max_degree WHEN 'HYBRID' THEN 'its entities are rare' ELSE 'no entity is known' END AS reason, CAST(top_k AS INTEGER) AS top_k, max_degree, n_entities, md5(entities) AS entities_md5 FROM plan",
    "question_validation": """WITH q AS (SELECT conv_id || '-' || turn AS q_id, CASE WHEN turn % 7 = 6 THEN '' ELSE text END AS question, CAST(turn - 1 AS INTEGER) AS top_k, CASE role WHEN 'user' THEN 'stub' WHEN 'assistant' THEN NULL ELSE role END AS provider_override FROM conversations)
        SELECT q_id, top_k, provider_override, CASE WHEN strlen(coalesce(question, '')) > 1048576 THEN 'too_large' WHEN coalesce(question, '') = '' THEN 'blank_question' WHEN top_k < 1 THEN 'top_k_below_1'
               WHEN provider_override NOT IN ('ollama', 'groq', 'stub', 'llamacpp') THEN 'unknown_provider' END AS error FROM q""",
    "url_request_validation": r"""WITH r AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN '' WHEN 1 THEN ' ' WHEN 2 THEN 'ftp:' || url ELSE ' ' || url || chr(10) END AS url, CAST(page_id % 5 - 1 AS INTEGER) AS max_depth, CAST(page_id % 4 AS INTEGER) AS max_pages FROM pages),
        t AS (SELECT *, regexp_replace(url, '^\s+|\s+$', '', 'g') AS bare FROM r),
        e AS (SELECT *, CASE WHEN url = '' THEN 'blank_url' WHEN bare = '' THEN 'empty_url' WHEN NOT regexp_matches(bare, '^https?://') THEN 'not_http' WHEN max_depth < 0 THEN 'max_depth_below_0' WHEN max_pages < 1 THEN 'max_pages_below_1' END AS error FROM t)
        SELECT page_id, CASE WHEN error IS NULL THEN bare ELSE url END AS url, max_depth, max_pages, error FROM e""",
    "provider_toggle_validation": """WITH r AS (SELECT event_id, ['ollama', ' Groq ', '', 'stub', 'other', NULL][event_id % 6 + 1] AS provider FROM events)
        SELECT event_id, CASE WHEN event_id % 6 = 1 THEN 'groq' ELSE provider END AS provider, CASE WHEN event_id % 6 IN (2, 5) THEN 'blank_provider' WHEN event_id % 6 IN (3, 4) THEN 'unknown_provider' END AS error FROM r""",
    "first_titled_citation": f"WITH {HITS}, t AS (SELECT q_id, arg_min(trim(title), rank) AS title FROM cited WHERE trim(title) <> '' GROUP BY q_id) SELECT q_id, coalesce(title, 'Untitled') AS title FROM plan LEFT JOIN t USING (q_id)",
    "vector_norms": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm FROM embeddings",
    "vector_topk_batch": f"WITH s AS (SELECT q.vec_id AS q_id, e.vec_id, {DISTANCE.format(a='q.embedding', b='e.embedding')} AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0) SELECT q_id, vec_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY q_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY s.score, vec_id) <= {TOP_K}",
    "vector_insertion_order": f"WITH f AS (SELECT vec_id AS id, CAST(row_number() OVER (ORDER BY vec_id) AS INTEGER) AS rank FROM embeddings QUALIFY rank <= {TOP_K}) SELECT q.vec_id AS q_id, id, rank, CAST(0 AS DOUBLE) AS score FROM embeddings q, f WHERE q.vec_id % 50 = 0",
    "graph_topk": f"WITH {PLANS} SELECT q_id, chunk_id, doc_id, ord, entity, rank FROM graph",
    "hybrid_topk": f"WITH {HITS} SELECT q_id, chunk_id, round(score, 6) AS score, rank FROM hybrid",
    "mode_dispatch": f"WITH {HITS} SELECT q_id, mode, source, chunk_id, doc_id, ord, round(score, 6) AS score, rank FROM sent",
    "citations": f"WITH {HITS} SELECT q_id, rank, chunk_id, doc_id, title, round(score, 6) AS score, md5(snippet) AS snippet_md5 FROM cited",
    "confidence": f"WITH {HITS}, a AS (SELECT q_id, count(*) AS n, avg(score) AS m FROM cited GROUP BY q_id) SELECT q_id, mode, coalesce(n, 0) AS n_citations, round(CASE WHEN m IS NULL THEN 0.5 ELSE greatest(0.1, least(0.99, 1 / (1 + m))) END, 6) AS confidence FROM plan LEFT JOIN a USING (q_id)",
    "context_lines": f"WITH {HITS} SELECT q_id, rank, md5(line) AS line_md5 FROM cited",
    "prompt_text": f"WITH {HITS}, b AS (SELECT q_id, string_agg(line, chr(10) ORDER BY rank) AS block FROM cited GROUP BY q_id), t AS (SELECT q_id, '{HEADER}' || chr(10) || chr(10) || coalesce(block, '{NOTHING}') || chr(10) || chr(10) || 'Question: ' || {_replaced('question', STRIPPED)} AS p FROM plan LEFT JOIN b USING (q_id)) SELECT q_id, CAST(length(p) AS BIGINT) AS n_chars, md5(p) AS prompt_md5 FROM t",
    "stub_answers": f"WITH {PLANS} SELECT q_id, 'stub' AS provider, '{STUB_ANSWER}' AS answer FROM plan",
    "provider_fallback": f"WITH {PLANS} SELECT q_id, 'llamacpp' AS provider, md5(CASE WHEN q_id LIKE 'b-%' THEN {_replaced('question', STRIPPED)} ELSE '{FAILED}{STUB_ANSWER}' END) AS answer_md5 FROM plan",
    "shown_citations": f"WITH {HITS} SELECT q_id, rank, doc_id || ':' || chunk_id AS citation_id, coalesce(nullif(trim(title), ''), 'Untitled') AS title, '“' || {_excerpt('snippet', 120)} || '”' AS short_quote, '“' || {_excerpt('snippet', 240)} || '”' AS long_quote, printf('%.2f', score) AS relevance FROM cited",
    "url_normalise": f"SELECT page_id, {NORMAL.format(u='url')} AS url FROM pages",
    "url_validate": f"WITH g AS (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'ftp:' || url WHEN page_id % 10 = 1 THEN 'https:///path' ELSE url END AS url FROM pages) SELECT page_id, coalesce({SCHEME.format(u='url')} IN ('http', 'https') AND {AUTHORITY.format(u='url')} IS NOT NULL, FALSE) AS valid FROM g",
    "same_origin_pages": f"SELECT {SCHEME.format(u='url')} AS scheme, {AUTHORITY.format(u='url')} AS authority, count(*) AS n FROM pages GROUP BY ALL",
    "page_title": f"SELECT page_id, {TITLE} AS title FROM pages",
    "page_links": f"WITH {LINKS.format(h='''coalesce(html, '')''', t='pages')} SELECT page_id, link FROM link",
    "page_content_links": f"WITH {SITE} SELECT page_id, link FROM content_link",
    "page_main_text": f"WITH {PAGES} SELECT page_id, content FROM page",
    "page_dedupe_sha1": f"WITH {PAGES} SELECT min(page_id) AS page_id, sha1(content) AS sha1 FROM page WHERE content <> '' GROUP BY content",
    "page_read": f"SELECT page_id, url, {NORMAL.format(u='url')} AS canonical_url, CAST(0 AS INTEGER) AS n_links FROM pages",
    "page_dedupe_canonical": f"SELECT CASE WHEN page_id % 3 = 1 AND contains(html, '<head>') THEN {ORIGIN.format(u='url')} || '/c/' || page_id // 9 ELSE {NORMAL.format(u='url')} END AS canonical_url, min(page_id) AS page_id FROM pages GROUP BY 1",
    "crawl_pages": f"""{QUEUE} SELECT root, CAST(visit AS INTEGER) AS visit, CAST(depth AS INTEGER) AS depth, page_id, url, CAST(n AS BIGINT) AS n_chars, md5(content) AS content_md5 FROM walk WHERE reason = 'taken'""",
    "crawl_skipped": f"""{QUEUE} SELECT root, CAST(depth AS INTEGER) AS depth, address, reason FROM walk WHERE reason IN ('robots', 'missing')""",
    "crawl_char_budget": f"WITH {PAGES}, v AS (SELECT page_id, {AUTHORITY.format(u='url')} AS host, CAST(length(content) AS BIGINT) AS n_chars, CAST(row_number() OVER w AS INTEGER) AS visit, CAST(sum(length(content)) OVER w AS BIGINT) AS total_chars FROM page WHERE content <> '' WINDOW w AS (PARTITION BY {AUTHORITY.format(u='url')} ORDER BY page_id)) SELECT page_id, host, visit, n_chars, total_chars FROM v WHERE visit <= 5 AND total_chars <= 20000",
    "crawl_robots": f"WITH r AS (SELECT DISTINCT {AUTHORITY.format(u='url')} AS host FROM pages WHERE contains(url, '/en/')) SELECT page_id FROM pages p WHERE NOT (regexp_matches(url, '^[A-Za-z]+://[^/?#]*/fr/') AND NOT regexp_matches(url, '^[A-Za-z]+://[^/?#]*/fr/1') AND EXISTS (SELECT 1 FROM r WHERE r.host = {AUTHORITY.format(u='p.url')}))",
    "crawl_bfs": f"""WITH o AS (SELECT page_id, row_number() OVER w AS k, lead(page_id, 1) OVER w AS n1, lead(page_id, 2) OVER w AS n2 FROM pages WINDOW w AS (PARTITION BY {AUTHORITY.format(u='url')} ORDER BY page_id)),
        l AS (SELECT page_id AS s, n1 AS t FROM o WHERE n1 IS NOT NULL UNION SELECT page_id, n2 FROM o WHERE n2 IS NOT NULL),
        d0 AS (SELECT page_id AS root, page_id AS url, 0 AS depth FROM o WHERE k = 1), d1 AS (SELECT root, t AS url, 1 AS depth FROM d0 JOIN l ON url = s), d2 AS (SELECT root, t AS url, 2 AS depth FROM d1 JOIN l ON url = s)
        SELECT root, url, CAST(min(depth) AS INTEGER) AS depth FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2) GROUP BY ALL""",
    "provider_payload_parse": f"SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 8 IN (0, 6) THEN 'ollama' WHEN (conv_id + turn) % 8 IN (1, 2, 5) THEN 'llamacpp' ELSE 'groq' END AS provider, CASE WHEN (conv_id + turn) % 8 < 6 THEN nullif({_PARSED}, '') END AS reply FROM conversations WHERE text IS NOT NULL",
    "provider_resolve": """WITH a AS (SELECT event_id, ['auto', 'Groq', 'stub', 'llamacpp', 'hosted', 'other', NULL, 'local'][event_id % 8 + 1] AS provider_override FROM events),
        p AS (SELECT *, ['ollama', 'groq', 'stub', 'llamacpp', 'groq', 'stub', 'ollama', 'ollama'][event_id % 8 + 1] AS provider FROM a)
        SELECT event_id, provider_override, provider, CASE provider WHEN 'groq' THEN 'hosted' WHEN 'stub' THEN 'stub' ELSE 'local' END AS provider_kind FROM p""",
    "provider_preference": "WITH w(priority, model) AS (VALUES (1, 'es'), (2, 'de'), (3, 'en')) SELECT source AS host, arg_min(model, priority) AS model FROM documents JOIN w ON lang = model GROUP BY source",
    "upload_guard": "SELECT event_id, CASE WHEN event_id % 4 IN (1, 3) THEN 'unsupported_type' WHEN event_id * 1000 > 5242880 THEN 'too_large' ELSE 'accepted' END AS status FROM events",
    "vector_dimension_guard": "SELECT vec_id, CASE WHEN embedding IS NULL OR (vec_id % 10 <> 0 AND vec_id % 11 = 0) THEN 'no_vector' WHEN vec_id % 10 = 0 THEN 'dimension' END AS error FROM embeddings",
    "embedding_reply_parse": "SELECT vec_id, CAST(CASE vec_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS INTEGER) AS n, CASE WHEN vec_id % 4 < 2 THEN round(list_sum(list_transform(embedding, lambda x: CAST(CAST(x AS VARCHAR) AS DOUBLE))), 3) WHEN vec_id % 4 = 2 THEN 3.5 END AS total FROM embeddings",
    "model_choice": """WITH w(priority, model) AS (VALUES (1, 'es'), (2, 'de'), (3, 'en')), h AS (SELECT source AS host, arg_min(model, priority) AS m FROM documents LEFT JOIN w ON lang = model WHERE source IS NOT NULL GROUP BY source),
        l AS (SELECT host, CASE WHEN length(host) % 2 = 1 THEN m END AS m, unnest(['auto', 'groq', 'stub']) AS o FROM h)
        SELECT host, o AS provider_override, CASE WHEN o = 'auto' AND m IS NOT NULL THEN 'ollama' WHEN o = 'groq' THEN 'groq' ELSE 'stub' END AS provider, CASE WHEN o = 'auto' AND m IS NOT NULL THEN 'local' WHEN o = 'groq' THEN 'hosted' ELSE 'stub' END AS provider_kind, CASE WHEN o = 'auto' THEN m END AS model FROM l""",
    "hosted_models_url": f"SELECT page_id, {ORIGIN.format(u='url')} || CASE page_id % 7 WHEN 6 THEN '/v2' ELSE '' END || '/openai/v1/models' AS models_url FROM pages",
    "answer_sanitise": rf"""WITH t AS (SELECT conv_id, turn, text || ' See [doc_id:1] and [abc:2] deadbeefdeadbeef00: end. This doc_id is known. The end ( ) , then - done.' AS t FROM conversations WHERE role = 'assistant'),
        s AS (SELECT conv_id, turn, t, array_to_string(list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '' AND NOT regexp_matches(lower(x), 'this information can be found at|doc_id|chunk_id')), ' ') AS k FROM t)
        SELECT conv_id, turn, coalesce(nullif({_untagged('k')}, ''), nullif({_untagged('t')}, ''), t) AS answer FROM s""",
    "excerpts": f'SELECT conv_id, turn, {_excerpt("text", 120)} AS "short", {_excerpt("text", 240)} AS "long" FROM conversations',
    "last_summary": rf"""WITH l AS (SELECT conv_id, trim(regexp_replace(arg_max(text, turn), '\s+', ' ', 'g')) AS l FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
        f AS (SELECT conv_id, l, coalesce(nullif(trim(regexp_extract(l, '^(.*?[.!?](?:\s|$))', 1)), ''), l) AS f FROM l) SELECT conv_id, CASE WHEN l <> '' THEN {_excerpt("f", 110)} END AS summary FROM f""",
    "recent_questions": "WITH q AS (SELECT conv_id, trim(text) AS question, max(turn) AS turn FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY ALL) SELECT conv_id, question, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, question) AS INTEGER) AS place FROM q QUALIFY place <= 5",
}
