"""The registered queries as SQL over the same tables, for comparison in DuckDB."""

from __future__ import annotations

from gleaner.functions.queries import QUERY_PREFIX, SENTENCE_PREFIX
from gleaner.functions.text import WHITESPACE
from gleaner.operators import filters
from gleaner.operators.embed import EMBED_DIM
from gleaner.plans.derived import ASKED, KNOWN, MODELS, PATH_FORMS


def _strings(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{value}'" for value in values)


def _strip(text: str) -> str:
    return f"trim({text}, '{WHITESPACE}')"


# Nearest neighbours.

_PAIR = "list_transform(list_zip(a.embedding, b.embedding), lambda p: {term})"
_L2SQ = f"list_sum({_PAIR.format(term='(p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)')})"


def _norm(side: str) -> str:
    return f"sqrt(list_sum(list_transform({side}.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"


_COSINE = f"1 - list_sum({_PAIR.format(term='p[1]::DOUBLE * p[2]::DOUBLE')}) / ({_norm('a')} * {_norm('b')})"


def _knn(distance: str = _L2SQ, where: str = "true") -> str:
    return f"""
    WITH pairs AS (
        SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {distance} AS d
        FROM embeddings a, embeddings b WHERE {where}),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 6), vec_id)::INTEGER AS rank
        FROM pairs)
    SELECT query_id, vec_id, rank, round(d, 6) + 0.0 AS distance, round(1 - d, 3) + 0.0 AS score
    FROM ranked WHERE rank <= 5"""


# Chunks.

_TOKENS = r"'[^ \t\n\r]+[ \t\n\r]*'"


def _windows(table: str, keys: str) -> str:
    """CTEs ending in ``chunks`` ({keys}, chunk_no, text)."""
    return f"""
    tokens AS (
        SELECT {keys}, regexp_extract_all(text, {_TOKENS}) AS t FROM {table}
        WHERE {_strip('text')} <> ''),
    numbered AS (
        SELECT *, unnest(range(greatest(ceil((len(t) - 64) / 448.0), 1)::BIGINT)) AS i FROM tokens),
    chunks AS (
        SELECT {keys}, i::INTEGER AS chunk_no,
               array_to_string(list_slice(t, i * 448 + 1, i * 448 + 512), '') AS text
        FROM numbered)"""


_SENTENCES = rf"""
    WITH RECURSIVE marked AS (
        SELECT doc_id, string_split(regexp_replace(
            text, '([.!?]+[ \t\n\r]+|\n[ \t\n\r]*)', '\1' || chr(1), 'g'), chr(1)) AS s
        FROM documents WHERE {_strip('text')} <> ''),
    sentences AS (
        SELECT doc_id, unnest(range(len(s))) AS n, unnest(s) AS sentence FROM marked),
    tokenised AS (
        SELECT doc_id, n, regexp_extract_all(sentence, {_TOKENS}) AS t FROM sentences),
    cut AS (
        SELECT doc_id, n, unnest(range(0, len(t), 512)) AS o, t FROM tokenised WHERE len(t) > 0),
    pieces AS (
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, o) AS p,
               array_to_string(list_slice(t, o + 1, o + 512), '') AS piece,
               least(len(t) - o, 512) AS width
        FROM cut),
    places AS (
        SELECT *, sum(width) OVER (PARTITION BY doc_id ORDER BY p) AS upto,
               sum(width) OVER (PARTITION BY doc_id ORDER BY p) - width AS before
        FROM pieces),
    spans AS (
        SELECT a.doc_id, a.p AS first, max(b.p) AS last
        FROM places a JOIN places b
          ON a.doc_id = b.doc_id AND b.p >= a.p AND b.upto - a.before <= 512
        GROUP BY ALL),
    steps AS (
        SELECT s.doc_id, s.first, s.last, min(c.p) AS next
        FROM spans s
        JOIN places e ON e.doc_id = s.doc_id AND e.p = s.last
        JOIN places f ON f.doc_id = s.doc_id AND f.p = s.last + 1
        JOIN places c ON c.doc_id = s.doc_id AND c.p > s.first AND c.p <= s.last + 1
         AND e.upto - c.before <= 64 AND f.upto - c.before <= 512
        GROUP BY ALL
        UNION ALL
        SELECT s.doc_id, s.first, s.last, NULL FROM spans s
        WHERE NOT EXISTS (SELECT 1 FROM places f WHERE f.doc_id = s.doc_id AND f.p = s.last + 1)),
    walk AS (
        SELECT doc_id, 0 AS chunk_no, first, last, next FROM steps WHERE first = 1
        UNION ALL
        SELECT w.doc_id, w.chunk_no + 1, s.first, s.last, s.next
        FROM walk w JOIN steps s ON s.doc_id = w.doc_id AND s.first = w.next)
    SELECT w.doc_id, w.chunk_no::INTEGER AS chunk_no, string_agg(p.piece, '' ORDER BY p.p) AS text
    FROM walk w JOIN places p ON p.doc_id = w.doc_id AND p.p BETWEEN w.first AND w.last
    GROUP BY w.doc_id, w.chunk_no"""


# Derived inputs.

_NUMBER = "regexp_extract(source, '(\\d+)', 1)::INTEGER"

_FILES = f"""
    files AS (
        SELECT source, 'main' AS branch,
               replace(list_extract([{_strings(PATH_FORMS)}], {_NUMBER} % {len(PATH_FORMS)} + 1),
                       '{{}}', doc_id::VARCHAR) AS file_path,
               CASE WHEN source = 'src9' AND lang = 'fr' THEN NULL
                    WHEN n_chars < 200 THEN ' ' || chr(10) || chr(9)
                    WHEN lang = 'de' THEN text || chr(65533) || chr(65533)
                    ELSE text END AS content
        FROM documents),
    named AS (
        SELECT *, regexp_extract(string_split(file_path, '/')[-1], '(?s)^.+(\\.[^.]+)$', 1) AS suffix,
               string_split(file_path, '/') AS parts
        FROM files),
    judged AS (
        SELECT *, suffix IN ({_strings(filters.CODE_SUFFIXES)}) AS is_code,
               suffix IN ({_strings(filters.DOC_SUFFIXES)})
                   AND NOT list_has_any(parts, [{_strings(filters.DOC_SKIP_DIRS)}]) AS is_docs,
               starts_with(file_path, 'tests/') AND (suffix = '.py' OR (
                   list_has_any(parts, [{_strings(filters.CASE_DIRS)}])
                   AND suffix IN ({_strings(filters.CASE_SUFFIXES)}))) AS is_tests,
               suffix IN ({_strings(filters.TUTORIAL_SUFFIXES)})
                   AND NOT list_has_any(parts, [{_strings(filters.TUTORIAL_SKIP_DIRS)}]) AS is_tutorials,
               substr(suffix, 2) AS tag
        FROM named)"""


def _outcome(test: str) -> str:
    return f"""CASE WHEN NOT {test} THEN 'type' WHEN content IS NULL THEN 'unreadable'
               WHEN {_strip('content')} = '' THEN 'blank' ELSE 'loaded' END"""


_REGISTRY = f"""
    registry AS (
        SELECT 'team/' || source AS name, 'https://git.example.com/' || source AS url,
               CASE WHEN {_NUMBER} % 3 <> 0 THEN 'master' END AS branch,
               CASE {_NUMBER} % 4 WHEN 0 THEN 'tutorials' WHEN 1 THEN 'prerequisite'
                    WHEN 2 THEN 'docs' END AS category,
               nullif({_NUMBER} % 5, 0) AS priority
        FROM (SELECT DISTINCT source FROM documents)),
    filled AS (
        SELECT name, url, coalesce(branch, 'main') AS branch,
               coalesce(category, 'tutorials') AS category,
               coalesce(priority, 99)::INTEGER AS priority,
               replace(name, '/', '__') AS source_key, category AS given
        FROM registry)"""

_DOCS = """
    docs AS (
        SELECT CASE lang WHEN 'en' THEN 'code' WHEN 'fr' THEN 'docs' ELSE 'tests' END AS collection,
               'doc' || doc_id AS doc_key, text, sha256(text) AS content_hash,
               CASE WHEN lang = 'en' THEN source || '/doc' || doc_id || '.py' END AS file_path,
               CASE WHEN lang = 'fr' THEN 'https://docs.example.com/doc' || doc_id END AS url,
               source, lang AS language,
               CASE WHEN lang = 'de' THEN 'python_test' END AS doc_type
        FROM documents),
    edited AS (
        SELECT * EXCLUDE (content_hash), sha256(text) AS content_hash FROM (
            SELECT * REPLACE (
                CASE WHEN language = 'fr' THEN text || ' edited' ELSE text END AS text,
                CASE WHEN language = 'de' THEN doc_key || '-new' ELSE doc_key END AS doc_key)
            FROM docs WHERE source <> 'src3'))"""

_LABEL = """coalesce(nullif(file_path, ''), nullif(url, ''), source, '?')
            || CASE WHEN coalesce(doc_type, '') <> '' THEN '  [' || doc_type || ']' ELSE '' END"""

_QUERIES = f"""
    queries AS (
        SELECT 'q' || item_id AS query_id,
               list_extract([{_strings(ASKED)}], item_id % {len(ASKED)} + 1) AS collection,
               text AS query,
               CASE WHEN item_id % 7 <> 0 THEN item_id - 3 END AS n_results,
               greatest(least(coalesce(n_results, 5), 20), 0)::INTEGER AS k
        FROM benchmark)"""

# Embedding and search.


def _vectors(chunks: str, key: str) -> str:
    """CTEs ending in ``weights`` (b, weight), fitted on ``chunks``, and ``vectors`` of it."""
    return f"""
    words AS (
        SELECT {key}, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM {chunks}),
    counts AS (
        SELECT {key}, ('0x' || substr(md5(w), 1, 7))::BIGINT % {EMBED_DIM} AS b, count(*) AS c
        FROM words GROUP BY ALL),
    weights AS (
        SELECT b, ln(((SELECT count(*) FROM {chunks}) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) AS weight
        FROM counts GROUP BY b),
    vectors AS (
        SELECT {key}, b, (c * weight / sqrt(sum((c * weight) * (c * weight)) OVER (PARTITION BY {key}))
                         )::FLOAT::DOUBLE AS e
        FROM counts JOIN weights USING (b))"""


_HITS = f"""
    WITH {_DOCS}, {_QUERIES}, {_windows('docs', 'collection, doc_key, content_hash, file_path, url, source, doc_type')},
    keyed AS (
        SELECT *, sha256(concat_ws('|', collection, source, coalesce(file_path, url, doc_key), chunk_no))
                   AS chunk_id
        FROM chunks),
    {_vectors('keyed', 'chunk_id')},
    query_counts AS (
        SELECT query_id, ('0x' || substr(md5(w), 1, 7))::BIGINT % {EMBED_DIM} AS b, count(*) AS c
        FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+')) AS w
              FROM queries) GROUP BY ALL),
    all_weights AS (
        SELECT r.b, coalesce(weight, ln((SELECT count(*) FROM keyed) + 1.0::DOUBLE)) AS weight
        FROM (SELECT unnest(range({EMBED_DIM})) AS b) r LEFT JOIN weights USING (b)),
    query_vectors AS (
        SELECT query_id, b, (c * weight / sqrt(sum((c * weight) * (c * weight)) OVER (PARTITION BY query_id))
                            )::FLOAT::DOUBLE AS e
        FROM query_counts JOIN all_weights USING (b)),
    dots AS (
        SELECT query_id, chunk_id, sum(q.e * v.e) AS dot
        FROM query_vectors q JOIN vectors v USING (b) GROUP BY ALL),
    query_sums AS (SELECT query_id, sum(e * e) AS s FROM query_vectors GROUP BY ALL),
    chunk_sums AS (SELECT chunk_id, sum(e * e) AS s FROM vectors GROUP BY ALL),
    distances AS (
        SELECT q.query_id, q.k, c.*,
               greatest(coalesce(qs.s, 0) + coalesce(cs.s, 0) - 2 * coalesce(dot, 0), 0) AS d
        FROM queries q JOIN keyed c USING (collection)
        LEFT JOIN query_sums qs USING (query_id) LEFT JOIN chunk_sums cs USING (chunk_id)
        LEFT JOIN dots USING (query_id, chunk_id)),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 6), chunk_id)::INTEGER AS rank
        FROM distances),
    hits AS (
        SELECT *, {_LABEL} AS label, round(1 - d, 3) + 0.0 AS score FROM ranked WHERE rank <= k)"""

_STATUS = f"""{_HITS},
    built AS (SELECT unnest(['code', 'docs', 'tests', 'tutorials']) AS collection),
    sizes AS (SELECT b.collection, count(c.chunk_id) AS n
              FROM built b LEFT JOIN keyed c USING (collection) GROUP BY ALL),
    found AS (SELECT query_id, count(*) AS n FROM hits GROUP BY ALL),
    statuses AS (
        SELECT query_id, collection,
               CASE WHEN collection NOT IN ({_strings(KNOWN)}) THEN 'unknown'
                    WHEN s.n IS NULL THEN 'missing' WHEN s.n = 0 THEN 'empty'
                    WHEN coalesce(f.n, 0) = 0 THEN 'no_results' ELSE 'ok' END AS status,
               coalesce(f.n, 0) AS n_hits
        FROM queries LEFT JOIN sizes s USING (collection) LEFT JOIN found f USING (query_id))"""

# Pages.

_NODE = _strip("replace(regexp_replace(n, '&amp;?', '&', 'g'), '&quot;', '\"')")
_PAGES = f"""
    parsed AS (
        SELECT page_id, url,
               array_to_string(list_filter(list_transform(
                   regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>'),
                   lambda n: {_NODE}), lambda n: n <> ''), chr(10)) AS main_text,
               {_NODE.replace('(n,', "(regexp_extract(html, '(?s)<title>(.*?)</title>', 1),")} AS title,
               rtrim(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1), '/') AS base,
               regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs
        FROM pages),
    links AS (
        SELECT DISTINCT url AS src_url, regexp_replace(CASE
            WHEN starts_with(href, '/') AND NOT starts_with(href, '//') THEN base || href
            WHEN starts_with(href, base || '/') THEN href END, '[#?].*$', '') AS dst_url
        FROM (SELECT url, base, unnest(hrefs) AS href FROM parsed WHERE length(main_text) >= 100)),
    kept_links AS (SELECT * FROM links WHERE dst_url IS NOT NULL)"""

ORACLES: dict[str, str] = {
    "knn_single": """
        WITH d AS (
            SELECT vec_id, label, list_sum(list_transform(embedding,
                lambda x: (x::DOUBLE - 0.125) * (x::DOUBLE - 0.125))) AS d
            FROM embeddings)
        SELECT vec_id, label, round(d, 6) + 0.0 AS distance, round(1 - d, 3) + 0.0 AS score
        FROM d ORDER BY round(d, 6), vec_id LIMIT 20""",
    "knn_batch": _knn(),
    "knn_routed": _knn(),
    "knn_approx_recall": "SELECT count(*) AS n_queries, true AS enough FROM embeddings",
    "knn_coded_recall": "SELECT count(*) AS n_queries, true AS enough FROM embeddings",
    "knn_cosine": _knn(_COSINE),
    "knn_by_collection": _knn(where="a.label = b.label"),
    "knn_blocks": _knn(where="a.label = b.label"),
    "knn_cells": _knn(),
    "chunk_windows": f"WITH {_windows('documents', 'doc_id')} SELECT * FROM chunks",
    "chunk_sentences": _SENTENCES,
    "chunk_stats_by_source": f"""
        WITH {_windows('documents', 'doc_id, source')}
        SELECT source, count(*) AS n_chunks, count(*) FILTER (chunk_no = 0) AS n_documents,
               sum(length(text))::BIGINT AS n_chars, max(chunk_no) AS last_chunk
        FROM chunks GROUP BY source""",
    "content_stats": f"""
        SELECT source, count(*) FILTER ({_strip('text')} <> '') AS loaded,
               count(*) FILTER ({_strip('text')} = '') AS skipped,
               sum(length(text))::BIGINT AS raw_chars,
               sum(length({_strip('text')}))::BIGINT AS stripped_chars
        FROM documents GROUP BY source""",
    "document_metadata": f"""
        WITH {_DOCS}
        SELECT collection, doc_key, content_hash, file_path, url, source, doc_type,
               CASE WHEN file_path IS NOT NULL THEN 'py' ELSE 'none' END AS file_language,
               {_LABEL} AS label
        FROM docs""",
    "source_union": f"""
        WITH u AS (
            SELECT 'documents' AS source, 'documents|' || doc_id AS doc_key, text FROM documents
            UNION ALL SELECT 'benchmark', 'benchmark|' || item_id, text FROM benchmark
            UNION ALL SELECT 'conversations', 'conversations|' || conv_id || '.' || turn, text
            FROM conversations)
        SELECT source, doc_key, sha256(text) AS content_hash FROM u WHERE {_strip('text')} <> ''""",
    "page_main_text": f"""
        WITH {_PAGES} SELECT page_id, main_text FROM parsed WHERE length(main_text) >= 100""",
    "page_title": f"WITH {_PAGES} SELECT page_id, url, title FROM parsed",
    "page_documents": f"""
        WITH {_PAGES}
        SELECT 'docs' AS collection, url AS doc_key, sha256(main_text) AS content_hash, url, title,
               regexp_replace(base, '^[a-z]+://', '') AS source
        FROM parsed WHERE length(main_text) >= 100""",
    "page_link_rows": f"WITH {_PAGES} SELECT src_url, dst_url FROM kept_links",
    "link_targets": f"WITH {_PAGES} SELECT DISTINCT dst_url FROM kept_links",
    "url_canonical": """
        SELECT page_id, regexp_replace(url, '(?s)[#?].*$', '') AS canonical,
               regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/' AS base
        FROM pages""",
    "crawl_pages": f"""
        WITH {_PAGES}
        SELECT url, 0 AS depth, true AS found, length(main_text) >= 100 AS kept FROM parsed
        UNION ALL
        SELECT DISTINCT dst_url, 1, false, false FROM kept_links
        WHERE dst_url NOT IN (SELECT url FROM pages)""",
    "crawl_documents": f"""
        WITH RECURSIVE {_PAGES},
        walk AS (
            SELECT min(url) AS url FROM parsed GROUP BY base
            UNION
            SELECT l.dst_url FROM walk w JOIN kept_links l ON l.src_url = w.url)
        SELECT url AS doc_key, title, regexp_replace(base, '^[a-z]+://', '') AS source,
               sha256(main_text) AS content_hash
        FROM parsed WHERE url IN (SELECT url FROM walk) AND length(main_text) >= 100""",
    "reachable_turns": """
        WITH RECURSIVE nodes AS (
            SELECT conv_id || '/' || turn AS url, length(text) >= 100 AS kept,
                   [conv_id || '/' || (turn + 1), conv_id || '/' || (turn + 2), conv_id || '/0'] AS targets
            FROM conversations),
        walk AS (
            SELECT DISTINCT conv_id || '/0' AS url, 0 AS depth FROM conversations
            UNION
            SELECT unnest(n.targets), w.depth + 1 FROM walk w JOIN nodes n ON n.url = w.url AND n.kept
            WHERE w.depth < (SELECT count(*) FROM conversations c
                             WHERE c.conv_id = string_split(w.url, '/')[1]::BIGINT) + 2),
        best AS (SELECT url, min(depth) AS depth FROM walk GROUP BY url)
        SELECT b.url, b.depth, n.url IS NOT NULL AS found, coalesce(n.kept, false) AS kept
        FROM best b LEFT JOIN nodes n USING (url)""",
    "query_formats": f"""
        WITH {_QUERIES}, m AS (SELECT unnest([{_strings(MODELS)}]) AS model)
        SELECT query_id, model,
               CASE WHEN lower(model) LIKE '%mxbai%' THEN '{SENTENCE_PREFIX}' || query
                    WHEN lower(model) LIKE '%e5%' OR lower(model) LIKE '%gte-%'
                      OR lower(model) LIKE '%snowflake-arctic%' THEN '{QUERY_PREFIX}' || query
                    ELSE query END AS formatted, k
        FROM queries, m""",
    "registry_selection": f"""
        WITH {_REGISTRY}
        SELECT * EXCLUDE (given), 'default' AS selection FROM filled
        WHERE priority <= 2 AND given IS DISTINCT FROM 'prerequisite'
        UNION ALL SELECT * EXCLUDE (given), 'wide' FROM filled WHERE priority <= 3""",
    "registry_scan": f"""
        WITH {_REGISTRY} SELECT name, url, branch, category, priority FROM registry""",
    "tree_pieces": """
        SELECT source, lang, sum(octet_length(encode(text)) + 1)::BIGINT AS n_bytes,
               sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS n_lines, 0::BIGINT AS n_unreadable
        FROM documents GROUP BY ALL""",
    "tree_scan": """
        SELECT source, lang, sum(octet_length(encode(text)) + 1)::BIGINT AS n_bytes,
               sum(length(text) + 1)::BIGINT AS n_chars
        FROM documents GROUP BY ALL""",
    "branch_choice": f"""
        WITH b AS (
            SELECT DISTINCT source, CASE lang
                WHEN 'en' THEN CASE WHEN {_NUMBER} % 3 = 0 THEN 'trunk' ELSE 'main' END
                WHEN 'fr' THEN CASE WHEN {_NUMBER} % 2 = 0 THEN 'work' ELSE 'master' END
                ELSE lang END AS branch, lang = 'de' AS active
            FROM documents),
        r AS (SELECT source, branch, CASE WHEN branch = 'main' THEN 0 WHEN branch = 'master' THEN 1
                                          WHEN active THEN 2 END AS rank FROM b)
        SELECT source, arg_min(branch, (rank, branch)) AS branch FROM r
        WHERE rank IS NOT NULL GROUP BY source""",
    "file_classes": f"""
        WITH {_FILES}
        SELECT source, file_path, suffix, {_outcome('is_code')} AS code, {_outcome('is_docs')} AS docs,
               {_outcome('is_tests')} AS tests, {_outcome('is_tutorials')} AS tutorials
        FROM judged""",
    "file_documents": f"""
        WITH {_FILES}, {_REGISTRY}, good AS (
            SELECT *, source || '|' || file_path AS doc_key, sha256(content) AS raw_hash,
                   sha256({_strip('content')}) AS stripped_hash
            FROM judged WHERE {_strip('content')} <> '')
        SELECT 'code' AS collection, doc_key, raw_hash AS content_hash, file_path, NULL AS source,
               source AS repo, branch, tag AS language, NULL AS format, NULL AS doc_type,
               NULL AS category, NULL::INTEGER AS priority
        FROM good WHERE is_code
        UNION ALL SELECT 'docs', doc_key, stripped_hash, file_path, source, NULL, NULL, NULL, tag, NULL,
               NULL, NULL FROM good WHERE is_docs
        UNION ALL SELECT 'tests', doc_key, raw_hash, file_path, NULL, source, branch,
               coalesce(nullif(tag, ''), 'openfoam'), NULL,
               CASE WHEN suffix = '.py' THEN 'python_test' ELSE 'openfoam_config' END, NULL, NULL
        FROM good WHERE is_tests
        UNION ALL SELECT 'tutorials', doc_key, stripped_hash, file_path, 'repo_sources', source, NULL,
               NULL, NULL, NULL, f.category, f.priority
        FROM good JOIN filled f ON f.name = 'team/' || source
        WHERE is_tutorials AND f.priority <= 3""",
    "file_ingest_stats": f"""
        WITH {_FILES}, o AS (
            SELECT 'code' AS collection, source, {_outcome('is_code')} AS o FROM judged
            UNION ALL SELECT 'docs', source, {_outcome('is_docs')} FROM judged
            UNION ALL SELECT 'tests', source, {_outcome('is_tests')} FROM judged
            WHERE starts_with(file_path, 'tests/')
            UNION ALL SELECT 'tutorials', source, {_outcome('is_tutorials')} FROM judged)
        SELECT collection, source, count(*) FILTER (o = 'loaded') AS loaded,
               count(*) FILTER (o <> 'loaded') AS skipped, count(*) FILTER (o = 'type') AS skipped_type,
               count(*) FILTER (o = 'unreadable') AS skipped_unreadable,
               count(*) FILTER (o = 'blank') AS skipped_blank
        FROM o GROUP BY ALL""",
    "embed_documents": f"""
        WITH {_windows('documents', 'doc_id')}, {_vectors('chunks', 'doc_id, chunk_no')}
        SELECT doc_id, chunk_no, b::INTEGER AS bucket, round(e, 5) AS weight FROM vectors WHERE e <> 0""",
    "search_hits": f"""{_HITS}
        SELECT query_id, collection, rank, chunk_id, chunk_no, label, score, round(d, 6) AS distance
        FROM hits""",
    "search_rendered": f"""{_STATUS},
        texts AS (
            SELECT query_id, string_agg('**' || label || '** (score: ' || score || ')' || chr(10) || '```'
                       || chr(10) || {_strip('text')} || chr(10) || '```',
                       chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS rendered
            FROM hits GROUP BY query_id)
        SELECT query_id, coalesce(rendered, CASE status
                   WHEN 'unknown' THEN 'Unknown collection: ' || coalesce(collection, '')
                   WHEN 'missing' THEN upper(collection[1]) || collection[2:] || ' index missing.'
                   WHEN 'empty' THEN 'Index is available but empty. Run the matching index script first.'
                   ELSE 'No results found.' END) AS rendered
        FROM statuses LEFT JOIN texts USING (query_id)""",
    "search_status": f"{_STATUS} SELECT * FROM statuses",
    "search_coverage": f"""{_STATUS}
        SELECT collection, status, count(*) AS n_queries FROM statuses GROUP BY ALL""",
    "index_counts": f"""
        WITH {_DOCS}, {_windows('docs', 'collection')}, n AS (SELECT unnest([{_strings(KNOWN)}]) AS collection)
        SELECT n.collection, count(c.chunk_no) AS n_chunks
        FROM n LEFT JOIN chunks c USING (collection) GROUP BY ALL""",
    "index_health": f"""
        WITH {_DOCS}, {_windows('docs', 'collection')}, n AS (SELECT unnest([{_strings(KNOWN)}]) AS collection)
        SELECT collection, CASE WHEN collection <> 'archive' THEN count(c.chunk_no) END AS n_chunks,
               CASE WHEN collection <> 'archive' THEN 'hashed-tfidf-{EMBED_DIM}' END AS embed_model
        FROM n LEFT JOIN chunks c USING (collection) GROUP BY collection""",
    "refresh_delta": f"""
        WITH {_DOCS}
        SELECT coalesce(d.doc_key, e.doc_key) AS doc_key,
               CASE WHEN d.doc_key IS NULL THEN 'added' WHEN e.doc_key IS NULL THEN 'removed'
                    WHEN d.content_hash <> e.content_hash THEN 'changed' ELSE 'unchanged' END AS change
        FROM docs d FULL JOIN edited e ON d.doc_key = e.doc_key""",
    "refresh_applied": f"""
        WITH {_DOCS}, {_windows('edited', 'doc_key')}
        SELECT 'docs' AS collection, doc_key, chunk_no, sha256(text) AS text_hash,
               {EMBED_DIM} AS dims FROM chunks""",
    "refresh_streamed": f"""
        WITH {_DOCS},
        latest AS (
            SELECT doc_key, text FROM edited
            UNION ALL SELECT doc_key, text FROM docs WHERE doc_key NOT IN (SELECT doc_key FROM edited)),
        {_windows('latest', 'doc_key')}
        SELECT 'docs' AS collection, doc_key, chunk_no, sha256(text) AS text_hash,
               {EMBED_DIM} AS dims FROM chunks""",
    "rebuild_roundtrip": f"""
        WITH {_DOCS},
        latest AS (
            SELECT collection, doc_key, text FROM edited WHERE collection = 'docs'
            UNION ALL SELECT collection, doc_key, text FROM docs WHERE collection = 'code'),
        {_windows('latest', 'collection, doc_key')}
        SELECT collection, doc_key, chunk_no, sha256(text) AS text_hash FROM chunks""",
}

# A repeated append changes nothing.
for _same in ("search_after_append", "search_cells", "search_compacted", "search_reembedded"):
    ORACLES[_same] = ORACLES["search_hits"]
ORACLES["recrawled_turns"] = ORACLES["reachable_turns"]
