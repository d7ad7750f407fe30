"""The named queries as SQL for an independent engine."""

from __future__ import annotations

from ..config import Settings
from ..functions.text import INTENTS, OTHER_INTENT, QUERY_PREFIX, STOPWORDS, VARIANTS
from ..functions.viewpoint import default_rules
from ..operators.prompting import BETWEEN, Templates

S = Settings()
SPACE = r"[ \t\n\v\f\r]+"


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}|{SPACE}$', '', 'g')"


def tokens(c: str) -> str:
    return f"list_filter(string_split_regex(lower({c}), '{SPACE}'), lambda t: t <> '')"


def variants(t: str) -> str:
    cases = " ".join(f"WHEN {t} = {text(w)} THEN [{', '.join(map(text, v))}]" for w, v in VARIANTS.items())
    return f"CASE {cases} ELSE [{t}] END"


def terms(q: str) -> str:
    stop = ", ".join(map(text, STOPWORDS))
    kept = f"list_filter(regexp_extract_all(lower({q}), '[a-z0-9'']+'), lambda t: length(t) > 2 AND NOT list_contains([{stop}], t))"
    return f"list_sort(list_distinct(flatten(list_transform({kept}, lambda t: {variants('t')}))))"


CHUNKS = """
chunks AS (
  SELECT chunk_id, coalesce(r.text, '') AS text, coalesce(r.source, 'unknown') AS source, coalesce(r.chapter, 'unknown') AS chapter, coalesce(r.file_type, 'pdf') AS file_type
  FROM (SELECT coalesce(chunk_id, pos) AS chunk_id, arg_max({'text': text, 'source': source, 'chapter': chapter, 'file_type': file_type}, pos) AS r
        FROM metadata GROUP BY 1) WHERE chunk_id IS NOT NULL)
"""
VECTORS = """
vectors AS (
  SELECT chunk_id, any_value(list_transform(v, lambda x: x / norm)) AS vec
  FROM (SELECT chunk_id, v, sqrt(list_inner_product(v, v)) AS norm FROM (SELECT chunk_id, CAST(embedding AS DOUBLE[]) AS v FROM chunk_vectors) WHERE len(v) = 64)
  WHERE norm > 0 GROUP BY chunk_id)
"""
REQUESTS = f"""
requests AS (
  SELECT request_id AS query_id, query, coalesce(nullif(top_k, 0), {S.top_k}) AS top_k, coalesce(nullif(candidate_pool, 0), {S.candidate_pool}) AS pool,
         coalesce(nullif(stitching_window, 0), {S.stitching_window}) AS win, nullif(book_filter, '') AS book_filter,
         CASE WHEN len(source_filter) > 0 THEN source_filter END AS source_filter, {terms('query')} AS terms
  FROM query_request WHERE {strip('query')} <> '')
"""
ASKED = "asked AS (SELECT * FROM requests WHERE query_id % 20 = 0)"
DENSE = """
dense AS (
  SELECT query_id, chunk_id, score, rank FROM (
    SELECT a.query_id, v.chunk_id, list_inner_product(q.vec, v.vec) AS score, a.pool,
           row_number() OVER (PARTITION BY a.query_id ORDER BY round(list_inner_product(q.vec, v.vec), 9) DESC, v.chunk_id) - 1 AS rank
    FROM asked a JOIN vectors q ON q.chunk_id = a.query_id CROSS JOIN vectors v)
  WHERE rank < pool)
"""
STATS = f"""
words AS (SELECT chunk_id, {tokens('text')} AS tokens FROM chunks),
corpus0 AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM words),
terms0 AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM words) GROUP BY term),
idfs AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf_raw FROM terms0, corpus0),
corpus AS (SELECT n, avgdl, (SELECT avg(idf_raw) FROM idfs) AS mean_idf FROM corpus0)
"""
BM25 = f"""
asked_terms AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({tokens('query')}) AS term FROM asked) GROUP BY 1, 2),
weights AS (SELECT query_id, term, times * CASE WHEN idf_raw >= 0 THEN idf_raw ELSE {S.bm25_epsilon} * mean_idf END AS w FROM asked_terms JOIN idfs USING (term), corpus),
postings AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(tokens) AS term FROM words) WHERE term IN (SELECT term FROM weights) GROUP BY 1, 2),
matched AS (
  SELECT query_id, p.chunk_id, sum(w * tf * {S.bm25_k1 + 1} / (tf + {S.bm25_k1} * (1 - {S.bm25_b} + {S.bm25_b} * len(tokens) / avgdl))) AS score
  FROM weights JOIN postings p USING (term) JOIN words USING (chunk_id), corpus GROUP BY 1, 2),
bm25 AS (
  SELECT query_id, chunk_id, score, rank FROM (
    SELECT a.query_id, c.chunk_id, coalesce(m.score, 0.0) AS score, a.pool,
           row_number() OVER (PARTITION BY a.query_id ORDER BY round(coalesce(m.score, 0.0), 9) DESC, c.chunk_id DESC) - 1 AS rank
    FROM asked a CROSS JOIN chunks c LEFT JOIN matched m ON m.query_id = a.query_id AND m.chunk_id = c.chunk_id)
  WHERE rank < pool)
"""
MERGED = f"""
hits AS (SELECT *, true AS f, md5(text) AS key FROM dense JOIN chunks USING (chunk_id) UNION ALL BY NAME SELECT *, false AS f, md5(text) AS key FROM bm25 JOIN chunks USING (chunk_id)),
fused AS (
  SELECT query_id, key, sum(1.0 / ({S.rrf_k} + rank)) AS rrf_score, min(rank) FILTER (f) AS fmin, min(rank) FILTER (NOT f) AS bmin,
         arg_max(chunk_id, rank) FILTER (f) AS fid, max(rank) FILTER (f) AS frank, arg_min(chunk_id, rank) FILTER (NOT f) AS bid,
         arg_max(score, rank) FILTER (f) AS fscore
  FROM hits GROUP BY 1, 2),
merged AS (
  SELECT query_id, merged_rank, coalesce(fid, bid) AS chunk_id, rrf_score, frank AS dense_rank, CASE WHEN fid IS NULL THEN bmin END AS bm25_rank, fscore AS dense_score FROM (
    SELECT fused.*, pool, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, coalesce(fmin, 1000000 + bmin)) - 1 AS merged_rank
    FROM fused JOIN asked USING (query_id)) WHERE merged_rank < pool)
"""
FILTERED = """
filtered AS (
  SELECT m.*, c.text, c.source, c.chapter, c.file_type, a.terms, a.top_k, a.win FROM merged m JOIN chunks c USING (chunk_id) JOIN asked a USING (query_id)
  WHERE (book_filter IS NULL OR contains(lower(c.source), lower(book_filter))) AND (source_filter IS NULL OR list_contains(source_filter, c.source)))
"""
GROUNDED = f"""
grounded AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, round(rrf_score, 12) DESC, merged_rank) - 1 AS grounded_rank FROM (
    SELECT *, CAST(len(overlap_terms) AS DOUBLE) AS overlap FROM (
      SELECT *, list_filter(terms, lambda t: len(list_filter({variants('t')}, lambda v: contains(lower(concat(source, ' ', chapter, ' ', text)), v))) > 0) AS overlap_terms FROM filtered)))
"""
STITCHED = f"""
top AS (SELECT * FROM grounded WHERE grounded_rank < top_k),
cover AS (SELECT t.query_id, t.grounded_rank, c.chunk_id AS nid, {strip('c.text')} AS part, min(t.grounded_rank) OVER (PARTITION BY t.query_id, c.chunk_id) AS owner
          FROM top t JOIN chunks c ON c.chunk_id BETWEEN greatest(0, t.chunk_id - t.win) AND t.chunk_id + t.win),
owned AS (SELECT query_id, grounded_rank, string_agg(part, chr(10) || chr(10) ORDER BY nid) AS stitched, 'chunk_id ' || min(nid) || '-' || max(nid) AS stitch_range
          FROM cover WHERE owner = grounded_rank GROUP BY 1, 2),
results AS (SELECT t.query_id, t.grounded_rank AS rank, t.chunk_id, source, chapter, file_type, rrf_score, dense_score, overlap, coalesce(o.stitch_range, '') AS stitch_range, coalesce(o.stitched, t.text) AS text
            FROM top t LEFT JOIN owned o ON o.query_id = t.query_id AND o.grounded_rank = t.grounded_rank)
"""
TO_DENSE = (CHUNKS, VECTORS, REQUESTS, ASKED, DENSE)
TO_MERGED = (*TO_DENSE, STATS, BM25, MERGED)
TO_RESULTS = (*TO_MERGED, FILTERED, GROUNDED, STITCHED)


def query(ctes: tuple[str, ...], select: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + select


def case(value: str, rules, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {cond} THEN {text(label)}" for label, cond in rules) + f" ELSE {text(other)} END"


def intent_sql(q: str) -> str:
    return case(q, ((n, " OR ".join(f"contains(lower({q}), {text(p)})" for p in ps)) for n, ps in INTENTS), OTHER_INTENT)


def viewpoint_sql(source: str, body: str) -> str:
    rules = []
    for label, phrases, in_source, in_text in default_rules():
        conds = [f"contains(lower({c}), {text(p)})" for p in phrases for c, on in ((source, in_source), (body, in_text)) if on]
        rules.append((label, " OR ".join(conds)))
    return case(source, rules, "")


def html_sql(c: str) -> str:
    out = rf"regexp_replace(regexp_replace({c}, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g'), '(?s)<[^>]*>', '', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = f"replace({out}, {text(entity)}, {text(char)})"
    return out


def prompt_sql(mode: str) -> str:
    t = Templates()
    if mode == "explorer":
        head = "'[' || source || ' / ' || chapter || ']'"
    else:
        head = (
            "'[Passage ' || (rank + 1) || ' - ' || source || CASE WHEN chapter NOT IN ('', 'unknown') THEN ', ' || chapter ELSE '' END"
            " || CASE WHEN stitch_range <> '' THEN ' (' || stitch_range || ')' ELSE '' END || CASE WHEN file_type <> '' THEN ' [' || upper(file_type) || ']' ELSE '' END || ']'"
        )
        if mode == "narrate":
            hint = viewpoint_sql("source", strip("text"))
            head += f" || CASE WHEN {hint} <> '' THEN chr(10) || '[Viewpoint: ' || {hint} || ']' ELSE '' END"
    between = text(BETWEEN)
    empty = t.empty_explorer if mode == "explorer" else t.empty_context
    context = f"coalesce(context, {text(empty)})"
    contexts = f"contexts AS (SELECT query_id, string_agg({head} || chr(10) || {strip('text')}, {between} ORDER BY rank) AS context FROM results GROUP BY query_id)"
    system = " || ".join((text(getattr(t, f"{mode}_system").split("{context}")[0]), context, text(getattr(t, f"{mode}_system").split("{context}")[1])))
    user = " || ".join((text(getattr(t, f"{mode}_user").split("{query}")[0]), "query", text(getattr(t, f"{mode}_user").split("{query}")[1])))
    return query((*TO_RESULTS, contexts), f"SELECT query_id, {system} AS system_prompt, {user} AS user_message FROM asked LEFT JOIN contexts USING (query_id)")


LAST = f"""
turns AS (SELECT DISTINCT coalesce(session_id, 'default') AS session_id, turn, query, response FROM query_response),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC, query DESC NULLS LAST, response DESC NULLS LAST) AS back FROM turns) WHERE back <= {S.memory_turns})
"""
FAILURES = """
failures AS (SELECT file_name, r.error AS error, failed_at FROM (
  SELECT file_name, max(failed_at) AS failed_at, arg_max({'error': error}, {'a': failed_at, 'b': coalesce(error, '')}) AS r FROM failure_report GROUP BY file_name))
"""
BUILDS = """
builds AS (SELECT strftime(coalesce(try_strptime(build_date, '%Y-%m-%dT%H:%M:%S'), try_strptime(build_date, '%d/%m/%Y %H:%M')), '%Y-%m-%d %H:%M:%S') AS built_at,
           total_chunks, total_files, lower(model) AS model, coalesce(lower(trim(status)), 'unknown') AS status FROM manifest)
"""
#: One sentence a step: state is (sentence, first of the chunk, its words, end of a closed chunk).
FOLD = f"""
sents0 AS (SELECT doc_id, list_filter(string_split(regexp_replace({strip('text')}, '([.!?]){SPACE}', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS sents
           FROM documents WHERE {strip('text')} <> ''),
sents AS (SELECT doc_id, sents, list_transform(sents, lambda s: len({tokens('s')})) AS sizes FROM sents0),
steps AS (
  SELECT doc_id, 0 AS i, 1 AS lo, 0 AS words, 0 AS part, CAST(NULL AS VARCHAR) AS chunk, len(sents) AS n FROM sents
  UNION ALL
  SELECT s.doc_id, i + 1, CASE WHEN words + sizes[i + 1] >= {S.target_words} THEN greatest(1, i + 2 - {S.overlap_sentences}) ELSE lo END,
         CASE WHEN words + sizes[i + 1] >= {S.target_words} THEN CAST(coalesce(list_sum(sizes[greatest(1, i + 2 - {S.overlap_sentences}):i + 1]), 0) AS INT) ELSE CAST(words + sizes[i + 1] AS INT) END,
         CASE WHEN chunk IS NOT NULL THEN part + 1 ELSE part END,
         CASE WHEN words + sizes[i + 1] >= {S.target_words} THEN array_to_string(sents[lo:i + 1], ' ') END, n
  FROM steps JOIN sents s USING (doc_id) WHERE i < n),
parts AS (SELECT doc_id, part, chunk AS text FROM steps WHERE chunk IS NOT NULL
          UNION ALL SELECT s.doc_id, CASE WHEN chunk IS NOT NULL THEN part + 1 ELSE part END, array_to_string(sents[lo:], ' ') FROM steps t JOIN sents s USING (doc_id) WHERE i = n AND lo <= n AND n > 0)
"""


def oracle_sql() -> dict[str, str]:
    hits = "SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM "
    return {
        "dense_topk": query(TO_DENSE, hits + "dense"),
        "bm25_topk": query((CHUNKS, REQUESTS, ASKED, STATS, BM25), hits + "bm25"),
        "bm25_terms": query((CHUNKS, STATS), "SELECT term, df, round(idf_raw, 6) AS idf_raw FROM idfs"),
        "bm25_corpus": query((CHUNKS, STATS), "SELECT n, round(avgdl, 6) AS avgdl, round(mean_idf, 6) AS mean_idf FROM corpus"),
        "rrf_fusion": query(TO_MERGED, "SELECT query_id, merged_rank, chunk_id, round(rrf_score, 9) AS rrf_score, coalesce(dense_rank, -1) AS dense_rank, coalesce(bm25_rank, -1) AS bm25_rank FROM merged"),
        "filtered_hits": query((*TO_MERGED, FILTERED), "SELECT query_id, merged_rank, chunk_id, source FROM filtered"),
        "grounding": query((*TO_MERGED, FILTERED, GROUNDED), "SELECT query_id, grounded_rank, chunk_id, overlap, array_to_string(overlap_terms, ' ') AS terms FROM grounded"),
        "search_hybrid": query(TO_RESULTS, "SELECT query_id, rank, chunk_id, source, chapter, file_type, round(rrf_score, 9) AS rrf_score, overlap, stitch_range, text FROM results"),
        "source_payload": query(TO_RESULTS, "SELECT query_id, rank, source, chapter, stitch_range, round(coalesce(nullif(overlap, 0), nullif(rrf_score, 0), nullif(dense_score, 0), 0.0), 4) AS score FROM results"),
        "reranked": query(
            TO_RESULTS,
            "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, overlap DESC, rank) - 1 AS rank, chunk_id, coalesce(score, 0.0) AS rerank_score"
            " FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY query_id) > 1 THEN CAST(-length(text) AS DOUBLE) END AS score FROM results)",
        ),
        "inspected": query(
            TO_RESULTS,
            "SELECT query_id, 'dense' AS stage, rank, chunk_id, '' AS stitch_range FROM dense WHERE rank < 5 UNION ALL SELECT query_id, 'bm25', rank, chunk_id, '' FROM bm25 WHERE rank < 5"
            " UNION ALL SELECT query_id, 'grounded', grounded_rank, chunk_id, '' FROM top UNION ALL SELECT query_id, 'stitched', rank, chunk_id, stitch_range FROM results",
        ),
        "sources_json": query(
            TO_RESULTS,
            "SELECT query_id, CAST(to_json(list({'source': source, 'chapter': chapter, 'stitch_range': stitch_range, 'score': round(coalesce(nullif(overlap, 0), nullif(rrf_score, 0), nullif(dense_score, 0), 0.0), 4)} ORDER BY rank)) AS VARCHAR) AS sources FROM results GROUP BY query_id",
        ),
        "html_text": f"SELECT response_id, {html_sql("coalesce(response, '')")} AS text FROM query_response",
        "embedded": "SELECT request_id, array_to_string(list_transform(v, lambda x: CAST(round(CAST(CAST(x / greatest(sqrt(list_inner_product(v, v)), 1e-30) AS FLOAT) AS DOUBLE), 4) AS VARCHAR)), ' ') AS vector"
        " FROM (SELECT request_id, [CAST(length(q) - length(replace(q, c, '')) AS DOUBLE) FOR c IN ['a', 'e', 'i', 'o', 'u']] AS v FROM (SELECT request_id, coalesce(query, '') AS q FROM query_request))",
        "requests_normalised": query((REQUESTS,), "SELECT query_id, query, top_k, pool, win, coalesce(book_filter, '') AS book_filter, CAST(coalesce(len(source_filter), 0) AS INT) AS n_sources FROM requests"),
        "query_terms_all": f"SELECT request_id, array_to_string({terms("coalesce(query, '')")}, ' ') AS terms FROM query_request",
        "enriched": f"SELECT request_id, {text(QUERY_PREFIX)} || coalesce(query, '') AS text FROM query_request",
        "intents": f"SELECT request_id, {intent_sql("coalesce(query, '')")} AS intent FROM query_request",
        "viewpoints": query((CHUNKS,), f"SELECT chunk_id, {viewpoint_sql('source', 'text')} AS viewpoint FROM chunks"),
        "session_last_turns": query((LAST,), "SELECT session_id, turn, coalesce(query, '') AS query, coalesce(response, '') AS response, back FROM last"),
        "session_memory": query(
            (LAST,),
            f"SELECT session_id, {text(Templates().memory_intro)} || chr(10) || string_agg({text(Templates().memory_user)} || coalesce(query, '') || chr(10) || {text(Templates().memory_answer)} || substring(coalesce(response, ''), 1, {S.memory_chars}) || '...', chr(10) ORDER BY back DESC) AS memory FROM last GROUP BY session_id",
        ),
        "sources_list": query((CHUNKS,), "SELECT DISTINCT source FROM chunks"),
        "source_chunks": query((CHUNKS,), "SELECT chunk_id, source, text FROM chunks WHERE contains(lower(source), 'of the') ORDER BY chunk_id LIMIT 100"),
        "source_distribution": query((CHUNKS,), "SELECT source AS value, count(*) AS n FROM chunks GROUP BY 1 ORDER BY n DESC, value LIMIT 15"),
        "file_type_distribution": query((CHUNKS,), "SELECT file_type AS value, count(*) AS n FROM chunks GROUP BY 1"),
        "id_gaps": "SELECT coalesce(sum(CASE WHEN id - b <> 1 THEN 1 ELSE 0 END), 0)::BIGINT AS gaps FROM (SELECT id, lag(id) OVER (ORDER BY pos) AS b FROM (SELECT pos, coalesce(chunk_id, pos) AS id FROM metadata))",
        "vector_coverage": query(
            (CHUNKS, VECTORS),
            "SELECT (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM vectors) AS vectors, (SELECT count(*) FROM chunks JOIN vectors USING (chunk_id)) AS with_vector, abs((SELECT count(*) FROM chunks) - (SELECT count(*) FROM vectors)) AS gap",
        ),
        "vector_dimensions": "SELECT CAST(coalesce(len(embedding), -1) AS INT) AS dim, count(*) AS n FROM chunk_vectors GROUP BY 1",
        "chunk_previews": query((CHUNKS,), "SELECT chunk_id, source, chapter, replace(substring(text, 1, 120), chr(10), ' ') AS preview FROM chunks ORDER BY chunk_id LIMIT 3"),
        "failures_merged": query((FAILURES,), "SELECT file_name, coalesce(error, '') AS error, strftime(failed_at, '%Y-%m-%d %H:%M:%S') AS failed_at FROM failures"),
        "failure_reasons": query((FAILURES,), "SELECT coalesce(nullif(regexp_replace(lower(trim(error)), '\\.+$', ''), ''), 'unknown') AS reason, count(*) AS n FROM failures GROUP BY 1"),
        "manifest": query((CHUNKS,), "SELECT (SELECT count(*) FROM chunks) AS total_chunks, (SELECT count(DISTINCT file_name) FROM processed_files) AS total_files, 'lore-encoder-m3' AS model, 'healthy' AS status"),
        "builds": query((BUILDS,), "SELECT * FROM builds"),
        "index_info": query(
            (CHUNKS, VECTORS, BUILDS),
            "SELECT (SELECT count(*) FROM vectors) AS index_vectors, (SELECT CAST(max(len(vec)) AS INT) FROM vectors) AS index_dim, (SELECT count(DISTINCT source) FROM chunks) AS cached_sources,"
            f" built_at AS last_build, total_chunks, total_files, model, status, {S.top_k} AS top_k, {S.candidate_pool} AS candidate_pool, {S.stitching_window} AS stitching_window, {S.rrf_k} AS rrf_k, {str(S.rerank).lower()} AS rerank"
            " FROM (SELECT * FROM builds ORDER BY built_at DESC NULLS LAST, total_chunks DESC, total_files DESC, model DESC, status DESC LIMIT 1)",
        ),
        "files_unprocessed": "SELECT DISTINCT file_name FROM failure_report WHERE file_name NOT IN (SELECT file_name FROM processed_files)",
        "duplicate_texts": query((CHUNKS,), "SELECT md5(text) AS key, count(*) AS n, min(chunk_id) AS first_chunk FROM chunks GROUP BY 1 HAVING count(*) > 1"),
        "chunk_documents": "WITH RECURSIVE " + FOLD + " SELECT doc_id, part, text FROM parts",
        "chunk_numbers": "WITH RECURSIVE " + FOLD + " SELECT row_number() OVER (ORDER BY doc_id, part) - 1 AS chunk_id, doc_id, part FROM parts",
        "documents_rejected": f"SELECT doc_id, 'Empty content.' AS error FROM documents WHERE text IS NULL OR {strip('text')} = ''",
    } | {f"prompt_{m}": prompt_sql(m) for m in ("standard", "narrate", "explorer")}
