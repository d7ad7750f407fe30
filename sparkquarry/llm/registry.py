"""Queries of this subpackage over the project's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import encoding, knn, neardup, packing, pairs, scans, spans, splitting, tokenizer

Query = Callable[[SparkSession, str], DataFrame]


def p1_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks read with the wrong encoding and their texts as they were written."""
    return encoding.repair_encoding(table(spark, folder, "metadata"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks whose text holds a sequence that arose by a wrong encoding."""
    return p1_restored(spark, folder).select("chunk_id").distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with broken words, page furniture or misread letters."""
    return scans.Scans(table(spark, folder, "metadata")).noisy().select("chunk_id").distinct()


def p2_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with scan noise and their texts as continuous paragraphs."""
    return scans.Scans(table(spark, folder, "metadata")).restored()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Defective responses with their defect."""
    return pairs.defects(table(spark, folder, "query_response"), table(spark, folder, "documents"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks over the size limit; a chunk is found when the splitter cuts it."""
    return p4_pieces(spark, folder).filter("piece = 1").select("chunk_id").distinct()


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered pieces of the chunks over the size limit."""
    return splitting.split_texts(table(spark, folder, "metadata"))


def p4_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    """The texts over the size limit put together again from their pieces, and the length of the longest piece."""
    piece = F.struct("piece", "start", "text")
    rows = p4_pieces(spark, folder).groupBy("chunk_id", "source").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.max(F.length("text")).alias("longest"))
    # each piece as far as the next one begins
    parts = F.transform("p", lambda x, i: F.substring(x["text"], F.lit(1), F.coalesce(F.get("p", i + 1)["start"] - x["start"], F.lit(splitting.LIMIT)).cast("int")))
    return rows.select("chunk_id", F.array_join(parts, "").alias("text"), (F.col("longest") > splitting.LIMIT).alias("too_long"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks whose sets of three consecutive words are alike by 0.6 or more."""
    return neardup.NearDuplicates(table(spark, folder, "metadata")).pairs()


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The group of every chunk of at least 20 words and the number of chunks it is alike to."""
    return neardup.NearDuplicates(table(spark, folder, "metadata")).groups()


def p6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 most similar chunks of every chunk with a usable vector."""
    return knn.nearest(table(spark, folder, "chunk_vectors"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks among each other's most similar, with a similarity of 0.80 or more."""
    return knn.similar_pairs(p6_neighbours(spark, folder), 0.80)


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokenizer.encode_corpus(table(spark, folder, "documents"))


def p7_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text as its token ids give it back."""
    return tokenizer.decode_corpus(p7_ids(spark, folder))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Where every document lies in containers of 1,024 tokens."""
    return packing.pack(tokenizer.token_sizes(table(spark, folder, "documents")))


def p8_checked(spark: SparkSession, folder: str) -> DataFrame:
    """One row: documents placed, pieces that are not numbered from 1, documents whose tokens are not all placed, containers over the capacity."""
    docs = table(spark, folder, "documents")
    placed = p8_containers(spark, folder)
    own = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("piece").alias("last"), F.sum("tokens").alias("placed"))
    sizes = tokenizer.token_sizes(docs).filter("tokens > 0")
    rows = sizes.join(own, "doc_id", "full").select(F.coalesce(F.col("n") != F.col("last"), F.lit(True)).cast("long").alias("p"), F.coalesce(F.col("tokens") != F.col("placed"), F.lit(True)).cast("long").alias("t"))
    over = placed.groupBy("container_id").agg(F.sum("tokens").alias("used")).filter(F.col("used") > packing.CAPACITY).agg(F.count(F.lit(1)).alias("over_capacity"))
    return rows.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("p"), F.lit(0)).alias("wrong_pieces"), F.coalesce(F.sum("t"), F.lit(0)).alias("wrong_tokens")).crossJoin(over)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents that have 200 consecutive characters in common."""
    return spans.SharedSpans(table(spark, folder, "documents")).pairs()


def p9_shared(spark: SparkSession, folder: str) -> DataFrame:
    """For every document the number of its characters in shared passages, and its length."""
    docs = table(spark, folder, "documents")
    shared = spans.SharedSpans(docs).coverage()
    sizes = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    return sizes.join(shared, "doc_id", "left").select("doc_id", "chars", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("shared_chars", "shared_spans")))


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in (p1_found, p1_restored, p2_found, p2_restored, p3_found, p4_found, p4_pieces, p4_rejoined, p5_found, p5_groups, p6_found, p6_neighbours, p7_ids, p7_decoded, p8_containers, p8_checked, p9_found, p9_shared)}


#: White space that str.strip() removes, as a class.
_BLANK = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}\x{0B}]+"
_SPANS = """
    docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 200),
    starts AS (SELECT doc_id, s, md5(substring(text, s + 1, 200)) AS span FROM (SELECT doc_id, text, unnest(range(length(text) - 199)) AS s FROM docs)),
    shared AS (SELECT span FROM starts GROUP BY span HAVING count(DISTINCT doc_id) > 1)
"""


_ALIKE = r"""
    texts AS (SELECT DISTINCT chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM metadata WHERE text IS NOT NULL),
    grams AS (SELECT DISTINCT chunk_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
              FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 1)) AS i FROM texts WHERE len(w) >= 20)),
    sizes AS (SELECT chunk_id, count(*) AS n FROM grams GROUP BY 1),
    both_have AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY 1, 2),
    alike AS (SELECT a, b FROM both_have JOIN sizes x ON x.chunk_id = a JOIN sizes y ON y.chunk_id = b WHERE 10 * c >= 6 * (x.n + y.n - c))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": f"SELECT DISTINCT chunk_id FROM metadata WHERE length(regexp_replace(text, '^{_BLANK}|{_BLANK}$', '', 'g')) > 2000",
        "p4_rejoined": f"""
            SELECT chunk_id, text, false AS too_long
            FROM (SELECT DISTINCT chunk_id, source, regexp_replace(text, '^{_BLANK}|{_BLANK}$', '', 'g') AS text FROM metadata) WHERE length(text) > 2000
        """,
        "p5_found": f"WITH {_ALIKE} SELECT a AS chunk_id_a, b AS chunk_id_b FROM alike",
        "p5_groups": f"""
            WITH RECURSIVE {_ALIKE}, both_ways AS (SELECT a, b FROM alike UNION ALL SELECT b, a FROM alike),
            reach AS (SELECT chunk_id, chunk_id AS other FROM sizes UNION SELECT reach.chunk_id, b FROM reach JOIN both_ways ON a = other),
            links AS (SELECT a, count(*) AS n FROM both_ways GROUP BY 1)
            SELECT chunk_id, min(other) AS group_id, any_value(coalesce(n, 0)) AS links FROM reach LEFT JOIN links ON a = chunk_id GROUP BY 1
        """,
        "p6_found": """
            WITH v AS (SELECT chunk_id, any_value(e) AS e FROM (SELECT chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM chunk_vectors WHERE len(embedding) = 64)
                       WHERE list_inner_product(e, e) > 0 GROUP BY chunk_id),
            near AS (SELECT a.chunk_id AS a, b.chunk_id AS b, round(list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)), 6) AS s
                     FROM v a JOIN v b ON a.chunk_id <> b.chunk_id),
            best AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM near)
            SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM best WHERE r <= 10 AND s >= 0.8
        """,
        "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p8_checked": "SELECT count(*) AS documents, 0::BIGINT AS wrong_pieces, 0::BIGINT AS wrong_tokens, 0::BIGINT AS over_capacity FROM documents WHERE length(text) > 0",
        "p9_found": f"""
            WITH {_SPANS}, members AS (SELECT DISTINCT span, doc_id FROM starts JOIN shared USING (span))
            SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM members a JOIN members b ON a.span = b.span AND a.doc_id < b.doc_id
        """,
        "p9_shared": f"""
            WITH {_SPANS}, own AS (SELECT doc_id, s, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS after, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before
                                   FROM starts JOIN shared USING (span)),
            sums AS (SELECT doc_id, sum(least(200, coalesce(after - s, 200)))::BIGINT AS shared_chars, sum(CASE WHEN before IS NULL OR s > before + 200 THEN 1 ELSE 0 END)::BIGINT AS shared_spans
                     FROM own GROUP BY 1)
            SELECT doc_id, CAST(coalesce(length(text), 0) AS INT) AS chars, coalesce(shared_chars, 0) AS shared_chars, coalesce(shared_spans, 0) AS shared_spans
            FROM documents LEFT JOIN sums USING (doc_id)
        """,
    }
