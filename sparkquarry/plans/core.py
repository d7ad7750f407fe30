"""Named queries of the retrieval engine over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import enrich, html_to_text, intent, query_terms
from ..functions.viewpoint import viewpoint
from ..operators import catalog, chunking, prompting
from ..operators.embedding import embed
from ..operators.hybrid import Retrieval
from ..operators.requests import normalise
from ..operators.scan import bm25_index, bm25_stats
from ..runtime import materialize, table
from ..schema import chunks as chunk_table
from ..schema import vectors as vector_table

SETTINGS = Settings()
#: Every so-many-th request is a query of the batch searches, against all chunks.
STRIDE = 20


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk_table(table(spark, d, "metadata"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return vector_table(table(spark, d, "chunk_vectors"), dim=64)


def requests(spark: SparkSession, d: str) -> DataFrame:
    """The query set: requests whose id is divisible by the stride."""
    rows = table(spark, d, "query_request").filter(F.col("request_id") % STRIDE == 0)
    return rows.select(F.col("request_id").alias("query_id"), "query", "top_k", "candidate_pool", "stitching_window", "book_filter", "source_filter")


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Query by example, as no encoder is at hand: request n asks with the vector of chunk n."""
    return vectors(spark, d).filter(F.col("chunk_id") % STRIDE == 0).select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("qvec"))


def retrieval(spark: SparkSession, d: str) -> Retrieval:
    return Retrieval(requests(spark, d), query_vectors(spark, d), chunks(spark, d), vectors(spark, d), SETTINGS)


def _hits(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 6).alias("score"))


def dense_topk(spark, d):
    return _hits(retrieval(spark, d).dense)


def bm25_topk(spark, d):
    return _hits(retrieval(spark, d).bm25)


def _index(spark, d):
    return materialize(bm25_index(chunks(spark, d)), "postings")


def bm25_terms(spark, d):
    return bm25_stats(_index(spark, d))[0].select("term", "df", F.round("idf_raw", 6).alias("idf_raw"))


def bm25_corpus(spark, d):
    return bm25_stats(_index(spark, d))[1].select("n", F.round("avgdl", 6).alias("avgdl"), F.round("mean_idf", 6).alias("mean_idf"))


def rrf_fusion(spark, d):
    r = retrieval(spark, d).merged
    return r.select("query_id", F.col("merged_rank").cast("long").alias("merged_rank"), "chunk_id", F.round("rrf_score", 9).alias("rrf_score"), *(F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c) for c in ("dense_rank", "bm25_rank")))


def filtered_hits(spark, d):
    return retrieval(spark, d).filtered.select("query_id", F.col("merged_rank").cast("long").alias("merged_rank"), "chunk_id", "source")


def grounding(spark, d):
    r = retrieval(spark, d).grounded
    return r.select("query_id", F.col("grounded_rank").cast("long").alias("grounded_rank"), "chunk_id", "overlap", F.array_join("overlap_terms", " ").alias("terms"))


def _results(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "source", "chapter", "file_type", F.round("rrf_score", 9).alias("rrf_score"), "overlap", F.coalesce("stitch_range", F.lit("")).alias("stitch_range"), "text")


def search_hybrid(spark, d):
    return _results(retrieval(spark, d).search())


def reranked(spark, d):
    """The search with a scorer that likes short texts: the seam of a cross-encoder, with scores that SQL can tell."""
    r = retrieval(spark, d)
    r.scorer = lambda queries, texts: -texts.str.len().astype("float64")
    return r.search().select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.coalesce("rerank_score", F.lit(0.0)).alias("rerank_score"))


def inspected(spark, d):
    """The stages of every search as one table: five hits of each list, then the grounded and stitched hits."""
    stages = retrieval(spark, d).inspect()
    rows = lambda name, rank, span: stages[name].select("query_id", F.lit(name).alias("stage"), F.col(rank).cast("long").alias("rank"), "chunk_id", span.alias("stitch_range"))
    none = F.lit("")
    return rows("dense", "rank", none).unionByName(rows("bm25", "rank", none)).unionByName(rows("grounded", "grounded_rank", none)).unionByName(rows("stitched", "grounded_rank", F.coalesce("stitch_range", none)))


def sources_json(spark, d):
    return prompting.sources_json(prompting.source_payload(retrieval(spark, d).search()))


def html_text(spark, d):
    """The answers without markup."""
    return table(spark, d, "query_response").select("response_id", html_to_text(F.coalesce("response", F.lit(""))).alias("text"))


def embedded(spark, d):
    """Vectors of all questions by a small encoder (counts of vowels), normalised: the seam of a real one."""
    rows = embed(table(spark, d, "query_request").select("request_id", "query"), vowels, "query")
    return rows.select("request_id", F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double"), 4).cast("string")), " ").alias("vector"))


def vowels():
    return lambda texts: np.array([[t.count(c) for c in "aeiou"] for t in texts], np.float64)


def requests_normalised(spark, d):
    rows = table(spark, d, "query_request").withColumnRenamed("request_id", "query_id")
    return normalise(rows, SETTINGS).select("query_id", "query", "top_k", "pool", "win", F.coalesce("book_filter", F.lit("")).alias("book_filter"), F.coalesce(F.size("source_filter"), F.lit(0)).alias("n_sources"))


def query_terms_all(spark, d):
    return table(spark, d, "query_request").select("request_id", F.array_join(query_terms(F.coalesce("query", F.lit(""))), " ").alias("terms"))


def enriched(spark, d):
    """The questions as an encoder wants them."""
    return table(spark, d, "query_request").select("request_id", enrich(F.coalesce("query", F.lit(""))).alias("text"))


def intents(spark, d):
    return table(spark, d, "query_request").select("request_id", intent(F.coalesce("query", F.lit(""))).alias("intent"))


def viewpoints(spark, d):
    return chunks(spark, d).select("chunk_id", viewpoint(F.col("source"), F.col("text")).alias("viewpoint"))


def _prompt(mode: str):
    def query(spark, d):
        r = retrieval(spark, d)
        return prompting.prompts(r.requests, r.search(), mode)

    return query


def source_payload(spark, d):
    return prompting.source_payload(retrieval(spark, d).search()).withColumn("rank", F.col("rank").cast("long"))


def session_last_turns(spark, d):
    return prompting.last_turns(table(spark, d, "query_response"), SETTINGS).select("session_id", "turn", F.coalesce("query", F.lit("")).alias("query"), F.coalesce("response", F.lit("")).alias("response"), F.col("back").cast("long").alias("back"))


def session_memory(spark, d):
    return prompting.format_memory(prompting.last_turns(table(spark, d, "query_response"), SETTINGS), SETTINGS)


def sources_list(spark, d):
    return catalog.list_sources(chunks(spark, d))


def source_chunks(spark, d):
    return catalog.source_chunks(chunks(spark, d), "of the", 100).select("chunk_id", "source", "text")


def source_distribution(spark, d):
    return catalog.distribution(chunks(spark, d), "source", 15)


def file_type_distribution(spark, d):
    return catalog.distribution(chunks(spark, d), "file_type")


def id_gaps(spark, d):
    return catalog.id_gaps(table(spark, d, "metadata"))


def vector_coverage(spark, d):
    return catalog.vector_coverage(chunks(spark, d), vectors(spark, d))


def vector_dimensions(spark, d):
    return catalog.vector_dimensions(table(spark, d, "chunk_vectors")).select(F.coalesce("dim", F.lit(-1)).alias("dim"), "n")


def chunk_previews(spark, d):
    return catalog.previews(chunks(spark, d))


def failures_merged(spark, d):
    return catalog.merge_failures(table(spark, d, "failure_report")).select("file_name", F.coalesce("error", F.lit("")).alias("error"), F.date_format("failed_at", "yyyy-MM-dd HH:mm:ss").alias("failed_at"))


def failure_reasons(spark, d):
    return catalog.failure_reasons(table(spark, d, "failure_report"))


def manifest(spark, d):
    return catalog.manifest(chunks(spark, d), table(spark, d, "processed_files"), "lore-encoder-m3")


def builds(spark, d):
    return catalog.builds(table(spark, d, "manifest"))


def index_info(spark, d):
    return catalog.info(chunks(spark, d), vectors(spark, d), table(spark, d, "manifest"), SETTINGS)


def files_unprocessed(spark, d):
    """Files that failed and that no build took in: the work list of a retry."""
    return catalog.unprocessed(table(spark, d, "failure_report").select("file_name").distinct(), table(spark, d, "processed_files"))


def duplicate_texts(spark, d):
    return catalog.duplicate_texts(chunks(spark, d))


def chunk_documents(spark, d):
    return chunking.chunk_documents(table(spark, d, "documents"), SETTINGS).select("doc_id", "part", "text")


def chunk_numbers(spark, d):
    return chunking.number(chunking.chunk_documents(table(spark, d, "documents"), SETTINGS)).select("chunk_id", "doc_id", "part")


def documents_rejected(spark, d):
    return chunking.rejected(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        search_hybrid, reranked, inspected, sources_json, html_text, embedded, dense_topk, bm25_topk, bm25_terms, bm25_corpus, rrf_fusion, filtered_hits, grounding, requests_normalised, query_terms_all, enriched, intents, viewpoints,
        source_payload, session_last_turns, session_memory, sources_list, source_chunks, source_distribution, file_type_distribution, id_gaps, vector_coverage, vector_dimensions,
        chunk_previews, failures_merged, failure_reasons, manifest, builds, index_info, files_unprocessed, duplicate_texts, chunk_documents, chunk_numbers, documents_rejected,
    )
    return {q.__name__: q for q in named} | {f"prompt_{m}": _prompt(m) for m in ("standard", "narrate", "explorer")}
