"""Fusion, filters, grounding, stitching, re-ranking, and the searches made of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import matched_terms, strip
from ..runtime import materialize
from .requests import normalise
from .scan import bm25_index, bm25_stats, bm25_topk, dense_topk

#: Rows that are sent to all tasks to fetch chunks by; more are joined by a shuffle.
SENT = 500_000
#: Decimals by which fused scores are ranked.
RRF_DECIMALS = 12


def fetch(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks of ``ids`` (chunk_id), fetched in one reading of the table.

    What asks is bounded by questions x pool and is counted: the ids are sent to the table,
    which isn't shuffled; only more than SENT of them are joined by a shuffle.
    """
    asked = ids.select("chunk_id").distinct()
    few = asked.count() <= SENT
    return chunks.join(F.broadcast(asked) if few else asked, "chunk_id", "left_semi")


def rrf_merge(requests: DataFrame, dense: DataFrame, bm25: DataFrame, chunks: DataFrame, settings: Settings) -> DataFrame:
    """(query_id, merged_rank, chunk_id, rrf_score, dense_rank, dense_score, bm25_rank, bm25_score).

    Hits of equal text are one: their scores add up, and the last dense hit stands for
    them, else the first of BM25, with its own list's columns. At most ``pool`` a question;
    equal scores keep the order in which they were met, dense hits first.
    """
    texts = chunks.select("chunk_id", F.md5("text").alias("key"))
    lists = dense.withColumn("dense", F.lit(True)).unionByName(bm25.withColumn("dense", F.lit(False)))
    hits = lists.join(texts, "chunk_id")
    row = F.struct("chunk_id", "rank", "score")
    merged = hits.groupBy("query_id", "key").agg(
        F.sum(1.0 / (settings.rrf_k + F.col("rank"))).alias("rrf_score"),
        F.max_by(row, F.when(F.col("dense"), F.col("rank"))).alias("d"),
        F.min_by(row, F.when(~F.col("dense"), F.col("rank"))).alias("b"),
        F.min(F.when(F.col("dense"), F.col("rank"))).alias("dense_seen"),
        F.min(F.when(~F.col("dense"), F.col("rank"))).alias("bm25_seen"),
    )
    seen = F.coalesce("dense_seen", F.lit(1_000_000) + F.col("bm25_seen"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf_score", RRF_DECIMALS)), seen)
    ranked = merged.withColumn("merged_rank", F.row_number().over(w) - 1).join(requests.select("query_id", "pool"), "query_id").filter("merged_rank < pool")
    bm25_only = F.col("dense_seen").isNull()
    return ranked.select(
        "query_id",
        "merged_rank",
        F.when(bm25_only, F.col("b.chunk_id")).otherwise(F.col("d.chunk_id")).alias("chunk_id"),
        "rrf_score",
        F.when(~bm25_only, F.col("d.rank")).alias("dense_rank"),
        F.when(~bm25_only, F.col("d.score")).alias("dense_score"),
        F.when(bm25_only, F.col("b.rank")).alias("bm25_rank"),
        F.when(bm25_only, F.col("b.score")).alias("bm25_score"),
    )


def apply_filters(merged: DataFrame, requests: DataFrame) -> DataFrame:
    """Book (part of the source, any case) and source (exactly one of) filters, after the cut; needs column source."""
    asked = requests.select("query_id", "book_filter", "source_filter")
    rows = merged.join(asked, "query_id")
    book = F.col("book_filter").isNull() | F.contains(F.lower("source"), F.lower("book_filter"))
    source = F.col("source_filter").isNull() | F.array_contains("source_filter", F.col("source"))
    return rows.filter(book & source).drop("book_filter", "source_filter")


def ground(merged: DataFrame, requests: DataFrame) -> DataFrame:
    """Adds matched terms, their number and grounded_rank: more terms first, then the fused order."""
    haystack = F.lower(F.concat_ws(" ", "source", "chapter", "text"))
    rows = merged.join(requests.select("query_id", "terms"), "query_id")
    rows = rows.withColumn("overlap_terms", F.array_sort(matched_terms(F.col("terms"), haystack))).withColumn("overlap", F.size("overlap_terms").cast("double"))
    w = Window.partitionBy("query_id").orderBy(F.desc("overlap"), F.desc(F.round("rrf_score", RRF_DECIMALS)), F.asc("merged_rank"))
    return rows.withColumn("grounded_rank", F.row_number().over(w) - 1).drop("terms")


def around(chunk_id: Column, window: Column) -> Column:
    """The ids within ``window`` of a chunk."""
    return F.sequence(F.greatest(F.lit(0), chunk_id - window), chunk_id + window)


def stitch(hits: DataFrame, windows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds stitch_range and replaces text by the texts of the neighbours a hit owns.

    A neighbour belongs to the best-ranked hit whose window covers it. A hit that owns
    none, has no id or a window of 0 keeps its text and has no range. ``windows``:
    (query_id, win). One row a hit, always.
    """
    hits = hits.join(windows.select("query_id", "win"), "query_id")
    spread = hits.filter("win > 0 AND chunk_id IS NOT NULL").select("query_id", "grounded_rank", F.explode(around(F.col("chunk_id"), F.col("win"))).alias("nid"))
    owned = spread.groupBy("query_id", "nid").agg(F.min("grounded_rank").alias("grounded_rank"))
    parts = owned.join(chunks.select(F.col("chunk_id").alias("nid"), strip(F.col("text")).alias("part")), "nid")
    joined = parts.groupBy("query_id", "grounded_rank").agg(F.array_sort(F.collect_list(F.struct("nid", "part"))).alias("parts"))
    joined = joined.select(
        "query_id",
        "grounded_rank",
        F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n").alias("stitched"),
        F.concat(F.lit("chunk_id "), F.element_at("parts", 1)["nid"].cast("string"), F.lit("-"), F.element_at("parts", -1)["nid"].cast("string")).alias("stitch_range"),
    )
    return hits.join(joined, ["query_id", "grounded_rank"], "left").withColumn("text", F.coalesce("stitched", "text")).drop("stitched", "win")


#: Scores pairs of questions and texts.
Scorer = Callable[[pd.Series, pd.Series], pd.Series]


def rerank(stitched: DataFrame, requests: DataFrame, scorer: Scorer | None) -> DataFrame:
    """Adds rerank_score and rank: by the scorer where a question has more than one hit, then by overlap; without a scorer the grounded order."""
    if scorer is None:
        return stitched.withColumn("rerank_score", F.lit(None).cast("double")).withColumn("rank", F.col("grounded_rank"))
    score = F.pandas_udf(scorer, "double")
    rows = stitched.join(requests.select("query_id", "query"), "query_id").withColumn("hits", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    rows = rows.withColumn("scored", score("query", "text")).withColumn("rerank_score", F.when(F.col("hits") > 1, F.col("scored")))
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), F.desc("overlap"), F.asc("grounded_rank"))
    return rows.withColumn("rank", F.row_number().over(w) - 1).drop("query", "hits", "scored")


class Retrieval:
    """The stages of one search over many questions; each is planned when it is asked for.

    The chunk table is read by several stages and is written once to the shared folder; an
    index that is stored as a table already can be given as ``stored``, with the
    ``bm25_index`` of its chunks as ``postings`` and their ``bm25_stats`` as ``stats``. The
    hits of both scans are written before they are fused: few rows, whose chunks are
    fetched once.
    """

    def __init__(self, requests: DataFrame, query_vectors: DataFrame, chunks: DataFrame, vectors: DataFrame, settings: Settings, scorer: Scorer | None = None, stored: bool = False, postings: DataFrame | None = None, stats: tuple[DataFrame, DataFrame] | None = None):
        self.requests = normalise(requests, settings)
        self.query_vectors, self.vectors = query_vectors, vectors
        self.settings, self.scorer = settings, scorer
        self._given, self._stored = chunks, stored
        self._postings, self._stats = postings, stats

    @cached_property
    def chunks(self) -> DataFrame:
        return self._given if self._stored else materialize(self._given, "chunks")

    @cached_property
    def dense(self) -> DataFrame:
        return dense_topk(self.requests, self.query_vectors, self.vectors)

    @cached_property
    def bm25(self) -> DataFrame:
        postings = self._postings if self._postings is not None else materialize(bm25_index(self.chunks), "postings")
        return bm25_topk(self.requests, postings, self.settings, self._stats)

    @cached_property
    def _lists(self) -> tuple[DataFrame, DataFrame]:
        both = materialize(self.dense.withColumn("dense", F.lit(True)).unionByName(self.bm25.withColumn("dense", F.lit(False))), "hits")
        return both.filter("dense").drop("dense"), both.filter(~F.col("dense")).drop("dense")

    @cached_property
    def _fetched(self) -> DataFrame:
        """The chunks that are hits of any question."""
        dense, bm25 = self._lists
        return materialize(fetch(self.chunks, dense.select("chunk_id").unionByName(bm25.select("chunk_id"))), "fetched")

    @cached_property
    def merged(self) -> DataFrame:
        return rrf_merge(self.requests, *self._lists, self._fetched, self.settings)

    @cached_property
    def filtered(self) -> DataFrame:
        return apply_filters(self.merged.join(self._fetched, "chunk_id"), self.requests)

    @cached_property
    def grounded(self) -> DataFrame:
        return ground(self.filtered, self.requests)

    @cached_property
    def top(self) -> DataFrame:
        best = self.grounded.join(self.requests.select("query_id", "top_k"), "query_id").filter("grounded_rank < top_k").drop("top_k")
        return materialize(best, "top")

    @cached_property
    def stitched(self) -> DataFrame:
        windows = self.requests.select("query_id", "win")
        near = self.top.join(windows, "query_id").filter("chunk_id IS NOT NULL").select(F.explode(around(F.col("chunk_id"), F.col("win"))).alias("chunk_id"))
        return stitch(self.top, windows, fetch(self.chunks.select("chunk_id", "text"), near))

    def search(self) -> DataFrame:
        """(query_id, rank, chunk_id, source, chapter, file_type, text, scores, overlap_terms, stitch_range)."""
        return rerank(self.stitched, self.requests, self.scorer).drop("merged_rank")

    def inspect(self) -> dict[str, DataFrame]:
        """The stages a caller looks at, without re-ranking: five hits of each list, grounded and stitched rows."""
        return {
            "terms": self.requests.select("query_id", "terms"),
            "dense": self.dense.filter("rank < 5"),
            "bm25": self.bm25.filter("rank < 5"),
            "grounded": self.top,
            "stitched": self.stitched,
        }
