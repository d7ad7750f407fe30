"""Scans of a set of questions, in blocks, against all rows: dense and BM25 scores, the best k kept.

A block of questions is small and of fixed size, so it is sent to all tasks; the corpus is
read once for each block and never shuffled. A task keeps k rows of each question, so what
is shuffled is questions x k x tasks, whatever the corpus holds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import tokens
from ..runtime import materialize

#: Questions sent to the tasks at once.
BLOCK = 4096
#: Scores held at once.
CELLS = 8_000_000
#: Decimals by which scores are ranked, so that the order of additions can't swap two rows.
DECIMALS = 9

_split = re.compile(r"[ \t\n\x0b\f\r]+").split
_HIT = "query_id long, chunk_id long, score double"


def _blocks(requests: DataFrame) -> Iterator[DataFrame]:
    n = requests.count()
    if n <= BLOCK:
        yield requests
        return
    parts = -(-n // (BLOCK // 2))
    for k in range(parts):
        yield requests.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == k)


def _best(scores: np.ndarray, ids: np.ndarray, k: int, ascending: bool) -> np.ndarray:
    """Indices of the k best by score rounded, then by id."""
    rounded = np.round(scores, DECIMALS)
    if len(ids) > k:
        bar = np.partition(rounded, len(ids) - k)[len(ids) - k]
        at = np.flatnonzero(rounded >= bar)
    else:
        at = np.arange(len(ids))
    order = np.lexsort((ids[at] if ascending else -ids[at], -rounded[at]))
    return at[order[:k]]


class _Keeper:
    """The best k rows of every question of a block over the batches of one task."""

    def __init__(self, query_ids: list[int], ks: list[int], ascending: bool):
        self.query_ids, self.ks, self.ascending = query_ids, ks, ascending
        self.rows = [(np.zeros(0, np.int64), np.zeros(0))] * len(query_ids)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        for i, k in enumerate(self.ks):
            at = _best(scores[i], ids, k, self.ascending)
            own_ids, own = np.concatenate([self.rows[i][0], ids[at]]), np.concatenate([self.rows[i][1], scores[i][at]])
            at = _best(own, own_ids, k, self.ascending)
            self.rows[i] = own_ids[at], own[at]

    def batch(self) -> pa.RecordBatch:
        query = np.repeat(np.array(self.query_ids, np.int64), [len(ids) for ids, _ in self.rows])
        return pa.RecordBatch.from_arrays([pa.array(query), *(pa.array(np.concatenate([r[j] for r in self.rows])) for j in (0, 1))], ["query_id", "chunk_id", "score"])


def _ranked(hits: DataFrame, pools: DataFrame, most: int, ascending: bool) -> DataFrame:
    """The best of all tasks' hits; a task of the window keeps ``most`` rows of a question, the largest pool asked for."""
    tie = F.asc("chunk_id") if ascending else F.desc("chunk_id")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", DECIMALS)), tie)
    ranked = hits.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
    return ranked.join(pools, "query_id").filter(F.col("place") <= F.col("pool")).select("query_id", "chunk_id", (F.col("place") - 1).alias("rank"), "score")


def dense_topk(requests: DataFrame, query_vectors: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, chunk_id, rank, score): the ``pool`` nearest chunks by inner product, ranks from 0.

    Equal scores are ranked by the smaller chunk id. Questions without a vector have no
    hits. ``query_vectors``: (query_id, qvec); all vectors must have one length.
    """
    asked = requests.select("query_id", "pool").join(query_vectors, "query_id")
    out, most = None, 1
    for block in _blocks(asked):
        rows = block.select("query_id", "pool", "qvec").collect()
        if not rows:
            continue
        ids, ks = [r[0] for r in rows], [r[1] for r in rows]
        most = max(most, *ks)
        sent = vectors.sparkSession.sparkContext.broadcast(np.array([r[2] for r in rows], np.float64))

        def scan(batches: Iterator[pa.RecordBatch], ids=ids, ks=ks, sent=sent) -> Iterator[pa.RecordBatch]:
            q, kept = sent.value, _Keeper(ids, ks, True)
            step = max(1, CELLS // len(q))
            for batch in batches:
                for begin in range(0, batch.num_rows, step):
                    part = batch.slice(begin, step)
                    v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    if v.shape[1] != q.shape[1]:
                        raise ValueError(f"the questions' vectors have {q.shape[1]} numbers, the chunks' {v.shape[1]}")
                    kept.add(q @ v.T, part.column(0).to_numpy())
            yield kept.batch()

        hits = vectors.select("chunk_id", "vec").mapInArrow(scan, _HIT)
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], _HIT)
    return _ranked(out, requests.select("query_id", "pool"), most, True)


def bm25_index(chunks: DataFrame) -> DataFrame:
    """(chunk_id, length, terms array<string>, counts array<int>): each chunk's distinct tokens, made once for an index.

    Chunks without a token stay, with empty arrays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [Counter(t for t in _split(text.lower()) if t) for text in batch.column(1).to_pylist()]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in own])]).astype(np.int32)) if own else pa.array([0], pa.int32())
            terms = pa.ListArray.from_arrays(offsets, pa.array([t for c in own for t in c], pa.string()))
            counts = pa.ListArray.from_arrays(offsets, pa.array([n for c in own for n in c.values()], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.total() for c in own], pa.int32()), terms, counts], ["chunk_id", "length", "terms", "counts"])

    return chunks.select("chunk_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "chunk_id long, length int, terms array<string>, counts array<int>")


def bm25_stats(index: DataFrame, stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """(term, df, idf_raw) of every term, and one row (n, avgdl, mean_idf) of the corpus; ``stored``: the terms are written once."""
    size = index.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avgdl"))
    df = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.crossJoin(F.broadcast(size.select("n"))).withColumn("idf_raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).drop("n")
    raw = materialize(raw, "terms") if stored else raw
    corpus = size.crossJoin(F.broadcast(raw.agg(F.avg("idf_raw").alias("mean_idf"))))
    return raw, corpus


def bm25_topk(requests: DataFrame, index: DataFrame, settings: Settings, stats: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query_id, chunk_id, rank, score): exactly min(pool, N) chunks a question, ranks from 0.

    ``index``: as ``bm25_index`` makes it; ``stats``: its ``bm25_stats``, where they are
    stored. Chunks without a matching term score 0 and are ranked like others; equal scores
    by the larger chunk id. A negative idf is replaced by epsilon times the mean idf.
    Only the questions' own terms are sent to the tasks, as lists, block by block.
    """
    terms, corpus = stats or bm25_stats(index, stored=True)
    size = corpus.first()
    out, most = None, 1
    if size["n"]:
        for block in _blocks(requests.select("query_id", "pool", "query")):
            words = block.select(F.explode(tokens(F.col("query"))).alias("term")).distinct()
            idf = {r["term"]: r["idf_raw"] if r["idf_raw"] >= 0 else settings.bm25_epsilon * size["mean_idf"] for r in terms.join(F.broadcast(words), "term").collect()}
            rows = block.collect()
            if not rows:
                continue
            known = sorted(idf)
            place = {t: i for i, t in enumerate(known)}
            asking: list[list[tuple[int, float]]] = [[] for _ in known]  # of each term the questions and their weights
            for i, r in enumerate(rows):
                for t, times in Counter(x for x in _split(r["query"].lower()) if x).items():
                    if t in place:
                        asking[place[t]].append((i, times * idf[t]))
            ids, ks = [r["query_id"] for r in rows], [r["pool"] for r in rows]
            most = max(most, *ks)
            sent = index.sparkSession.sparkContext.broadcast((known, asking))
            k1, b, avgdl = settings.bm25_k1, settings.bm25_b, float(size["avgdl"] or 1.0)

            def scan(batches: Iterator[pa.RecordBatch], ids=ids, ks=ks, sent=sent, k1=k1, b=b, avgdl=avgdl) -> Iterator[pa.RecordBatch]:
                known, asking = sent.value
                known = pa.array(known, pa.string())
                kept = _Keeper(ids, ks, False)
                step = max(1, CELLS // len(ids))
                for batch in batches:
                    for begin in range(0, batch.num_rows, step):
                        part = batch.slice(begin, step)
                        at = pc.fill_null(pc.index_in(part.column(2).flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
                        found = np.flatnonzero(at >= 0)
                        row = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False))[found]
                        n = part.column(3).flatten().to_numpy(zero_copy_only=False)[found].astype(np.float64)
                        tf = n * (k1 + 1) / (n + k1 * (1 - b + b * part.column(1).to_numpy()[row] / avgdl))
                        order = np.argsort(at[found], kind="stable")
                        term, row, tf = at[found][order], row[order], tf[order]
                        edges = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1], [True]])) if len(term) else []
                        scores = np.zeros((len(ids), part.num_rows))
                        for lo, hi in zip(edges[:-1], edges[1:]):  # a chunk has a term once
                            for i, weight in asking[term[lo]]:
                                scores[i, row[lo:hi]] += weight * tf[lo:hi]
                        kept.add(scores, part.column(0).to_numpy())
                yield kept.batch()

            hits = index.select("chunk_id", "length", "terms", "counts").mapInArrow(scan, _HIT)
            out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = index.sparkSession.createDataFrame([], _HIT)
    return _ranked(out, requests.select("query_id", "pool"), most, False)
