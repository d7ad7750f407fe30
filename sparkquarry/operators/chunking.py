"""Sentence-aware overlapping chunks of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import SPACE, strip
from ..runtime import materialize

_end = re.compile(r"([.!?])[ \t\n\x0b\f\r]+")
_space = re.compile(r"[ \t\n\x0b\f\r]+")


def sentences(text: str) -> list[str]:
    """The text cut after . ! ? followed by white space."""
    return [s for s in _end.sub("\\1\x01", text.strip(" \t\n\x0b\f\r")).split("\x01") if s]


def fold(sents: list[str], target: int, overlap: int) -> list[str]:
    """Chunks of at least ``target`` words but the last; each next begins with the last ``overlap`` sentences."""
    sizes = [len([w for w in _space.split(s) if w]) for s in sents]
    out, first, words = [], 0, 0
    for i in range(len(sents)):
        words += sizes[i]
        if words >= target:
            out.append(" ".join(sents[first : i + 1]))
            first = max(first if not overlap else 0, i + 1 - overlap)
            words = sum(sizes[first : i + 1])
    if first < len(sents):
        out.append(" ".join(sents[first:]))
    return out


def chunk_documents(documents: DataFrame, settings: Settings, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, part, text, source): chunks of every document, parts from 0.

    Null and blank texts give no chunk; see ``rejected``. A narrow pass: each document is
    folded where it is read.
    """
    kind, source_kind = (documents.schema[c].dataType.simpleString() for c in (id_col, source_col))
    target, overlap = settings.target_words, settings.overlap_sentences

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, part, text = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for p, chunk in enumerate(fold(sentences(t), target, overlap)):
                    at.append(i), part.append(p), text.append(chunk)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(part, pa.int32()), pa.array(text, pa.string()), batch.column(2).take(rows)], ["doc_id", "part", "text", "source"])

    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source")).filter(strip(F.col("text")) != "")
    return texts.mapInArrow(run, f"doc_id {kind}, part int, text string, source {source_kind}")


def rejected(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, error): documents without content."""
    empty = F.col(text_col).isNull() | (F.regexp_replace(text_col, SPACE, "") == "")
    return documents.filter(empty).select(F.col(id_col).alias("doc_id"), F.lit("Empty content.").alias("error"))


def number(chunks: DataFrame, start: int = 0) -> DataFrame:
    """Adds chunk_id, dense from ``start`` by (doc_id, part).

    Only (doc_id, number of chunks) is ordered: ranges of documents are sorted in parallel
    and counted, so no task holds more than one range. The chunks are written first, as
    they are read twice and folding them is the costly part.
    """
    chunks = materialize(chunks, "chunks")
    sizes = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    # written, so that both uses see the same ranges
    ranged = materialize(sizes.repartitionByRange("doc_id").withColumn("range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("range").agg(F.sum("n").alias("total"), F.min("doc_id").alias("low"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = totals.withColumn("base", before).select("range", "base")  # one row a range
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("range").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = ranged.join(F.broadcast(base), "range").withColumn("first", F.lit(start) + F.col("base") + inside).select("doc_id", "first")
    return chunks.join(first, "doc_id").withColumn("chunk_id", F.col("first") + F.col("part")).drop("first")
