"""What an index holds, and whether it is sound."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings


def list_sources(chunks: DataFrame) -> DataFrame:
    """(source) distinct, in order."""
    return chunks.select("source").distinct().orderBy("source")


def source_chunks(chunks: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """The first chunks, by id, whose source holds ``name`` in any case; 1 to 100 of them."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be from 1 to 100")
    return chunks.filter(F.contains(F.lower("source"), F.lit(name.lower()))).orderBy("chunk_id").limit(limit)


def distribution(chunks: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(value, n) by count, equal counts by value; all values or the ``top`` ones."""
    counts = chunks.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ordered = counts.orderBy(F.desc("n"), F.asc("value"))
    return ordered.limit(top) if top else ordered


def id_gaps(metadata: DataFrame) -> DataFrame:
    """(gaps): how often the next row's id, by position, isn't the next number.

    Rows are ordered in ranges of positions: a task compares its own, and the edges of the
    ranges, one row a range, are compared at the end.
    """
    rows = metadata.select("pos", F.coalesce("chunk_id", "pos").alias("id")).repartitionByRange("pos").withColumn("part", F.spark_partition_id())
    w = Window.partitionBy("part").orderBy("pos")
    inner = rows.withColumn("before", F.lag("id").over(w))
    parts = inner.groupBy("part").agg(
        F.sum(F.when(F.col("before").isNotNull() & (F.col("id") - F.col("before") != 1), 1).otherwise(0)).alias("gaps"), F.min_by("id", "pos").alias("first"), F.max_by("id", "pos").alias("last"), F.min("pos").alias("low")
    )
    edge = F.lag("last").over(Window.orderBy("low"))
    edges = parts.withColumn("edge", F.when(F.col("first") - edge != 1, 1).otherwise(0))
    return edges.agg(F.coalesce(F.sum(F.col("gaps") + F.col("edge")), F.lit(0)).alias("gaps"))


def vector_coverage(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(chunks, vectors, with_vector, gap) as one row; ``vectors``: one row a chunk."""
    both = chunks.select("chunk_id").join(vectors.select("chunk_id", F.lit(1).alias("v")), "chunk_id", "full_outer").join(chunks.select("chunk_id", F.lit(1).alias("c")), "chunk_id", "left")
    return both.agg(
        F.count("c").alias("chunks"), F.count("v").alias("vectors"), F.coalesce(F.sum(F.when(F.col("c").isNotNull() & F.col("v").isNotNull(), 1).otherwise(0)), F.lit(0)).alias("with_vector"), F.abs(F.count("c") - F.count("v")).alias("gap")
    )


def vector_dimensions(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """(dim, n): vectors by length; more than one row means a damaged index."""
    return vectors.groupBy(F.when(F.col(vector_col).isNotNull(), F.size(vector_col)).alias("dim")).agg(F.count(F.lit(1)).alias("n"))


def previews(chunks: DataFrame, n: int = 3, length: int = 120) -> DataFrame:
    """(chunk_id, source, chapter, preview): beginnings of the first chunks on one line."""
    line = F.replace(F.substring("text", 1, length), F.lit("\n"), F.lit(" "))
    return chunks.orderBy("chunk_id").limit(n).select("chunk_id", "source", "chapter", line.alias("preview"))


def reason(error: str = "error"):
    """An error in one spelling: trimmed, lower case, without a full stop."""
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(F.trim(error)), r"\.+$", ""), F.lit("")), F.lit("unknown"))


def merge_failures(report: DataFrame) -> DataFrame:
    """(file_name, error, failed_at): the newest failure of every file."""
    newest = F.max_by(F.struct("error", "failed_at"), F.struct("failed_at", F.coalesce("error", F.lit(""))))
    return report.groupBy("file_name").agg(newest.alias("f")).select("file_name", "f.error", "f.failed_at")


def failure_reasons(report: DataFrame) -> DataFrame:
    """(reason, n): newest failures by reason."""
    return merge_failures(report).groupBy(reason().alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def manifest(chunks: DataFrame, files: DataFrame, model: str) -> DataFrame:
    """(total_chunks, total_files, model, status) as one row."""
    n = chunks.agg(F.count(F.lit(1)).alias("total_chunks"))
    return n.crossJoin(F.broadcast(files.agg(F.countDistinct("file_name").alias("total_files")))).withColumns({"model": F.lit(model), "status": F.lit("healthy")})


def builds(log: DataFrame) -> DataFrame:
    """(built_at, total_chunks, total_files, model, status): the manifests with dates and words in one form."""
    date = F.coalesce(F.try_to_timestamp("build_date", F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp("build_date", F.lit("dd/MM/yyyy HH:mm")))
    return log.select(F.date_format(date, "yyyy-MM-dd HH:mm:ss").alias("built_at"), "total_chunks", "total_files", F.lower("model").alias("model"), F.coalesce(F.lower(F.trim("status")), F.lit("unknown")).alias("status"))


def info(chunks: DataFrame, vectors: DataFrame, log: DataFrame, settings: Settings) -> DataFrame:
    """One row: vectors and their length, distinct sources, the newest build and the settings of retrieval."""
    v = vectors.agg(F.count(F.lit(1)).alias("index_vectors"), F.max(F.size("vec")).alias("index_dim"))
    c = chunks.agg(F.countDistinct("source").alias("cached_sources"))
    build = builds(log).agg(F.max(F.struct("built_at", "total_chunks", "total_files", "model", "status")).alias("b"))
    build = build.select(F.col("b.built_at").alias("last_build"), "b.total_chunks", "b.total_files", "b.model", "b.status")
    own = [F.lit(getattr(settings, name)).alias(name) for name in ("top_k", "candidate_pool", "stitching_window", "rrf_k", "rerank")]
    return v.crossJoin(F.broadcast(c)).crossJoin(F.broadcast(build)).select("*", *own)


def unprocessed(files: DataFrame, processed: DataFrame) -> DataFrame:
    """Files that no build has taken in yet."""
    return files.join(processed.select("file_name").distinct(), "file_name", "left_anti")


def duplicate_texts(chunks: DataFrame) -> DataFrame:
    """(key, n, first_chunk): texts that several chunks share, by md5."""
    return chunks.groupBy(F.md5("text").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("first_chunk")).filter("n > 1")
