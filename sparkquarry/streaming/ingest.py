"""Incremental ingestion of documents as a stream of files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..operators.chunking import chunk_documents, number
from ..operators.embedding import Factory, embed
from ..runtime import scratch
from ..schema import CHAPTER
from ..sources.files import GLOB, Extractor, exists, extract, with_names

CHUNKS = "chunk_id long, text string, source string, chapter string, file_type string, part int"
PROCESSED = "file_name string, n_chunks long"
#: Files of one micro-batch.
BATCH = 50


def ingest(spark: SparkSession, folder: str, index: str, settings: Settings, extractors: Mapping[str, Extractor] | None = None, batch: int = BATCH, encoder: Factory | None = None, model: str = "unnamed") -> StreamingQuery:
    """Takes in the new files of ``folder``; ends when all present ones are done.

    Tables below ``index``: chunks (chunk_id, text, source, chapter, file_type, part),
    vectors (chunk_id, embedding) where an ``encoder`` is given, processed (file_name,
    n_chunks), failures (file_name, error, failed_at) and manifest, each with batch_no. The
    chunks of a batch are numbered behind those of all others, and their vectors carry the
    same numbers. A micro-batch that is repeated after a failure overwrites its own part of
    each table, so every file counts once. The stream's checkpoint remembers the files by
    name; failed ones are offered again by ``retry``. ``Engine.open`` reads the result.
    """
    files = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("maxFilesPerTrigger", batch).option("fileNameOnly", "true").option("pathGlobFilter", GLOB).load(folder)
    )
    query = files.writeStream.foreachBatch(lambda df, n: write(with_names(df), n, index, settings, extractors, encoder, model))
    return query.option("checkpointLocation", f"{index}/checkpoint").trigger(availableNow=True).start()


def stored(spark: SparkSession, index: str, name: str, schema: str, but: int | None = None) -> DataFrame:
    """A table of the index, empty where nothing was written yet; without the part of one batch."""
    if not exists(spark, f"{index}/{name}"):
        return spark.createDataFrame([], f"{schema}, batch_no int")
    rows = spark.read.schema(f"{schema}, batch_no int").parquet(f"{index}/{name}")
    return rows if but is None else rows.filter(F.col("batch_no") != but)


def write(files: DataFrame, batch_no: int, index: str, settings: Settings, extractors: Mapping[str, Extractor] | None = None, encoder: Factory | None = None, model: str = "unnamed") -> None:
    """One micro-batch: extracted text is stored first, so that a file is read once."""
    spark = files.sparkSession
    part = f"batch_no={batch_no}"
    staged = f"{index}/staged/{part}"
    extract(files, extractors).write.mode("overwrite").parquet(staged)
    texts = spark.read.schema("file_name string, suffix string, text string, error string").parquet(staged)
    good = texts.filter(F.col("error").isNull()).withColumn("source", F.struct("file_name", "suffix"))
    with scratch():
        others = stored(spark, index, "processed", PROCESSED, batch_no)
        before = others.agg(F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n"), F.countDistinct("file_name").alias("files")).first()
        numbered = number(chunk_documents(good, settings, id_col="file_name"), before["n"])
        rows = numbered.select("chunk_id", "text", F.col("source.file_name").alias("source"), F.lit(CHAPTER).alias("chapter"), F.col("source.suffix").alias("file_type"), "part")
        rows.write.mode("overwrite").parquet(f"{index}/chunks/{part}")
    chunks = spark.read.schema(CHUNKS).parquet(f"{index}/chunks/{part}")
    if encoder is not None:
        embed(chunks.select("chunk_id", "text"), encoder).select("chunk_id", "embedding").write.mode("overwrite").parquet(f"{index}/vectors/{part}")
    counts = chunks.groupBy(F.col("source").alias("file_name")).agg(F.count(F.lit(1)).alias("n_chunks"))
    counts.write.mode("overwrite").parquet(f"{index}/processed/{part}")
    now = F.current_timestamp().alias("failed_at")
    texts.filter(F.col("error").isNotNull()).select("file_name", "error", now).write.mode("overwrite").parquet(f"{index}/failures/{part}")
    own = spark.read.schema(PROCESSED).parquet(f"{index}/processed/{part}").agg(F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("files")).first()
    row = spark.range(1).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("build_date"), F.lit(before["n"] + own["n"]).cast("long").alias("total_chunks"),
        F.lit(before["files"] + own["files"]).cast("long").alias("total_files"), F.lit(model).alias("model"), F.lit("healthy").alias("status"),
    )
    row.coalesce(1).write.mode("overwrite").parquet(f"{index}/manifest/{part}")


def retry(spark: SparkSession, folder: str, index: str, settings: Settings, batch_no: int, extractors: Mapping[str, Extractor] | None = None, encoder: Factory | None = None, model: str = "unnamed") -> None:
    """Reads the failed files again as one batch; those that succeed leave the newest failures."""
    from ..sources.files import list_files

    failed = spark.read.parquet(f"{index}/failures").select("file_name").distinct()
    done = spark.read.parquet(f"{index}/processed").select("file_name").distinct()
    again = list_files(spark, folder).join(failed.join(done, "file_name", "left_anti"), "file_name", "left_semi")
    write(again, batch_no, index, settings, extractors, encoder, model)
