"""The chunk table and the one place where missing fields get their defaults."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SOURCE, CHAPTER, FILE_TYPE = "unknown", "unknown", "pdf"


def chunks(metadata: DataFrame, id_col: str = "chunk_id", pos_col: str = "pos") -> DataFrame:
    """(chunk_id, text, source, chapter, file_type), one row a chunk.

    A row without an id is named by its position; of rows with the same id the last by
    position holds. Rows without both have no name and are left out.
    """
    row = F.struct(*(F.col(c) for c in ("text", "source", "chapter", "file_type")))
    named = metadata.select(F.coalesce(F.col(id_col).cast("long"), F.col(pos_col).cast("long")).alias("chunk_id"), F.col(pos_col).alias("pos"), row.alias("row"))
    last = named.filter("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.max_by("row", F.coalesce("pos", F.lit(-1))).alias("row"))
    return last.select(
        "chunk_id",
        F.coalesce("row.text", F.lit("")).alias("text"),
        F.coalesce("row.source", F.lit(SOURCE)).alias("source"),
        F.coalesce("row.chapter", F.lit(CHAPTER)).alias("chapter"),
        F.coalesce("row.file_type", F.lit(FILE_TYPE)).alias("file_type"),
    )


def vectors(df: DataFrame, id_col: str = "chunk_id", vector_col: str = "embedding", dim: int | None = None) -> DataFrame:
    """(chunk_id, vec array<double>) of unit length, one row a chunk.

    Null, zero and wrongly long vectors and those with a null or non-finite number are left out.
    """
    v = F.col(vector_col).cast("array<float>")
    usable = F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("chunk_id"), v.alias("v")).filter(F.col("chunk_id").isNotNull() & ((F.size("v") == dim) if dim else (F.size("v") > 0)) & usable)

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch.column(1).offsets.to_numpy()
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            offsets = offsets - offsets[0]
            if len(flat):
                flat /= np.repeat(np.sqrt(np.add.reduceat(flat * flat, offsets[:-1])), np.diff(offsets))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))], ["chunk_id", "vec"])

    return rows.dropDuplicates(["chunk_id"]).mapInArrow(unit, "chunk_id long, vec array<double>")
