"""Requests: many questions in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import query_terms, strip


def normalise(requests: DataFrame, settings: Settings) -> DataFrame:
    """(query_id, query, top_k, pool, win, book_filter, source_filter, terms) with defaults.

    Zero and null take the settings' value; an empty filter is none. Blank questions are
    left out: they are errors to a caller, not searches.
    """
    have = set(requests.columns)

    def number(name: str, default: int):
        return F.coalesce(F.nullif(F.col(name).cast("int"), F.lit(0)), F.lit(default)) if name in have else F.lit(default)

    book = F.nullif(F.col("book_filter"), F.lit("")) if "book_filter" in have else F.lit(None).cast("string")
    sources = F.when(F.size("source_filter") > 0, F.col("source_filter")) if "source_filter" in have else F.lit(None).cast("array<string>")
    return requests.select(
        F.col("query_id").cast("long").alias("query_id"),
        "query",
        number("top_k", settings.top_k).alias("top_k"),
        number("candidate_pool", settings.candidate_pool).alias("pool"),
        number("stitching_window", settings.stitching_window).alias("win"),
        book.alias("book_filter"),
        sources.alias("source_filter"),
        query_terms(F.col("query")).alias("terms"),
    ).filter(strip(F.col("query")) != "")
