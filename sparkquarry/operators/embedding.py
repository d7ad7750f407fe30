"""Vectors of texts by a pluggable encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import enrich

#: Makes an encoder; called once in each worker, so that a model is loaded once. The encoder turns texts into a matrix.
Factory = Callable[[], Callable[[list[str]], np.ndarray]]


def embed(df: DataFrame, factory: Factory, text_col: str = "text", out_col: str = "embedding", normalise: bool = True) -> DataFrame:
    """Adds a column with the vector of each text; null texts are encoded as empty ones."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = factory()
        for texts in batches:
            x = np.asarray(encode(texts.fillna("").tolist()), np.float32)
            if normalise:
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
            yield pd.Series(list(x))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out_col, F.pandas_udf(run, "array<float>")(F.col(text_col)))


def query_vectors(requests: DataFrame, factory: Factory) -> DataFrame:
    """(query_id, qvec): vectors of the questions with the prefix encoders expect of them; the texts of the index have none."""
    rows = requests.select("query_id", enrich(F.col("query")).alias("text"))
    return embed(rows, factory).select("query_id", F.col("embedding").cast("array<double>").alias("qvec"))
