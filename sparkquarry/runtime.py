"""Session-level helpers: shared folder, durable intermediate tables, column checks."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster in ``spark.checkpoint.dir``.

    Only where none is named and the master runs in this process (local tests) a temporary
    folder is made and set, so that later calls in the session agree on it. On a cluster
    a folder of one machine would be lost or unseen, so a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master or 'the cluster'} share")
        folder = "file://" + tempfile.mkdtemp(prefix="sparkquarry-")
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(shutil.rmtree, folder[len("file://") :], ignore_errors=True)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder as Parquet and returns the table read back.

    This cuts the lineage durably: a lost executor costs at most a re-read. The table
    is removed when the session's process ends, by ``drop_materialized``, or at the end of
    the ``scratch`` block it was written in.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkquarry/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(drop_materialized)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that ``materialize`` writes inside the block are deleted when it ends; results must be fetched or written before."""
    before = len(_written)
    try:
        yield
    finally:
        drop_materialized(before)


def drop_materialized(keep: int = 0) -> None:
    """Deletes the tables written by ``materialize`` in this process, but the first ``keep``."""
    while len(_written) > keep:
        spark, path = _written.pop()
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the JVM is gone already
            if path.startswith("file:"):
                shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
