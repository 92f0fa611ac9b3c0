"""Shared plumbing of the training-data operators: staged tables and small column helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one on a single machine, and
    an error on a cluster, whose executors could not read it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no shared folder")
        at = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: computed once, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`staged` that nothing will read again."""
    spark, path = df.sparkSession, df._staged_path
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def give_back() -> None:
    """Return what a task has freed to the system: a Python worker outlives its tasks, and others need the memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def in_small_batches(docs: DataFrame, rows: int = 1_000) -> DataFrame:
    """``docs``, once the session hands Python workers at most ``rows`` rows at a time: texts may be long, and a batch
    is in memory several times over. A smaller setting stays."""
    key, spark = "spark.sql.execution.arrow.maxRecordsPerBatch", docs.sparkSession
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    return docs


def column(name: str, of: str | None = None) -> Column:
    """The column of exactly that name, dots and backticks in it or not, of a table or of its struct column ``of``."""
    quoted = "`" + name.replace("`", "``") + "`"
    return F.col(f"{of}.{quoted}" if of else quoted)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
