"""Helpers shared by the corpus operators: shared staging folders, table reading, small expressions."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of characters other than space and the controls from tab to carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset on a
    local master (tests), a temporary folder that is then set as checkpoint folder. A cluster without one is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is not set: executors of {master} need a folder that all of them share")
        found = "file://" + tempfile.mkdtemp(prefix="palisade-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return f"{found.rstrip('/')}/palisade-{spark.sparkContext.applicationId}"


def staged_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Paths written in the scopes that are open, innermost last.
_scopes: list[list[str]] = []
#: Rows and bytes of an Arrow batch: texts may be long.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Rows and file bytes of a staged table that may be broadcast; a larger one is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 250_000, 4 << 20


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut, and lost
    executors cost only the tasks that they ran."""
    spark, path, began = df.sparkSession, staged_path(df.sparkSession, name), time.time()
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    if time.time() - began > 2:
        spark.sparkContext._jvm.System.gc()  # the write's shuffle files go with its plan
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def staged_bytes(df: DataFrame) -> int:
    """Bytes of a staged table's files."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def with_small(left: DataFrame, small: DataFrame, on: list[str], how: str, times: int = 1) -> DataFrame:
    """Join with a staged side, which is broadcast if its files and rows are within the bounds, or so many times them for rows of a few numbers."""
    fits = staged_bytes(small) <= times * BROADCAST_BYTES and small.count() <= times * BROADCAST_ROWS
    return left.join(F.broadcast(small) if fits else small, on, how)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A scope whose staged tables are deleted at its end, but for those handed to the function it gives."""
    own: list[str] = []
    kept: set[str] = set()
    _scopes.append(own)

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.staged_path)
        return df

    try:
        yield keep
    finally:
        _scopes.pop()
        for path in own:
            if path not in kept:
                delete(spark, path)
        if _scopes:
            _scopes[-1].extend(kept)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def arrow_map(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow in batches of at most :data:`BATCH_ROWS` rows or about :data:`BATCH_BYTES`, so that long texts do not pile up in a worker;
    at the end of a task the worker, which Spark keeps, gives freed memory back to the system."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(re.sub(r"\D", "", conf.get(name)) or 0) <= most or not conf.get(name).isdigit():
            conf.set(name, str(most))  # the session's: batches are cut when a plan runs

    def lean(batches):
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(lean, schema)


def release_staged(spark: SparkSession) -> None:
    """Delete what :func:`staged` wrote in this application. Results that still read it end here."""
    delete(spark, shared_dir(spark))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))

