"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.session import configure, ensure_checkpoint_dir

#: Key that stands for a null doc_id inside an operator (results keep the null).
NULL_ID = -(1 << 63)
ARROW_BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: Arrow batches bounded by bytes, so
    a task's memory does not depend on the length of the texts it meets."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: cuts the
    lineage, survives lost executors, and is read by column."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` whose successor is written, and let the
    driver's JVM collect the plans of finished jobs: their shuffle files go
    with them, which otherwise waits for the driver to run short of memory."""
    for df in tables:
        spark = df.sparkSession
        files = df.inputFiles()
        if files:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    release(SparkSession.getActiveSession())


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs (see ``discard``).  Events
    that are still on their way hold the plan of a job that has just ended, so
    the second collection comes a moment later."""
    for pause in (0.5, 0.0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def id_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def row_key(*parts: Column) -> Column:
    """One long for some columns, in which nulls count: a document is its id
    and its text, whatever else repeats the id."""
    return F.xxhash64(*[c for x in parts for c in (x.isNull(), x)])


def byte_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def grouped(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Slices [a, b) of consecutive items that sum to about ``limit`` at most."""
    a = total = 0
    for i, n in enumerate(sizes):
        if i > a and total + n > limit:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)
