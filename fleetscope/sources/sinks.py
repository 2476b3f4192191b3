"""Table sinks (S6-S9, S16): append-only parquet partitioned by month.

Retries are Spark task retries and the write is atomic per job, so nothing
is dropped after a fixed number of attempts.  Key-deduplicated tables
(features, scores) are appended as-is and resolved at read time with
``operators.dedup.latest_version`` (an ``ingest_seq`` column orders inserts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.functions.timefeat import month_key


def with_month(df: DataFrame, ts: str = "ts") -> DataFrame:
    """``month`` = yyyyMM of the row's instant."""
    return df.withColumn("month", month_key(ts))


def append_layout(df: DataFrame, ts: str = "ts", sort_keys: list[str] | None = None) -> DataFrame:
    """The frame an append writes: month column, one rebalancing shuffle by
    (month, leading sort key) so each task writes few files - AQE splits the
    partition of a hot key (one server with a third of the rows) into several
    tasks instead of one huge file - and rows clustered by the sort key and
    time inside each file (row-group statistics then prune)."""
    out = with_month(df, ts)
    out = out.hint("rebalance", "month", *(sort_keys[:1] if sort_keys else []))
    if sort_keys:
        out = out.sortWithinPartitions(*sort_keys, ts)
    return out


def append_table(df: DataFrame, path: str, ts: str = "ts", sort_keys: list[str] | None = None) -> None:
    """Append rows, partitioned by month."""
    append_layout(df, ts, sort_keys).write.mode("append").partitionBy("month").parquet(path)


def append_keyed(df: DataFrame, path: str, ingest_seq: int, ts: str = "ts",
                 sort_keys: list[str] | None = None) -> None:
    """Append features/scores with the insert sequence that A14 uses."""
    append_table(df.withColumn("ingest_seq", F.lit(ingest_seq).cast("long")), path, ts, sort_keys)


def read_table(spark, path: str, since_month: int | None = None) -> DataFrame:
    """Read a month-partitioned table; a month bound prunes partitions."""
    df = spark.read.parquet(path)
    return df.filter(F.col("month") >= since_month) if since_month is not None else df
