"""Feature table (M1) and its incremental hourly form (R2).

One pass over all series: rolling 5-minute mean/std over the half-open frame
(t - 5 min, t], rate of change against the previous sample, cyclic hour and
day-of-week columns.  No UDF; the windows run per (series, day chunk) with
exact edge repair (``operators.chunked``), so a hot series is never one task.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.functions import timefeat
from fleetscope.operators import chunked
from fleetscope.operators.series import SERIES, to_dt, ts_lit
from fleetscope.sources.bindings import idiv

ROLLING_US = 300_000_000   # 5 minutes
FEATURE_COLUMNS = ["server_id", "metric_name", "ts", "raw_value", "rolling_mean_5m", "rolling_std_5m",
                   "rate_of_change", "hour_sin", "hour_cos", "day_of_week", "is_weekend"]


def compute_features(metrics: DataFrame, keys: list[str] | None = None,
                     chunk_us: int | None = None) -> DataFrame:
    """M1: feature rows for every sample of every series.

    Rate of change is 0 for the first sample of a series and for samples that
    share the previous sample's instant.

    One shuffle of the data: rows are partitioned by (series, chunk), rows
    near a chunk's end are copied into the next chunk, and window stages on
    these partitions yield the previous row and the rolling mean/std, whose
    cost does not depend on how many rows a frame holds.  Only a first row
    whose predecessor is more than 5 minutes back (outside the copies) needs
    the per-chunk summary, which is joined back."""
    keys = keys or SERIES
    chunk_us = chunked.chunk_size(chunk_us, floor_us=ROLLING_US)
    if ROLLING_US > chunk_us:
        raise ValueError("chunk shorter than the rolling window")
    us = F.unix_micros("ts")
    chunk = idiv(us, chunk_us)
    copies = F.when(us > (chunk + 1) * F.lit(chunk_us) - ROLLING_US,
                    F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    x = (metrics.select(*keys, "ts", "value").withColumn("_us", us)
         .withColumn("_copy", F.explode(copies)).withColumn("_chunk", chunk + F.col("_copy")))
    w_row = Window.partitionBy(*keys, "_chunk").orderBy("_us")
    # last row of each non-empty chunk -> carried to the next non-empty chunk
    last = (x.filter(F.col("_copy") == 0).groupBy(*keys, "_chunk")
            .agg(F.max("_us").alias("_lus"), F.max_by("value", "_us").alias("_lv")))
    x = (x.withColumn("_pus", F.lag("_us").over(w_row))
         .withColumn("_pv", F.lag("value").over(w_row)))
    x = chunked.rolling_mean_std(x, [*keys, "_chunk"], "_us", "value", ROLLING_US).filter(F.col("_copy") == 0)
    ws = Window.partitionBy(*keys).orderBy("_chunk")
    carry = (last.withColumn("_cus", F.lag("_lus").over(ws)).withColumn("_cv", F.lag("_lv").over(ws))
             .select(*keys, "_chunk", "_cus", "_cv"))
    x = x.join(carry, [*keys, "_chunk"], "left")
    first = F.col("_pus").isNull()
    pus = F.when(first, F.col("_cus")).otherwise(F.col("_pus"))
    pv = F.when(first, F.col("_cv")).otherwise(F.col("_pv"))
    dt = (F.col("_us") - pus) / 1e6
    rate = F.coalesce(F.when(dt == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("value") - pv, dt)), F.lit(0.0))
    return x.select(
        *keys, "ts",
        F.col("value").alias("raw_value"),
        F.col("_mean").alias("rolling_mean_5m"),
        F.col("_std").alias("rolling_std_5m"),
        rate.alias("rate_of_change"),
        timefeat.hour_sin("ts").alias("hour_sin"),
        timefeat.hour_cos("ts").alias("hour_cos"),
        timefeat.day_of_week("ts").alias("day_of_week"),
        timefeat.is_weekend("ts").alias("is_weekend"),
    )


def incremental_features(metrics: DataFrame, stored: DataFrame | None, as_of,
                         lookback_days: int = 30, buffer_minutes: int = 10,
                         chunk_us: int | None = None, watermarks: DataFrame | None = None) -> DataFrame:
    """R2: the rows the hourly job appends.

    Per series: with no stored features, start at as_of - 30 days; otherwise
    re-read from watermark - 10 minutes (warm-up for the rolling frame, and it
    holds the sample at the watermark, the first new row's predecessor) and
    emit only rows strictly newer than the watermark.  Late rows at or before
    the watermark are never computed, as in the reference.  All series in one
    job: the watermark table (one row per series) is joined, not looped.  It is
    ``watermarks`` where the caller keeps one, else taken from ``stored``.  Of
    samples laid out by ``month``, earlier months are not listed."""
    first_start = ts_lit(to_dt(as_of) - timedelta(days=lookback_days))
    chunk_us = chunked.chunk_size(chunk_us, floor_us=ROLLING_US)

    def samples(start: datetime) -> DataFrame:
        m = metrics.filter(F.col("ts") >= ts_lit(start))
        if "month" in metrics.columns:
            m = m.filter(F.col("month") >= start.year * 100 + start.month)
        return m.select(*SERIES, "ts", "value")

    if stored is None and watermarks is None:
        return compute_features(samples(to_dt(as_of) - timedelta(days=lookback_days)), chunk_us=chunk_us)
    wm = watermarks if watermarks is not None else stored.groupBy(*SERIES).agg(F.max("ts").alias("watermark"))
    # one scalar from the stored features: a literal bound that prunes the scan
    low = wm.agg(F.min(F.unix_micros("watermark"))).first()[0]
    oldest = to_dt(as_of) - timedelta(days=lookback_days)
    if low is not None:
        oldest = min(oldest, datetime(1970, 1, 1) + timedelta(microseconds=low, minutes=-buffer_minutes))
    x = samples(oldest).join(wm, SERIES, "left")
    start = F.coalesce(F.col("watermark") - F.expr(f"INTERVAL {buffer_minutes} MINUTES"), first_start)
    # the sample at the watermark lies in the buffer: the first new row has its predecessor
    feats = compute_features(x.filter(F.col("ts") >= start).select(*SERIES, "ts", "value"), chunk_us=chunk_us)
    feats = feats.join(wm, SERIES, "left")
    out = feats.filter((F.col("watermark").isNull() & (F.col("ts") >= first_start))
                       | (F.col("ts") > F.col("watermark")))
    return out.select(*FEATURE_COLUMNS)
