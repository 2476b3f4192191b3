"""Rollup tables: means, sparklines and login counts without the raw rows.

A rollup row is a partial aggregate of one key and time bucket.  Partials add
up in any order, so a stream appends those of each micro-batch as they come
(``streaming.jobs.partials_to_table``): late rows count, no state is kept, and a
reader sums what it finds for a key.  A 7-day mean then reads 168 rows a series
at most, times the batches that touched an hour until they are compacted.

A window whose start lies within a bucket takes the rest of that bucket from
the raw rows (``window_partials``), so results equal the scan of all rows, but
for the last digits of sums of doubles.  Distinct addresses are
HyperLogLog sketches: sketches of any hours union to the sketch of all their
rows, with a relative error of about 0.8 / sqrt(2 ** LG_K).
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import auth
from fleetscope.operators.security import failed_logins
from fleetscope.operators.series import SERIES, bucket_start, to_dt, ts_lit

HOUR_MIN = 60
#: Sketches have 2 ** LG_K registers: a relative error of 1.3 % at one deviation.
LG_K = 12


def metric_partials(metrics: DataFrame, minutes: int = HOUR_MIN) -> DataFrame:
    """(series, bucket, n, total) per epoch-aligned bucket.  Rows without a value
    or an instant count nowhere."""
    return (metrics.filter(F.col("value").isNotNull() & F.col("ts").isNotNull()).groupBy(*SERIES, bucket_start("ts", minutes).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


def login_partials(logs: DataFrame, minutes: int = HOUR_MIN, lg_k: int = LG_K) -> DataFrame:
    """(server_id, bucket, attempts, ips): failed logins and the sketch of their
    addresses.  No address ('') is a value of its own, as in the exact count; a
    sketch skips empty strings, hence the mark before each."""
    ip = F.concat(F.lit("="), auth.attacker_ip("line"))
    return (failed_logins(logs).filter(F.col("ts").isNotNull()).groupBy("server_id", bucket_start("ts", minutes).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("attempts"), F.hll_sketch_agg(ip, lg_k).alias("ips")))


def first_whole(start: datetime, minutes: int) -> datetime:
    """The first bucket that does not begin before ``start``."""
    width = timedelta(minutes=minutes)
    return start + (-(start - datetime(1970, 1, 1)) % width)


def window_partials(partials: DataFrame, raw: DataFrame, start: datetime, minutes: int, reduce) -> DataFrame:
    """The partials of all rows from ``start`` on: stored whole buckets, and
    ``reduce`` (the function that made them) of the raw rows before the first
    of these.  The raw scan is bounded on both sides and less than one bucket."""
    whole = first_whole(start, minutes)
    stored = partials.filter(F.col("bucket") >= ts_lit(whole))
    if whole == start:
        return stored
    rest = reduce(raw.filter((F.col("ts") >= ts_lit(start)) & (F.col("ts") < ts_lit(whole))))
    return stored.select(*rest.columns).unionByName(rest)


def baseline(partials: DataFrame, metrics: DataFrame, as_of, days: int = 7, minutes: int = HOUR_MIN) -> DataFrame:
    """A4 from partials."""
    p = window_partials(partials, metrics, to_dt(as_of) - timedelta(days=days), minutes,
                        lambda m: metric_partials(m, minutes))
    return p.groupBy(*SERIES).agg((F.sum("total") / F.sum("n")).alias("baseline"))


def sparkline_buckets(partials: DataFrame, metrics: DataFrame, as_of, minutes: int = 60, points: int = 30,
                      stored_minutes: int = 1) -> DataFrame:
    """W4 (tall form) from partials whose width divides the sparkline's."""
    width = max(1, minutes // points)
    if width % stored_minutes:
        raise ValueError("the stored buckets must divide the sparkline's")
    p = window_partials(partials, metrics, to_dt(as_of) - timedelta(minutes=minutes), stored_minutes,
                        lambda m: metric_partials(m, stored_minutes))
    return (p.groupBy(*SERIES, bucket_start("bucket", width).alias("bucket"))
            .agg((F.sum("total") / F.sum("n")).alias("avg_value")))


def ssh_baseline(partials: DataFrame, logs: DataFrame, servers: DataFrame, as_of, days: int = 7,
                 minutes: int = HOUR_MIN) -> DataFrame:
    """A9 from partials: mean over the days that have failed logins; a server
    without any has 0.0.  ``minutes`` must divide a day."""
    p = window_partials(partials.drop("ips"), logs, to_dt(as_of) - timedelta(days=days), minutes,
                        lambda x: login_partials(x, minutes).drop("ips"))
    daily = p.groupBy("server_id", F.date_trunc("day", "bucket").alias("day")).agg(F.sum("attempts").alias("n"))
    mean = daily.groupBy("server_id").agg(F.avg("n").alias("avg_daily"))
    return (servers.select("server_id").distinct().join(mean, "server_id", "left")
            .select("server_id", F.coalesce("avg_daily", F.lit(0.0)).alias("avg_daily")))


def unique_ips(partials: DataFrame, logs: DataFrame, servers: DataFrame, as_of, hours: int = 24,
               minutes: int = HOUR_MIN, lg_k: int = LG_K) -> DataFrame:
    """A5 and A6 from partials: failed logins (exact) and distinct addresses
    (estimate of the united sketches) of the last hours; quiet servers have 0."""
    p = window_partials(partials, logs, to_dt(as_of) - timedelta(hours=hours), minutes,
                        lambda x: login_partials(x, minutes, lg_k))
    per = p.groupBy("server_id").agg(F.sum("attempts").alias("attempts"), F.hll_sketch_estimate(F.hll_union_agg("ips")).alias("unique_ips"))
    return (servers.select("server_id").distinct().join(per, "server_id", "left")
            .select("server_id", F.coalesce("attempts", F.lit(0)).cast("long").alias("attempts"),
                    F.coalesce("unique_ips", F.lit(0)).cast("long").alias("unique_ips")))
