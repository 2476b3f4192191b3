"""Login-attack statistics for the whole fleet (A5-A9, A19, A21, T3, T5,
F1, F17-F19, H2, H3).

Counts come from conditional aggregation over the failed-login lines of the
operator's own time range.  Which servers get a row is given by ``servers``
(the heartbeat table, say); without it, by the log lines of that range.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.functions import auth
from fleetscope.functions.logtext import utc_iso
from fleetscope.operators.dedup import newest_n
from fleetscope.operators.series import since, to_dt, ts_lit


def failed_logins(logs: DataFrame) -> DataFrame:
    """P4 applied to auth.log."""
    return logs.filter((F.col("log_file") == auth.AUTH_LOG) & auth.failed_login("line"))


def servers_of(logs: DataFrame, servers: DataFrame | None = None) -> DataFrame:
    return (logs if servers is None else servers).select("server_id").distinct()


def ssh_stats(logs: DataFrame, as_of, approx_ips: bool = False, servers: DataFrame | None = None) -> DataFrame:
    """A5 + A6 + T3: attempts in 1 h and 24 h, distinct attacker IPs in 24 h
    ('' counts as a value), top target user in 24 h (ties alphabetical).
    Every server gets a row (zeros when quiet).  ``approx_ips``
    swaps the exact distinct count for a HyperLogLog sketch (fixed-size
    per-server state, no per-IP shuffle)."""
    f = (failed_logins(logs).filter(since(as_of, hours=24))
         .select("server_id", "ts", auth.attacker_ip("line").alias("ip"),
                 auth.target_user("line").alias("u")))
    counts = f.groupBy("server_id").agg(
        F.count_if(since(as_of, hours=1)).alias("attempts_1h"),
        F.count(F.lit(1)).alias("attempts_24h"),
        (F.approx_count_distinct("ip") if approx_ips else F.count_distinct("ip")).alias("unique_ips_24h"))
    per_user = (f.filter(F.col("u").isNotNull() & (F.col("u") != ""))
                .groupBy("server_id", "u").agg(F.count(F.lit(1)).alias("cnt")))
    top = per_user.groupBy("server_id").agg(
        F.min_by("u", F.struct((-F.col("cnt")).alias("c"), F.col("u").alias("n"))).alias("top_target"))
    return (servers_of(logs, servers).join(counts, "server_id", "left").join(top, "server_id", "left")
            .select("server_id",
                    F.coalesce("attempts_1h", F.lit(0)).cast("long").alias("attempts_1h"),
                    F.coalesce("attempts_24h", F.lit(0)).cast("long").alias("attempts_24h"),
                    F.coalesce("unique_ips_24h", F.lit(0)).cast("long").alias("unique_ips_24h"),
                    "top_target"))


def attackers(logs: DataFrame, as_of, top: int = 20, block_after_s: int = 1800) -> DataFrame:
    """Attacker IPs of the last 24 h per server: attempts, distinct
    target users (sorted), last seen, blocked flag; top 20 by attempts
    (ties by IP).  Counts are reduced map-side first; users are collected
    only for the IPs that make the top list."""
    f = (failed_logins(logs).filter(since(as_of, hours=24))
         .select("server_id", "ts", auth.attacker_ip("line").alias("ip"),
                 auth.target_user("line").alias("u"))
         .filter(F.col("ip") != ""))
    per_ip = f.groupBy("server_id", "ip").agg(F.count(F.lit(1)).alias("attempts"),
                                              F.max("ts").alias("last_seen"))
    w = Window.partitionBy("server_id").orderBy(F.col("attempts").desc(), F.col("ip"))
    ranked = per_ip.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    users = (f.join(ranked.select("server_id", "ip"), ["server_id", "ip"], "left_semi")
             .filter(F.col("u").isNotNull() & (F.col("u") != ""))
             .groupBy("server_id", "ip").agg(F.array_sort(F.collect_set("u")).alias("users")))
    elapsed = F.unix_timestamp(ts_lit(as_of)) - F.unix_timestamp("last_seen")
    return (ranked.join(users, ["server_id", "ip"], "left")
            .select("server_id", "rank", "ip", "attempts",
                    F.coalesce("users", F.array().cast("array<string>")).alias("users"),
                    "last_seen", (elapsed > block_after_s).alias("blocked"),
                    auth.attacker_severity("attempts").alias("severity"),
                    auth.is_private_ip("ip").alias("private")))


def attacker_users(logs: DataFrame, as_of) -> DataFrame:
    """(server, ip, user, attempts) of the last 24 h: the users that an address
    tried, as rows; an address that sprays millions of names is many rows, and
    the array of ``attackers`` is the view for a dashboard."""
    f = (failed_logins(logs).filter(since(as_of, hours=24))
         .select("server_id", auth.attacker_ip("line").alias("ip"), auth.target_user("line").alias("user")))
    return (f.filter((F.col("ip") != "") & F.col("user").isNotNull() & (F.col("user") != ""))
            .groupBy("server_id", "ip", "user").agg(F.count(F.lit(1)).alias("attempts")))


def attack_by_hour(logs: DataFrame, as_of, servers: DataFrame | None = None) -> DataFrame:
    """A8 + J9: failed logins per UTC hour since the start of as_of's day, 24
    dense buckets per server (generated per server, no cross join)."""
    day0 = F.date_trunc("day", ts_lit(as_of))
    f = failed_logins(logs).filter(F.col("ts") >= day0)
    counts = f.groupBy("server_id", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("count"))
    spine = servers_of(logs, servers).select("server_id", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return (spine.join(counts, ["server_id", "hour"], "left")
            .select("server_id", "hour", F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def ssh_baseline(logs: DataFrame, as_of, days: int = 7, servers: DataFrame | None = None) -> DataFrame:
    """Mean of the daily failed-login counts over 7 days; only days with
    attempts enter the mean; none -> 0.0."""
    daily = (failed_logins(logs).filter(since(as_of, days=days))
             .groupBy("server_id", F.date_trunc("day", "ts").alias("day"))
             .agg(F.count(F.lit(1)).alias("n")))
    avg = daily.groupBy("server_id").agg(F.avg("n").alias("avg_daily"))
    return (servers_of(logs, servers).join(avg, "server_id", "left")
            .select("server_id", F.coalesce("avg_daily", F.lit(0.0)).alias("avg_daily")))


def ssh_events(logs: DataFrame, lines: int = 200) -> DataFrame:
    """H2 (events half): the newest 200 auth.log lines per server, classified
    (F1); unmatched lines are dropped."""
    tail = newest_n(logs.filter(F.col("log_file") == auth.AUTH_LOG), ["server_id", "log_file"], "ts", lines,
                    tiebreak=["seq"] if "seq" in logs.columns else None)
    c = tail.withColumn("_c", auth.classify("line")).filter(F.col("_c").isNotNull())
    return c.select("server_id", "ts", utc_iso("ts").alias("timestamp"),
                    "_c.type", "_c.action", "_c.username", "_c.source_ip", "_c.result")


def peak_hour(by_hour: DataFrame) -> DataFrame:
    """Hour with most attempts, ties to the smallest hour."""
    return by_hour.groupBy("server_id").agg(
        F.max_by(F.struct("hour", "count"), F.struct(F.col("count"), (-F.col("hour")))).alias("_p")
    ).select("server_id", F.col("_p.hour").alias("peak_hour"), F.col("_p.count").alias("peak_count"))


def threat_summary(logs: DataFrame, as_of, day_of=None, servers: DataFrame | None = None, days: int = 7) -> DataFrame:
    """H3: today (24 h attempts) vs 7-day daily baseline; ratio (0 when no
    baseline), state (>2.5 critical, >1.5 attention), dashboard band
    (>2 critical, >1.3 attention), peak hour, hours over 2x the hourly
    baseline.

    The lines of the range are read once and counted per (server, hour); all
    figures are sums over that small table."""
    day0 = F.date_trunc("day", ts_lit(day_of or as_of))
    start = min(to_dt(as_of) - timedelta(days=days), to_dt(day_of or as_of).replace(hour=0, minute=0, second=0, microsecond=0))
    hourly = (failed_logins(logs).filter(F.col("ts") >= ts_lit(start))
              .groupBy("server_id", F.date_trunc("hour", "ts").alias("at"))
              .agg(F.count_if(since(as_of, hours=24)).alias("n24"), F.count_if(since(as_of, days=days)).alias("n7"),
                   F.count_if(F.col("ts") >= day0).alias("today")))
    daily = (hourly.where("n7 > 0").groupBy("server_id", F.date_trunc("day", "at").alias("day")).agg(F.sum("n7").alias("n"))
             .groupBy("server_id").agg(F.avg("n").alias("avg_daily")))
    by_hour = (hourly.where("today > 0").groupBy("server_id", F.hour("at").alias("hour")).agg(F.sum("today").alias("count")))
    counts = hourly.groupBy("server_id").agg(F.sum("n24").alias("today"))
    hours = by_hour.groupBy("server_id").agg(F.array_agg(F.struct("hour", "count")).alias("hours"))     # 24 at most
    x = (servers_of(logs, servers).join(counts, "server_id", "left").join(daily, "server_id", "left")
         .join(hours, "server_id", "left")
         .select("server_id", F.coalesce("today", F.lit(0)).cast("long").alias("today"),
                 F.coalesce("avg_daily", F.lit(0.0)).alias("avg_daily"), "hours"))
    ratio = F.when(F.col("avg_daily") > 0, F.col("today") / F.col("avg_daily")).otherwise(F.lit(0.0))
    per_hour = F.col("avg_daily") / 24.0
    # hours without attempts count zero: the first of the largest counts is the peak
    peak = F.array_max(F.transform(F.coalesce("hours", F.array().cast("array<struct<hour:int,count:bigint>>")),
                                   lambda h: F.struct(h["count"].alias("count"), (-h["hour"]).alias("late"))))
    peak_count = F.coalesce(peak["count"], F.lit(0)).cast("long")
    over = F.size(F.filter(F.coalesce("hours", F.array().cast("array<struct<hour:int,count:bigint>>")),
                           lambda h: h["count"] > per_hour * 2)).cast("long")
    return x.select("server_id", "today", F.col("avg_daily").alias("baseline"), ratio.alias("ratio"),
                    F.when(ratio > 2.5, "critical").when(ratio > 1.5, "attention").otherwise("ok").alias("state"),
                    F.when(ratio > 2, "critical").when(ratio > 1.3, "attention").otherwise("ok").alias("band"),
                    F.coalesce(-peak["late"], F.lit(0)).alias("peak_hour"), peak_count.alias("peak_count"),
                    over.alias("hours_over_baseline"),
                    F.greatest(peak_count.cast("double"), per_hour, F.lit(1.0)).alias("bar_scale"))


def hourly_bars(logs: DataFrame, as_of, day_of=None, servers: DataFrame | None = None) -> DataFrame:
    """per hour bar percent of max(count, hourly baseline, 1) and the
    over-2x-baseline flag."""
    day_of = day_of or as_of
    hours = attack_by_hour(logs, day_of, servers)
    bl = ssh_baseline(logs, as_of, servers=servers).withColumn("per_hour", F.col("avg_daily") / 24.0)
    w = Window.partitionBy("server_id")
    x = hours.join(bl, "server_id")
    scale = F.greatest(F.max("count").over(w).cast("double"), F.col("per_hour"), F.lit(1.0))
    return x.select("server_id", "hour", "count", (F.col("count") / scale * 100).alias("pct"),
                    (F.col("count") > F.col("per_hour") * 2).alias("over"))


def attacker_totals(att: DataFrame) -> DataFrame:
    """Total attempts and attacker count over the top list."""
    return att.groupBy("server_id").agg(F.sum("attempts").alias("total_attempts"),
                                        F.count(F.lit(1)).alias("attackers"))

