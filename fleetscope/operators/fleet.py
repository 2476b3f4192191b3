"""Fleet health: server status, health snapshot, fleet overview
(F7-F9, F13, F15, F16, F25, F26, H1, H5, J7, J10, A16-A18, P8, P9, P11, T6, T7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.operators import series as S
from fleetscope.operators.series import THRESHOLDS, since, ts_lit

# ---- fixed values: health rules -------------------------------------------
ATTENTION = {"cpu_usage_percent": 68.0, "memory_usage_percent": 76.0, "disk_usage_percent": 80.0}
SHORT = {"cpu_usage_percent": "cpu", "memory_usage_percent": "mem", "disk_usage_percent": "disk"}
OFFLINE_AFTER_S = 90
RUNTIME_STATUSES = ["n/a", "unknown"]
# -----------------------------------------------------------------------------


def server_status(heartbeats: DataFrame, as_of, offline_after_s: int = OFFLINE_AFTER_S) -> DataFrame:
    """F7 / R7 (batch): unknown without a parseable last_seen, online when
    the last heartbeat is at most 90 s old, else offline."""
    last = F.col("timestamp")
    age = (F.unix_micros(ts_lit(as_of)) - F.unix_micros(last)) / 1e6
    status = (F.when(last.isNull(), F.lit("unknown"))
              .when(age <= offline_after_s, F.lit("online")).otherwise(F.lit("offline")))
    return heartbeats.select("server_id", status.alias("status"), last.alias("last_seen"), "agent_version")


def critical_services(heartbeats: DataFrame) -> DataFrame:
    """Per inventory entry its name and ok = (status == 'active')."""
    return heartbeats.select(
        "server_id",
        F.transform(F.coalesce("inventory", F.array()), lambda e: F.struct(
            e["name"].alias("name"), (F.coalesce(e["status"], F.lit("")) == "active").alias("ok")))
        .alias("services"))


def inventory(heartbeats: DataFrame) -> DataFrame:
    """P11 + P8: one row per inventory entry with its kind (runtime when
    status is 'n/a' or 'unknown', else daemon)."""
    x = heartbeats.select("server_id", F.explode("inventory").alias("e")).select("server_id", "e.*")
    return x.withColumn("kind", F.when(F.col("status").isin(*RUNTIME_STATUSES), "runtime").otherwise("daemon"))


def metric_health(values: DataFrame, baselines: DataFrame, as_of_values, as_of_baseline,
                  points: int = 30, minutes: int = 60) -> DataFrame:
    """Value (5-min max), baseline (7-day mean, 1 digit), sparkline,
    trend and projection for cpu / memory / disk, pivoted to one row per
    server.  Values and sparkline come from one scan with two-level
    aggregation (bucket partials, then per series)."""
    names = list(THRESHOLDS)
    width = max(1, minutes // points)
    v = values.filter(F.col("metric_name").isin(*names) & since(as_of_values, minutes))
    five = since(as_of_values, 5)
    buckets = (v.groupBy("server_id", "metric_name", S.bucket_start("ts", width).alias("bucket"))
               .agg(F.avg("value").alias("avg_value"), F.max(F.when(five, F.col("value"))).alias("max5")))
    per = (buckets.groupBy("server_id", "metric_name")
           .agg(F.max("max5").alias("value"),
                F.array_sort(F.collect_list(F.struct("bucket", F.bround("avg_value", 1).alias("v")))).alias("_pts"))
           .withColumn("spark", F.transform("_pts", lambda p: p["v"])).drop("_pts"))
    base = (baselines.filter(F.col("metric_name").isin(*names))
            .transform(lambda b: S.baseline(b, as_of_baseline, 7))
            .withColumn("baseline", F.bround("baseline", 1)))
    per = per.join(base, ["server_id", "metric_name"], "full")
    aggs = []
    for name, short in SHORT.items():
        m = F.col("metric_name") == name
        aggs += [F.max(F.when(m, F.col("value"))).alias(f"{short}_value"),
                 F.max(F.when(m, F.col("baseline"))).alias(f"{short}_baseline"),
                 F.first(F.when(m, F.col("spark")), ignorenulls=True).alias(f"{short}_spark")]
    wide = per.groupBy("server_id").agg(*aggs)
    for short in SHORT.values():
        sp = F.coalesce(F.col(f"{short}_spark"), F.array().cast("array<double>"))
        wide = wide.withColumn(f"{short}_spark", sp).withColumn(f"{short}_trend", S.trend(sp))
    return wide.withColumn("mem_projection", S.projection("mem_value", "mem_spark",
                                                          THRESHOLDS["memory_usage_percent"]))


def _pos(c: str) -> Column:
    # the reference tests these with Python truthiness: NULL and 0 are "no value"
    return F.coalesce(F.col(c), F.lit(0.0))


def health_state() -> Column:
    """F8."""
    cpu, mem, disk = _pos("cpu_value"), _pos("mem_value"), _pos("disk_value")
    rising = (F.col("mem_trend") == "up") & F.col("mem_projection").isNotNull()
    return (F.when(F.col("cpu_value").isNull() & F.col("mem_value").isNull(), F.lit("critical"))
            .when((cpu >= 80) | (mem >= 90) | (disk >= 95), F.lit("critical"))
            .when(rising, F.lit("attention"))
            .when((cpu >= 68) | (mem >= 76) | (disk >= 80), F.lit("attention"))
            .otherwise(F.lit("ok")))


def _whole(c: Column) -> Column:
    return F.format_string("%d", F.bround(c, 0).cast("long"))


def headline() -> Column:
    """seven-way precedence; 0 counts as missing, like the reference."""
    cpu, mem = _pos("cpu_value"), _pos("mem_value")
    base = _pos("cpu_baseline")
    n = F.col("anomalies6h")
    rising = (F.col("mem_trend") == "up") & F.col("mem_projection").isNotNull()
    return (F.when(F.col("cpu_value").isNull(), F.lit("offline — no metric collection."))
            .when(rising, F.concat(F.lit("memory rising — projected "), F.col("mem_projection")))
            .when((F.col("state") == "critical") & (cpu >= 80),
                  F.concat(F.lit("CPU critical at "), _whole(cpu), F.lit("%.")))
            .when((F.col("state") == "critical") & (mem >= 90),
                  F.concat(F.lit("memory critical at "), _whole(mem), F.lit("%.")))
            .when((base != 0) & (cpu != 0) & (cpu > base * 1.10),
                  F.concat(F.lit("CPU "), _whole(cpu - base), F.lit("pp above average.")))
            .when(n > 0, F.concat(n.cast("string"), F.lit(" anomal"),
                                  F.when(n != 1, F.lit("ies")).otherwise(F.lit("y")),
                                  F.lit(" in the last 6h.")))
            .otherwise(F.lit("all within expected range.")))


def health_snapshot(values: DataFrame, baselines: DataFrame, scores: DataFrame, heartbeats: DataFrame,
                    as_of_values, as_of_baseline) -> DataFrame:
    """H1: one snapshot row per server with a heartbeat."""
    mh = metric_health(values, baselines, as_of_values, as_of_baseline)
    an = S.anomaly_count(scores, as_of_values, 6)
    sv = critical_services(heartbeats)
    x = (heartbeats.select("server_id").join(mh, "server_id", "left")
         .join(an, "server_id", "left").join(sv, "server_id", "left")
         .withColumn("anomalies6h", F.coalesce("anomalies6h", F.lit(0)).cast("long")))
    for short in SHORT.values():
        x = x.withColumn(f"{short}_spark", F.coalesce(f"{short}_spark", F.array().cast("array<double>")))
        x = x.withColumn(f"{short}_trend", F.coalesce(f"{short}_trend", F.lit("stable")))
    x = x.withColumn("state", health_state())
    x = x.withColumn("headline", headline())
    for name, short in SHORT.items():
        x = x.withColumn(f"{short}_threshold", F.lit(THRESHOLDS[name]))
    return x


def baseline_delta(value: Column | str, baseline: Column | str, invert: bool = False) -> Column:
    """struct(delta, sign, tone) with a neutral band of 5 % of the
    baseline; NULL when either side is missing."""
    v = F.col(value) if isinstance(value, str) else value
    b = F.col(baseline) if isinstance(baseline, str) else baseline
    d = v - b
    bad = (d < 0) if invert else (d > 0)
    tone = F.when(F.abs(d) < b * 0.05, "neutral").when(bad, "bad").otherwise("good")
    return F.when(v.isNotNull() & b.isNotNull(), F.struct(
        d.alias("delta"), F.when(d > 0, F.lit("+")).otherwise(F.lit("")).alias("sign"), tone.alias("tone")))


def card_severity(value: Column | str, amber: float, red: float) -> Column:
    """F15."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v >= red, "red").when(v >= amber, "amber").otherwise("green")


def near_threshold(value: Column | str, threshold: Column | str) -> Column:
    """F16: value >= 0.9 x threshold."""
    v = F.col(value) if isinstance(value, str) else value
    t = F.col(threshold) if isinstance(threshold, str) else threshold
    return v >= t * 0.9


def rising_flag(trend: Column | str, value: Column | str, baseline: Column | str) -> Column:
    """up and above 1.05 x baseline -> bad; down -> good; else neutral."""
    t = F.col(trend) if isinstance(trend, str) else trend
    v = F.col(value) if isinstance(value, str) else value
    b = F.col(baseline) if isinstance(baseline, str) else baseline
    return (F.when((t == "up") & (v > b * 1.05), "bad").when(t == "down", "good").otherwise("neutral"))


def fleet_overview(snapshot: DataFrame, status: DataFrame, scores: DataFrame, as_of_values) -> DataFrame:
    """H5: one row for the fleet: state counts (servers without a snapshot
    count as 'quiet'), headline, anomaly total, focus server (first critical
    with a live CPU value, else first attention, else first server), primary
    server (first online) and the focus server's most severe CPU anomaly of
    the last 6 h (ties -> earliest).  "First" follows server_id order."""
    fleet = status.select("server_id", "status").join(
        snapshot.select("server_id", "state", "cpu_value", "anomalies6h"), "server_id", "left")
    fleet = fleet.withColumn("state", F.coalesce("state", F.lit("quiet")))
    # worst CPU anomaly of the last 6 h per server (ties -> earliest); the
    # focus server's one is picked by the same ordering that picks the server
    cpu = scores.filter((F.col("metric_name") == "cpu_usage_percent") & since(as_of_values, hours=6))
    worst = cpu.groupBy("server_id").agg(
        F.max_by(F.struct("ts", "score"), F.struct(F.col("score"), -F.unix_micros("ts"))).alias("_w"))
    fleet = fleet.join(worst, "server_id", "left")
    prio = (F.when((F.col("state") == "critical") & F.col("cpu_value").isNotNull(), F.lit(0))
            .when(F.col("state") == "attention", F.lit(1)).otherwise(F.lit(2)))
    focus_order = F.struct(prio, F.col("server_id"))
    agg = fleet.agg(
        F.count_if(F.col("state") == "critical").alias("critical"),
        F.count_if(F.col("state") == "attention").alias("attention"),
        F.count_if(F.col("state") == "ok").alias("ok"),
        F.count_if(F.col("state") == "quiet").alias("quiet"),
        F.coalesce(F.sum("anomalies6h"), F.lit(0)).cast("long").alias("anomalies6h_total"),
        F.min_by("server_id", focus_order).alias("focus_server"),
        F.min_by("_w", focus_order).alias("_fw"),
        F.min_by(F.when(F.col("status") == "online", F.col("server_id")),
                 F.struct(F.col("status") != "online", F.col("server_id"))).alias("primary_server"))
    text = (F.when(F.col("critical") > 0, F.format_string("%d server(s) critical", F.col("critical")))
            .when(F.col("attention") > 0, F.format_string("%d ok, %d need attention", F.col("ok"), F.col("attention")))
            .otherwise(F.lit("all systems nominal")))
    return agg.select("critical", "attention", "ok", "quiet", "anomalies6h_total", text.alias("headline"),
                      "focus_server", "primary_server", F.col("_fw.ts").alias("most_severe_ts"),
                      F.col("_fw.score").alias("most_severe_score"))
