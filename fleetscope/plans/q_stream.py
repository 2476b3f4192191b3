"""Registered batch forms of the streaming operators."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetscope.operators import features
from fleetscope.plans.catalog import AS_OF, AS_OF_FAST, AS_OF_FAST_TS, AS_OF_TS, register
from fleetscope.plans.q_alerts import _REPLAY_SQL
from fleetscope.plans.q_ingest import _PAYLOAD_SQL, metric_payloads
from fleetscope.plans.q_ml import _online_sql
from fleetscope.plans.q_series import _FEATURES_SQL, scores
from fleetscope.sources import bindings as B
from fleetscope.sources import manifest, segments
from fleetscope.session import scratch
from fleetscope.streaming import alert_processor, jobs, score_writer

CUT = AS_OF_FAST_TS - timedelta(minutes=30)     # features already stored before this instant
CUT_SQL = f"({AS_OF_FAST} - INTERVAL 30 MINUTE)"


@register("R2_incremental_features", f"""
, fullf AS ({_FEATURES_SQL}),
wm AS (SELECT server_id, metric_name, max(ts) AS watermark FROM fullf WHERE ts < {CUT_SQL} GROUP BY ALL)
SELECT f.* FROM fullf f JOIN wm USING (server_id, metric_name) WHERE f.ts > wm.watermark""")
def r2(spark, d):
    m = B.metrics_fast(spark, d)
    stored = features.compute_features(m.filter(F.col("ts") < F.lit(CUT.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")))
    return features.incremental_features(m, stored, AS_OF_FAST_TS)


@register("R7_heartbeat_gaps", """
, g AS (SELECT server_id, "timestamp",
               lag("timestamp") OVER (PARTITION BY server_id ORDER BY "timestamp") AS prev
        FROM heartbeat_messages)
SELECT server_id, prev AS last_seen, prev + INTERVAL 90 SECOND AS offline_at, "timestamp" AS back_online_at
FROM g WHERE epoch_us("timestamp") - epoch_us(prev) > 90000000""")
def r7(spark, d):
    return jobs.heartbeat_gaps(B.heartbeat_messages(spark, d))


@register("R8_tumbling_buckets", """
SELECT server_id, metric_name, make_timestamp((epoch_us(ts) // 120000000) * 120000000) AS bucket_start,
       avg(value) AS avg_value, count(*) AS n
FROM metrics_fast GROUP BY ALL""")
def r8(spark, d):
    out = jobs.bucket_counts(B.metrics_fast(spark, d), 2)
    return out.select("server_id", "metric_name", F.col("bucket.start").alias("bucket_start"), "avg_value", "n")


@register("R7_heartbeat_gaps_event_clock", """
, g AS (SELECT 'srv-' || CAST(user_id % 5 AS VARCHAR) AS server_id, ts AS "timestamp",
               lag(ts) OVER (PARTITION BY user_id % 5 ORDER BY ts) AS prev
        FROM events)
SELECT server_id, prev AS last_seen, prev + INTERVAL 90 SECOND AS offline_at, "timestamp" AS back_online_at
FROM g WHERE epoch_us("timestamp") - epoch_us(prev) > 90000000""")
def r7_raw(spark, d):
    return jobs.heartbeat_gaps(B.heartbeat_messages(spark, d, clock="raw"))


def as_stream(df, path):
    """A table as a file stream: written to ``path`` and read from there."""
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


@register("R3_R4_S5_alert_stream", _REPLAY_SQL, recursive=True)
def r3_stream(spark, d):
    """The stateful evaluator over the tables as streams; a sample of an unknown
    server an hour later moves the watermark past the last tick."""
    path = scratch(spark, "alert-stream")
    end = (F.lit(AS_OF_FAST_TS.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp") + F.expr("INTERVAL 1 HOUR")).alias("ts")
    last = lambda c: spark.range(1).select(F.lit("-").alias("server_id"), F.lit("-").alias("metric_name"), end, F.lit(0.0).alias(c))
    m = B.metrics_fast(spark, d).select("server_id", "metric_name", "ts", "value").union(last("value"))
    s = scores(spark, d).select("server_id", "metric_name", "ts", "score").union(last("score"))
    beats = B.heartbeats(spark, d).filter(F.col("server_id") != "srv-3").select("server_id", "timestamp", "agent_version")
    signal = alert_processor.signals(as_stream(m, f"{path}/metrics"), as_stream(s, f"{path}/scores"),
                                     as_stream(B.alert_rules(spark, d), f"{path}/rules"), as_stream(beats, f"{path}/beats"))
    alert_processor.alerts_to_table(signal, f"{path}/events", f"{path}/checkpoint", every_s=None).awaitTermination()
    until = F.lit(AS_OF_FAST_TS.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")
    return spark.read.parquet(f"{path}/events").filter(F.col("triggered_at") <= until).drop("batch")


@register("R5_online_score_stream", _online_sql())
def r5_stream(spark, d):
    """The score writer over the samples as a stream, read back from its table."""
    path = scratch(spark, "score-stream")
    samples = as_stream(B.metrics_fast(spark, d).select("server_id", "metric_name", "ts", "value"), f"{path}/metrics")
    score_writer.scores_to_table(samples, f"{path}/scores", f"{path}/checkpoint", every_s=None).awaitTermination()
    return spark.read.parquet(f"{path}/scores").select("server_id", "metric_name", "ts", "score")


@register("S1_segment_stream", _PAYLOAD_SQL + """
SELECT server_id, metric_name, value, ts FROM parsed
WHERE server_id IS NOT NULL AND metric_name IS NOT NULL AND value IS NOT NULL AND ts IS NOT NULL""")
def s1_stream(spark, d):
    """Payloads as segments, streamed to the metrics table in batches of at most
    20 000 messages a core: planning and commits cost each batch about a second,
    so there are no more of them than the cores need."""
    path = scratch(spark, "segments")
    metric_payloads(spark, d).select("data").write.text(f"{path}/segments")
    rows = 20_000 * spark.sparkContext.defaultParallelism
    raw = segments.stream(spark, f"{path}/segments", start="oldest", rows=rows).select("data")
    q = jobs.metrics_to_table(raw, f"{path}/metrics", f"{path}/dead", f"{path}/checkpoint", trigger_s=0)
    q.processAllAvailable()
    q.stop()
    return spark.read.parquet(f"{path}/metrics").select("server_id", "metric_name", "value", "ts")


@register("S6_S7_S9_S15_versioned_table", f"""
SELECT CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS day, server_id, count(*) AS n, sum(value) AS total FROM metrics
WHERE ts > {AS_OF} - INTERVAL 10 DAY GROUP BY ALL""")
def s6_versions(spark, d):
    """Samples appended day by day, compacted, expired and read again."""
    table = manifest.ManifestTable(spark, scratch(spark, "versions"))
    m = B.metrics(spark, d).select("server_id", "metric_name", "ts", "value")
    for i in range(4):
        manifest.append_rows(table, m.filter(F.dayofmonth("ts") % 4 == i), "ts", ["server_id", "metric_name"], "days", i)
    table.compact(["server_id", "metric_name", "ts"])
    manifest.retain(table, AS_OF_TS - timedelta(days=10))
    table.vacuum()
    return table.read().groupBy(F.date_format("ts", "yyyyMMdd").cast("long").alias("day"), "server_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@register("S5_streamed_upsert", """
SELECT server_id, "timestamp", agent_version FROM heartbeats""")
def s5_stream(spark, d):
    """Heartbeats as a stream of four batches in order of arrival, merged into
    the latest-state table."""
    path = scratch(spark, "latest")
    msgs = B.heartbeat_messages(spark, d)
    payload = F.to_json(F.struct("server_id", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
                                 "agent_version", "watched_logs", "inventory")).alias("data")
    table = manifest.ManifestTable(spark, f"{path}/table", "bucket")
    for i in range(4):          # arrival order is time order here: a slice of arrivals a batch
        part = msgs.withColumn("_n", F.ntile(4).over(Window.partitionBy("server_id").orderBy("arrival_seq"))).filter(F.col("_n") == i + 1)
        part.select(payload).write.mode("append").text(f"{path}/beats")
        jobs.heartbeats_to_latest(jobs.json_lines(spark, f"{path}/beats", 10_000), table, f"{path}/checkpoint", None).awaitTermination()
    return table.read().select("server_id", "timestamp", "agent_version")
