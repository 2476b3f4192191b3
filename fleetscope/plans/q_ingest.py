"""Registered ingestion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.functions import logtext
from fleetscope.plans.catalog import AS_OF_TS, AS_OF, register
from fleetscope.sources import bindings as B
from fleetscope.sources import ingest as I


def metric_payloads(spark, d):
    """Agent JSON payloads built from the events: every 5th timestamp in a
    -04:00 offset, every 7th value as a string, every 11th without tags,
    every 97th without server_id, every 89th not JSON at all."""
    e = B.events(spark, d)
    ts = F.col("ts").cast("timestamp")
    iso_z = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    iso_off = F.concat(F.date_format(ts - F.expr("INTERVAL 4 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
                       F.lit("-04:00"))
    tstr = F.when(F.col("event_id") % 5 == 1, iso_off).otherwise(iso_z)
    v = F.format_string("%.2f", "value")
    vstr = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('"'), v, F.lit('"'))).otherwise(v)
    tags = F.when(F.col("event_id") % 11 == 0, F.lit("null")).otherwise(
        F.concat(F.lit('{"k": "'), F.get_json_object("props", "$.k"), F.lit('"}')))
    server = F.when(F.col("event_id") % 97 == 0, F.lit("")).otherwise(
        F.concat(F.lit('"server_id": "srv-'), (F.col("user_id") % 5).cast("string"), F.lit('", ')))
    body = F.concat(F.lit("{"), server, F.lit('"metric_name": "'), F.col("event_type"),
                    F.lit('_total", "value": '), vstr, F.lit(', "timestamp": "'), tstr,
                    F.lit('", "tags": '), tags, F.lit("}"))
    data = F.when(F.col("event_id") % 89 == 0, F.lit("not json")).otherwise(body)
    return e.select(F.col("event_id"), data.alias("data"))


_PAYLOAD_SQL = r"""
, pl AS (SELECT event_id, user_id, event_type, value, ts, props FROM events),
parsed AS (SELECT event_id,
    CASE WHEN event_id % 89 = 0 OR event_id % 97 = 0 THEN NULL ELSE 'srv-' || CAST(user_id % 5 AS VARCHAR) END AS server_id,
    CASE WHEN event_id % 89 = 0 THEN NULL ELSE event_type || '_total' END AS metric_name,
    CASE WHEN event_id % 89 = 0 THEN NULL ELSE CAST(printf('%.2f', value) AS DOUBLE) END AS value,
    CASE WHEN event_id % 89 = 0 THEN NULL ELSE ts END AS ts
  FROM pl)"""


@register("S1_S2_parse_metric_json", _PAYLOAD_SQL + """
SELECT server_id, metric_name, value, ts FROM parsed
WHERE server_id IS NOT NULL AND metric_name IS NOT NULL AND value IS NOT NULL AND ts IS NOT NULL""")
def s2(spark, d):
    good, _ = I.parse_metrics(metric_payloads(spark, d))
    return good.select("server_id", "metric_name", "value", "ts")


@register("S2_dead_letters", _PAYLOAD_SQL + """
SELECT CASE WHEN server_id IS NULL AND metric_name IS NULL THEN 'not a metric record'
            ELSE 'missing server_id' END AS reason, count(*) AS n
FROM parsed WHERE server_id IS NULL OR metric_name IS NULL GROUP BY ALL""")
def s2_bad(spark, d):
    _, bad = I.parse_metrics(metric_payloads(spark, d))
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@register("S4_S5_latest_heartbeat", """
SELECT server_id, "timestamp", agent_version, CAST(3 AS BIGINT) AS n_watched,
       'nginx=' || nginx_status AS inventory_tail FROM heartbeats""")
def s4(spark, d):
    msgs = B.heartbeat_messages(spark, d)
    js = msgs.select(F.to_json(F.struct(
        "server_id", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        "agent_version", "watched_logs", "inventory")).alias("data"), "arrival_seq")
    hb = I.latest_heartbeat(I.parse_heartbeats(js)[0])
    inv = F.filter("inventory", lambda x: x["name"] == "nginx")
    return hb.select("server_id", "timestamp", "agent_version", F.size("watched_logs").alias("n_watched"),
                     F.concat(F.lit("nginx="), F.try_element_at(inv, F.lit(1))["status"]).alias("inventory_tail"))


@register("S12_rule_validation", """
SELECT rule_id, version, operator NOT IN ('>', '<', '>=', '<=', '==') AS invalid,
       CASE WHEN operator NOT IN ('>', '<', '>=', '<=', '==') THEN 'operator' END AS reason
FROM alert_rules""")
def s12(spark, d):
    v = I.validate_rules(B.alert_rules(spark, d))
    return v.select("rule_id", "version", (~F.col("valid")).alias("invalid"), "reason")


@register("A14_A15_enabled_rules", """
SELECT rule_id, server_id, metric_name, operator, threshold, severity, cooldown_minutes, created_at,
       alert_mode, ml_score_threshold, version FROM rules""")
def a15(spark, d):
    r = I.latest_rules(B.alert_rules(spark, d)).filter("enabled")
    return r.select("rule_id", "server_id", "metric_name", "operator", "threshold", "severity",
                    "cooldown_minutes", "created_at", "alert_mode", "ml_score_threshold", "version")


VERSION_TS = "2024-01-31 00:00:00"


@register("S10_S11_rule_upsert_delete", """
, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY server_id, rule_id ORDER BY version DESC) AS rn
                            FROM alert_rules) WHERE rn = 1),
ins AS (SELECT rule_id, server_id, metric_name, operator, threshold * 2 AS threshold, severity, cooldown_minutes,
               enabled, created_at, 1706659200000 AS version, alert_mode, ml_score_threshold
        FROM latest WHERE server_id = 'srv-4' AND operator IN ('>', '<', '>=', '<=', '==')),
del AS (SELECT rule_id, server_id, metric_name, operator, threshold, severity, cooldown_minutes,
               FALSE AS enabled, created_at, 1706659200000 AS version, alert_mode, ml_score_threshold
        FROM latest WHERE enabled AND ((server_id = 'srv-3' AND metric_name = 'cpu_usage_percent')
                                       OR (server_id = 'srv-1' AND metric_name = 'network_bytes_in_per_sec'))),
allv AS (SELECT rule_id, server_id, metric_name, operator, threshold, severity, cooldown_minutes, enabled,
                created_at, version, alert_mode, ml_score_threshold FROM alert_rules
         UNION ALL SELECT * FROM ins UNION ALL SELECT * FROM del)
SELECT rule_id, server_id, threshold, enabled, version FROM (
  SELECT *, row_number() OVER (PARTITION BY server_id, rule_id ORDER BY version DESC) AS rn FROM allv) WHERE rn = 1""")
def s10(spark, d):
    rules = B.alert_rules(spark, d)
    latest = I.latest_rules(rules)
    incoming = latest.filter(F.col("server_id") == "srv-4").withColumn("threshold", F.col("threshold") * 2)
    ins = I.upsert_rules(rules, incoming, VERSION_TS)
    # srv-1's network rule is already deleted: "not found", no new row
    req = latest.filter(((F.col("server_id") == "srv-3") & (F.col("metric_name") == "cpu_usage_percent"))
                        | ((F.col("server_id") == "srv-1")
                           & (F.col("metric_name") == "network_bytes_in_per_sec")))
    dele = I.soft_delete(rules, req, VERSION_TS)
    allv = rules.unionByName(ins).unionByName(dele.select(*rules.columns))
    return I.latest_rules(allv).select("rule_id", "server_id", "threshold", "enabled", "version")


@register("P7_metric_name_validity", f"""
, names AS (SELECT DISTINCT n AS name FROM (
    SELECT unnest([event_type, upper(event_type), event_type || '_', '1' || event_type,
                   event_type || '_per_sec', substr(event_type, 1, 1)]) AS n FROM events))
SELECT name, coalesce(regexp_matches(name, '{logtext.METRIC_NAME_RULE}'), FALSE) AS valid FROM names""")
def p7(spark, d):
    e = B.events(spark, d)
    t = F.col("event_type")
    names = e.select(F.explode(F.array(t, F.upper(t), F.concat(t, F.lit("_")), F.concat(F.lit("1"), t),
                                       F.concat(t, F.lit("_per_sec")), F.substring(t, 1, 1))).alias("name"))
    return names.distinct().select("name", logtext.valid_metric_name("name").alias("valid"))


@register("S15_retention_counts", f"""
SELECT 'logs' AS tbl, count(*) AS n FROM logs WHERE ts > {AS_OF} - INTERVAL 30 DAY
UNION ALL SELECT 'metrics', count(*) FROM metrics WHERE ts > {AS_OF} - INTERVAL 90 DAY
UNION ALL SELECT 'alert_events', count(*) FROM alert_events WHERE triggered_at > {AS_OF} - INTERVAL 90 DAY""")
def s15(spark, d):
    lg = I.retain(B.logs(spark, d), AS_OF_TS, 30).select(F.lit("logs").alias("tbl"))
    m = I.retain(B.metrics(spark, d), AS_OF_TS, 90).select(F.lit("metrics").alias("tbl"))
    ev = I.retain(B.alert_events(spark, d), AS_OF_TS, 90, ts="triggered_at").select(F.lit("alert_events").alias("tbl"))
    return lg.unionByName(m).unionByName(ev).groupBy("tbl").agg(F.count(F.lit(1)).alias("n"))


@register("S16_month_partitions", """
SELECT CAST(strftime(ts, '%Y%m') AS BIGINT) AS month, server_id, count(*) AS n FROM metrics GROUP BY ALL""")
def s16(spark, d):
    from fleetscope.sources.sinks import with_month
    return with_month(B.metrics(spark, d)).groupBy("month", "server_id").agg(F.count(F.lit(1)).alias("n"))


@register("S17_newest_per_stream", f"""
, st AS (SELECT 'metrics' AS stream, server_id, metric_name AS name, ts, value AS num FROM metrics
  UNION ALL SELECT 'logs', server_id, log_file, ts, CAST(seq AS DOUBLE) FROM logs
  UNION ALL SELECT 'heartbeats', server_id, agent_version, "timestamp", CAST(arrival_seq AS DOUBLE) FROM heartbeat_messages)
SELECT stream, server_id, name, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ts DESC, server_id DESC, name DESC, num DESC) AS rn FROM st)
WHERE rn <= CASE stream {" ".join(f"WHEN '{k}' THEN {n}" for k, n in I.STREAM_BOUNDS.items())} END""")
def s17(spark, d):
    def rows(df, stream, name, ts, num):
        return df.select(F.lit(stream).alias("stream"), "server_id", F.col(name).alias("name"), F.col(ts).alias("ts"),
                         F.col(num).cast("double").alias("num"))
    streams = (rows(B.metrics(spark, d), "metrics", "metric_name", "ts", "value")
               .unionByName(rows(B.logs(spark, d), "logs", "log_file", "ts", "seq"))
               .unionByName(rows(B.heartbeat_messages(spark, d), "heartbeats", "agent_version", "timestamp", "arrival_seq")))
    return I.newest_per_stream(streams, "ts", ["server_id", "name", "num"]).select("stream", "server_id", "name", "ts")


@register("S3_F24_parse_log_events", """
SELECT server_id, log_file, ts, line FROM logs WHERE seq % 53 <> 0""")
def s3(spark, d):
    lg = B.logs(spark, d)
    raw = lg.select(
        "server_id", "log_file",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.when(F.col("seq") % 53 == 0, F.lit(""))
        .when(F.col("seq") % 4 == 0, F.concat("line", F.lit("\r\n"))).otherwise(F.col("line")).alias("line"))
    return I.parse_logs(raw)[0]


@register("S6_S7_S9_append_layout", """
SELECT 'metrics' AS tbl, CAST(strftime(ts, '%Y%m') AS BIGINT) AS month, count(*) AS n FROM metrics GROUP BY ALL
UNION ALL SELECT 'logs', CAST(strftime(ts, '%Y%m') AS BIGINT), count(*) FROM logs GROUP BY ALL
UNION ALL SELECT 'alert_events', CAST(strftime(triggered_at, '%Y%m') AS BIGINT), count(*) FROM alert_events GROUP BY ALL""")
def s6(spark, d):
    from fleetscope.sources.sinks import append_layout
    m = append_layout(B.metrics(spark, d), "ts", ["server_id", "metric_name"]).select(F.lit("metrics").alias("tbl"), "month")
    lg = append_layout(B.logs(spark, d), "ts", ["server_id", "log_file"]).select(F.lit("logs").alias("tbl"), "month")
    ev = append_layout(B.alert_events(spark, d), "triggered_at", ["server_id"]).select(
        F.lit("alert_events").alias("tbl"), "month")
    return m.unionByName(lg).unionByName(ev).groupBy("tbl", "month").agg(F.count(F.lit(1)).alias("n"))


@register("S8_keyed_append_dedup", "SELECT server_id, metric_name, ts, score FROM scores")
def s8(spark, d):
    from fleetscope.operators.dedup import latest_version
    from fleetscope.sources.sinks import append_layout
    s = B.anomaly_scores(spark, d)
    batches = [append_layout(s.filter(F.col("ingest_seq") == k).select("server_id", "metric_name", "ts", "score")
                             .withColumn("ingest_seq", F.lit(k).cast("long")), "ts", ["server_id", "metric_name"])
               for k in (1, 2)]
    table = batches[0].unionByName(batches[1]).drop("month")
    return latest_version(table, ["server_id", "metric_name", "ts"], "ingest_seq").drop("ingest_seq")


@register("R1_S1_microbatch_ingest", _PAYLOAD_SQL + """
SELECT CAST(strftime(ts, '%Y%m') AS BIGINT) AS month, server_id, count(*) AS n FROM parsed
WHERE server_id IS NOT NULL AND metric_name IS NOT NULL AND value IS NOT NULL AND ts IS NOT NULL GROUP BY ALL""")
def r1(spark, d):
    # the transformation each micro-batch of the metric stream runs before its append
    from fleetscope.sources.sinks import with_month
    good, _ = I.parse_metrics(metric_payloads(spark, d))
    return with_month(good).groupBy("month", "server_id").agg(F.count(F.lit(1)).alias("n"))


@register("R6_live_tail_rows", """
SELECT server_id, log_file, ts, line FROM logs WHERE server_id = 'srv-1' AND log_file = 'auth.log'""")
def r6(spark, d):
    from fleetscope.streaming import jobs
    return jobs.live_tail(B.logs(spark, d), "srv-1", "auth.log").select("server_id", "log_file", "ts", "line")
