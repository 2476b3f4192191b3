"""Registered fleet-health queries (F7, F8, F9, F13, F15, F16, F25, F26, H1, H5, J7, J10,
A16-A18, P8, P9, P11, T6, T7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.operators import fleet as FL
from fleetscope.plans.catalog import AS_OF, AS_OF_FAST, AS_OF_FAST_TS, AS_OF_TS, register
from fleetscope.plans.q_series import scores
from fleetscope.sources import bindings as B

_NAMES = "('cpu_usage_percent', 'memory_usage_percent', 'disk_usage_percent')"

_STATUS = f"""
, status AS (SELECT server_id,
    CASE WHEN "timestamp" IS NULL THEN 'unknown'
         WHEN (epoch_us({AS_OF_FAST}) - epoch_us("timestamp")) / 1e6 <= 90 THEN 'online' ELSE 'offline' END AS status,
    "timestamp" AS last_seen, agent_version FROM heartbeats)"""

_SNAPSHOT = f"""
, v AS (SELECT server_id, metric_name, ts, value FROM metrics_fast
        WHERE metric_name IN {_NAMES} AND ts >= {AS_OF_FAST} - INTERVAL 60 MINUTE),
bk AS (SELECT server_id, metric_name, make_timestamp((epoch_us(ts) // 120000000) * 120000000) AS bucket,
              avg(value) AS av, max(CASE WHEN ts >= {AS_OF_FAST} - INTERVAL 5 MINUTE THEN value END) AS max5
       FROM v GROUP BY ALL),
rk AS (SELECT *, round_even(av, 1) AS rv,
              row_number() OVER (PARTITION BY server_id, metric_name ORDER BY bucket) AS rn,
              count(*) OVER (PARTITION BY server_id, metric_name) AS n FROM bk),
per AS (SELECT server_id, metric_name, max(max5) AS value, any_value(n) AS n,
               avg(rv) FILTER (WHERE rn <= n // 2) AS fh, avg(rv) FILTER (WHERE rn > n // 2) AS sh,
               arg_min(rv, rn) AS first_v, arg_max(rv, rn) AS last_v FROM rk GROUP BY ALL),
base AS (SELECT server_id, metric_name, round_even(avg(value), 1) AS baseline FROM metrics
         WHERE metric_name IN {_NAMES} AND ts >= {AS_OF} - INTERVAL 7 DAY GROUP BY ALL),
pm AS (SELECT server_id, metric_name, per.value, base.baseline,
              CASE WHEN coalesce(per.n, 0) < 4 THEN 'stable'
                   WHEN (sh - fh) / greatest(fh, 0.1) > 0.03 THEN 'up'
                   WHEN (sh - fh) / greatest(fh, 0.1) < -0.03 THEN 'down' ELSE 'stable' END AS trend,
              per.n, per.first_v, per.last_v, coalesce(per.n, 0) AS n_spark
       FROM per FULL JOIN base USING (server_id, metric_name)),
wide AS (SELECT server_id,
   max(value) FILTER (WHERE metric_name = 'cpu_usage_percent') AS cpu_value,
   max(baseline) FILTER (WHERE metric_name = 'cpu_usage_percent') AS cpu_baseline,
   max(trend) FILTER (WHERE metric_name = 'cpu_usage_percent') AS cpu_trend,
   max(n_spark) FILTER (WHERE metric_name = 'cpu_usage_percent') AS cpu_points,
   max(value) FILTER (WHERE metric_name = 'memory_usage_percent') AS mem_value,
   max(baseline) FILTER (WHERE metric_name = 'memory_usage_percent') AS mem_baseline,
   max(trend) FILTER (WHERE metric_name = 'memory_usage_percent') AS mem_trend,
   max(n_spark) FILTER (WHERE metric_name = 'memory_usage_percent') AS mem_points,
   max(n) FILTER (WHERE metric_name = 'memory_usage_percent') AS mem_n,
   max(last_v - first_v) FILTER (WHERE metric_name = 'memory_usage_percent') AS mem_rate,
   max(value) FILTER (WHERE metric_name = 'disk_usage_percent') AS disk_value,
   max(baseline) FILTER (WHERE metric_name = 'disk_usage_percent') AS disk_baseline,
   max(trend) FILTER (WHERE metric_name = 'disk_usage_percent') AS disk_trend,
   max(n_spark) FILTER (WHERE metric_name = 'disk_usage_percent') AS disk_points
   FROM pm GROUP BY server_id),
an AS (SELECT server_id, count(*) AS anomalies6h FROM scores
       WHERE ts >= {AS_OF_FAST} - INTERVAL 6 HOUR AND score >= 0.5 GROUP BY server_id),
s1 AS (SELECT h.server_id, w.cpu_value, w.cpu_baseline, coalesce(w.cpu_trend, 'stable') AS cpu_trend,
              w.mem_value, w.mem_baseline, coalesce(w.mem_trend, 'stable') AS mem_trend,
              w.disk_value, w.disk_baseline, coalesce(w.disk_trend, 'stable') AS disk_trend,
              coalesce(w.cpu_points, 0) AS cpu_points, coalesce(w.mem_points, 0) AS mem_points,
              coalesce(w.disk_points, 0) AS disk_points,
              CASE WHEN w.mem_value IS NOT NULL AND coalesce(w.mem_n, 0) >= 5 AND w.mem_rate >= 0.5
                     AND (90.0 - w.mem_value) / w.mem_rate > 0 AND (90.0 - w.mem_value) / w.mem_rate < 24
                   THEN '90% in ~' || CAST(CAST(round_even((90.0 - w.mem_value) / w.mem_rate, 0) AS BIGINT) AS VARCHAR) || 'h'
              END AS mem_projection,
              coalesce(an.anomalies6h, 0) AS anomalies6h
       FROM heartbeats h LEFT JOIN wide w USING (server_id) LEFT JOIN an USING (server_id)),
s2 AS (SELECT *, CASE
         WHEN cpu_value IS NULL AND mem_value IS NULL THEN 'critical'
         WHEN coalesce(cpu_value, 0) >= 80 OR coalesce(mem_value, 0) >= 90 OR coalesce(disk_value, 0) >= 95 THEN 'critical'
         WHEN mem_trend = 'up' AND mem_projection IS NOT NULL THEN 'attention'
         WHEN coalesce(cpu_value, 0) >= 68 OR coalesce(mem_value, 0) >= 76 OR coalesce(disk_value, 0) >= 80 THEN 'attention'
         ELSE 'ok' END AS state FROM s1),
snapshot AS (SELECT *, CASE
         WHEN cpu_value IS NULL THEN 'offline — no metric collection.'
         WHEN mem_trend = 'up' AND mem_projection IS NOT NULL THEN 'memory rising — projected ' || mem_projection
         WHEN state = 'critical' AND coalesce(cpu_value, 0) >= 80
           THEN 'CPU critical at ' || CAST(CAST(round_even(cpu_value, 0) AS BIGINT) AS VARCHAR) || '%.'
         WHEN state = 'critical' AND coalesce(mem_value, 0) >= 90
           THEN 'memory critical at ' || CAST(CAST(round_even(mem_value, 0) AS BIGINT) AS VARCHAR) || '%.'
         WHEN coalesce(cpu_baseline, 0) <> 0 AND coalesce(cpu_value, 0) <> 0 AND cpu_value > cpu_baseline * 1.10
           THEN 'CPU ' || CAST(CAST(round_even(cpu_value - cpu_baseline, 0) AS BIGINT) AS VARCHAR) || 'pp above average.'
         WHEN anomalies6h > 0 THEN CAST(anomalies6h AS VARCHAR) || ' anomal'
           || CASE WHEN anomalies6h <> 1 THEN 'ies' ELSE 'y' END || ' in the last 6h.'
         ELSE 'all within expected range.' END AS headline FROM s2)"""

_H1_COLS = ["server_id", "state", "headline", "cpu_value", "cpu_baseline", "cpu_trend", "cpu_points",
            "mem_value", "mem_baseline", "mem_trend", "mem_points", "mem_projection",
            "disk_value", "disk_baseline", "disk_trend", "disk_points", "anomalies6h"]


def snapshot(spark, d):
    return FL.health_snapshot(B.metrics_fast(spark, d), B.metrics(spark, d), scores(spark, d),
                              B.heartbeats(spark, d), AS_OF_FAST_TS, AS_OF_TS)


@register("H1_J10_F8_F9_P9_health_snapshot", _SNAPSHOT + f"\nSELECT {', '.join(_H1_COLS)} FROM snapshot")
def h1(spark, d):
    s = snapshot(spark, d)
    for short in ("cpu", "mem", "disk"):
        s = s.withColumn(f"{short}_points", F.size(f"{short}_spark").cast("long"))
    return s.select(*_H1_COLS)


@register("F7_server_status", _STATUS + "\nSELECT * FROM status")
def f7(spark, d):
    return FL.server_status(B.heartbeats(spark, d), AS_OF_FAST_TS)


@register("P9_critical_services_list", """
SELECT server_id, 'sshd:true,nginx:' || CASE WHEN nginx_status = 'active' THEN 'true' ELSE 'false' END
       || ',python3:false,node:false' AS services FROM heartbeats""")
def p9(spark, d):
    sv = FL.critical_services(B.heartbeats(spark, d))
    return sv.select("server_id", F.array_join(F.transform(
        "services", lambda s: F.concat(s["name"], F.lit(":"), s["ok"].cast("string"))), ",").alias("services"))


@register("P8_P11_inventory", """
SELECT server_id, e.name AS name, e.version AS version, e.status AS status,
       CASE WHEN e.status IN ('n/a', 'unknown') THEN 'runtime' ELSE 'daemon' END AS kind
FROM (SELECT server_id, unnest([{'name': 'sshd', 'version': '9.6', 'status': 'active'},
                                {'name': 'nginx', 'version': '1.24', 'status': nginx_status},
                                {'name': 'python3', 'version': '3.12', 'status': 'n/a'},
                                {'name': 'node', 'version': '20.11', 'status': 'unknown'}]) AS e
      FROM heartbeats)""")
def p8(spark, d):
    return FL.inventory(B.heartbeats(spark, d)).select("server_id", "name", "version", "status", "kind")


@register("F13_F15_F16_F26_metric_cards", _SNAPSHOT + """
SELECT server_id, cpu_value - cpu_baseline AS cpu_delta,
  CASE WHEN cpu_value IS NULL OR cpu_baseline IS NULL THEN NULL
       WHEN abs(cpu_value - cpu_baseline) < cpu_baseline * 0.05 THEN 'neutral'
       WHEN cpu_value - cpu_baseline > 0 THEN 'bad' ELSE 'good' END AS cpu_delta_tone,
  CASE WHEN cpu_value >= 80 THEN 'red' WHEN cpu_value >= 68 THEN 'amber' ELSE 'green' END AS cpu_severity,
  mem_value >= 90 * 0.9 AS mem_near_threshold,
  CASE WHEN disk_trend = 'up' AND disk_value > disk_baseline * 1.05 THEN 'bad'
       WHEN disk_trend = 'down' THEN 'good' ELSE 'neutral' END AS disk_flag
FROM snapshot""")
def f13(spark, d):
    s = snapshot(spark, d)
    dl = FL.baseline_delta("cpu_value", "cpu_baseline")
    return s.select("server_id", dl["delta"].alias("cpu_delta"), dl["tone"].alias("cpu_delta_tone"),
                    FL.card_severity("cpu_value", 68.0, 80.0).alias("cpu_severity"),
                    FL.near_threshold("mem_value", F.lit(90.0)).alias("mem_near_threshold"),
                    FL.rising_flag("disk_trend", "disk_value", "disk_baseline").alias("disk_flag"))


@register("H5_J7_A16_A17_A18_T6_T7_F25_fleet_overview", _SNAPSHOT + _STATUS.replace("\n, status", ",\nstatus", 1) + f""",
fleet AS (SELECT st.server_id, st.status, coalesce(sn.state, 'quiet') AS state, sn.cpu_value, sn.anomalies6h
          FROM status st LEFT JOIN snapshot sn USING (server_id)),
agg AS (SELECT count(*) FILTER (WHERE state = 'critical') AS critical,
               count(*) FILTER (WHERE state = 'attention') AS attention,
               count(*) FILTER (WHERE state = 'ok') AS ok,
               count(*) FILTER (WHERE state = 'quiet') AS quiet,
               CAST(coalesce(sum(anomalies6h), 0) AS BIGINT) AS anomalies6h_total,
               arg_min(server_id, (CASE WHEN state = 'critical' AND cpu_value IS NOT NULL THEN 0
                                        WHEN state = 'attention' THEN 1 ELSE 2 END, server_id)) AS focus_server,
               min(server_id) FILTER (WHERE status = 'online') AS primary_server
        FROM fleet),
worst AS (SELECT arg_max(ts, (score, -epoch_us(ts))) AS most_severe_ts,
                 max(score) AS most_severe_score
          FROM scores WHERE metric_name = 'cpu_usage_percent' AND ts >= {AS_OF_FAST} - INTERVAL 6 HOUR
            AND server_id = (SELECT focus_server FROM agg))
SELECT critical, attention, ok, quiet, anomalies6h_total,
  CASE WHEN critical > 0 THEN CAST(critical AS VARCHAR) || ' server(s) critical'
       WHEN attention > 0 THEN CAST(ok AS VARCHAR) || ' ok, ' || CAST(attention AS VARCHAR) || ' need attention'
       ELSE 'all systems nominal' END AS headline,
  focus_server, primary_server, most_severe_ts, most_severe_score
FROM agg, worst""")
def h5(spark, d):
    s = snapshot(spark, d)
    st = FL.server_status(B.heartbeats(spark, d), AS_OF_FAST_TS)
    return FL.fleet_overview(s, st, scores(spark, d), AS_OF_FAST_TS)
