"""Registered queries over rollup tables kept by streams (A4, A6, A9, W4), uptime
sessions (R7), the chart frame (H6) and the live tail as a job (R6).

``AT`` lies within an hour, so the reads combine stored buckets and raw rows.
"""

from __future__ import annotations

from datetime import datetime

from fleetscope.operators import rollups, series
from fleetscope.plans.catalog import AS_OF_FAST, AS_OF_FAST_TS, register
from fleetscope.plans.q_security import servers
from fleetscope.plans.q_series import scores
from fleetscope.plans.q_stream import as_stream
from fleetscope.session import scratch
from fleetscope.sources import bindings as B
from fleetscope.sources.manifest import ManifestTable
from fleetscope.streaming import jobs

AT = datetime(2024, 1, 30, 12, 34, 56)
AT_SQL = "TIMESTAMP '2024-01-30 12:34:56'"


def kept(rows, reduce, keys: list[str]):
    """The rollup that a stream over ``rows`` keeps, read back."""
    path = scratch(rows.sparkSession, "rollup")
    table = ManifestTable(rows.sparkSession, f"{path}/table")
    jobs.partials_to_table(as_stream(rows, f"{path}/rows"), reduce, table, f"{path}/checkpoint", keys, None).awaitTermination()
    return table.read()


@register("A4_baseline_from_rollup", f"""
SELECT server_id, metric_name, avg(value) AS baseline FROM metrics
WHERE ts >= {AT_SQL} - INTERVAL 7 DAY GROUP BY server_id, metric_name""")
def a4_rollup(spark, d):
    m = B.metrics(spark, d).select("server_id", "metric_name", "ts", "value")
    return rollups.baseline(kept(m, rollups.metric_partials, series.SERIES), m, AT)


@register("W4_sparkline_from_rollup", f"""
SELECT server_id, metric_name, make_timestamp((epoch_us(ts) // 120000000) * 120000000) AS bucket, avg(value) AS avg_value
FROM metrics_fast WHERE ts >= {AS_OF_FAST} - INTERVAL 60 MINUTE GROUP BY ALL""")
def w4_rollup(spark, d):
    m = B.metrics_fast(spark, d).select("server_id", "metric_name", "ts", "value")
    p = kept(m, lambda x: rollups.metric_partials(x, 1), series.SERIES)
    return rollups.sparkline_buckets(p, m, AS_OF_FAST_TS)


@register("A9_ssh_baseline_from_rollup", f"""
, daily AS (SELECT server_id, date_trunc('day', ts) AS day, count(*) AS n FROM failed_logins
            WHERE ts >= {AT_SQL} - INTERVAL 7 DAY GROUP BY ALL),
m AS (SELECT server_id, avg(n) AS avg_daily FROM daily GROUP BY server_id)
SELECT server_id, coalesce(avg_daily, 0.0) AS avg_daily
FROM (SELECT DISTINCT server_id FROM heartbeat_messages) LEFT JOIN m USING (server_id)""")
def a9_rollup(spark, d):
    lg = B.logs(spark, d).select("server_id", "log_file", "ts", "line")
    return rollups.ssh_baseline(kept(lg, rollups.login_partials, ["server_id"]), lg, servers(spark, d), AT)


@register("A5_A6_unique_ips_from_sketches", f"""
, c AS (SELECT server_id, count(*) AS attempts,
               count(DISTINCT regexp_extract(line, 'from ([^ ]+) port', 1)) AS unique_ips
        FROM failed_logins WHERE ts >= {AT_SQL} - INTERVAL 24 HOUR GROUP BY server_id)
SELECT server_id, coalesce(attempts, 0) AS attempts, coalesce(unique_ips, 0) AS unique_ips
FROM (SELECT DISTINCT server_id FROM heartbeat_messages) LEFT JOIN c USING (server_id)""")
def a6_rollup(spark, d):
    """Hourly sketches united; so few addresses that the estimate is the count."""
    lg = B.logs(spark, d).select("server_id", "log_file", "ts", "line")
    return rollups.unique_ips(kept(lg, rollups.login_partials, ["server_id"]), lg, servers(spark, d), AT)


@register("R7_uptime_sessions", """
, b AS (SELECT 'srv-' || CAST(user_id % 5 AS VARCHAR) AS server_id, ts FROM events),
g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 90000000 THEN 0 ELSE 1 END AS fresh
      FROM b WINDOW w AS (PARTITION BY server_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY server_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS spell FROM g)
SELECT server_id, min(ts) AS online_from, max(ts) AS last_seen, count(*) AS heartbeats FROM s GROUP BY server_id, spell""")
def r7_sessions(spark, d):
    return jobs.uptime_sessions(B.heartbeat_messages(spark, d, clock="raw"))


@register("H6_chart_frame", f"""
, v AS (SELECT server_id, metric_name, ts, value FROM metrics_fast WHERE ts >= {AS_OF_FAST} - INTERVAL 30 MINUTE),
s AS (SELECT server_id, metric_name, ts, score FROM scores
      WHERE ts >= {AS_OF_FAST} - INTERVAL 30 MINUTE AND score >= 0.5),
c AS (SELECT s.server_id, s.metric_name, s.ts, s.score, v.value,
             row_number() OVER (PARTITION BY s.server_id, s.metric_name, s.ts
                                ORDER BY abs(epoch_us(v.ts) - epoch_us(s.ts)), v.ts) AS rn
      FROM s JOIN v ON s.server_id = v.server_id AND s.metric_name = v.metric_name),
f AS (SELECT server_id, metric_name, 'value' AS kind, ts, value, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS level FROM v
      UNION ALL
      SELECT server_id, metric_name, 'anomaly', ts, round(value, 2), score, CASE WHEN score >= 0.8 THEN 'red' ELSE 'amber' END
      FROM c WHERE rn = 1),
b AS (SELECT server_id, metric_name, avg(value) AS baseline FROM metrics_fast
      WHERE ts >= {AS_OF_FAST} - INTERVAL 7 DAY GROUP BY ALL)
SELECT f.*, baseline, CASE metric_name WHEN 'cpu_usage_percent' THEN 80.0 WHEN 'memory_usage_percent' THEN 90.0
                                       WHEN 'disk_usage_percent' THEN 95.0 END::DOUBLE AS threshold
FROM f LEFT JOIN b USING (server_id, metric_name)""")
def h6_frame(spark, d):
    m = B.metrics_fast(spark, d)
    return series.chart_frame(m, scores(spark, d), series.baseline(m, AS_OF_FAST_TS), AS_OF_FAST_TS)


@register("R6_tail_job", "SELECT server_id, log_file, ts, line FROM logs WHERE server_id = 'srv-1' AND log_file = 'auth.log'")
def r6_job(spark, d):
    """The tail as a started job, read back from its table."""
    path = scratch(spark, "tail")
    lg = as_stream(B.logs(spark, d).select("server_id", "log_file", "ts", "line"), f"{path}/logs")
    q = jobs.tail_to_table(lg, "srv-1", "auth.log", f"{path}/tail", f"{path}/checkpoint")
    q.processAllAvailable()
    q.stop()
    return spark.read.parquet(f"{path}/tail").drop("batch")
