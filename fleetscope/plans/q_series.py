"""Registered metric-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.operators import dedup, features, series
from fleetscope.plans.catalog import AS_OF, AS_OF_FAST, AS_OF_FAST_TS, AS_OF_TS, register
from fleetscope.sources import bindings as B


def scores(spark, d):
    """Anomaly scores read through A14 (latest ingest per key)."""
    s = B.anomaly_scores(spark, d)
    return dedup.latest_version(s.select("server_id", "metric_name", "ts", "score", "ingest_seq"),
                                ["server_id", "metric_name", "ts"], "ingest_seq").drop("ingest_seq")


@register("A1_metric_names", """
SELECT server_id, string_agg(metric_name, ',' ORDER BY metric_name) AS metric_names
FROM (SELECT DISTINCT server_id, metric_name FROM metrics) GROUP BY server_id""")
def a1(spark, d):
    return (series.metric_names(B.metrics(spark, d))
            .select("server_id", F.array_join("metric_names", ",").alias("metric_names")))


@register("A2_known_servers", "SELECT DISTINCT server_id FROM metrics")
def a2(spark, d):
    return series.known_servers(B.metrics(spark, d))


@register("A3_latest_value", f"""
SELECT server_id, metric_name, max(value) AS value FROM metrics_fast
WHERE ts >= {AS_OF_FAST} - INTERVAL 5 MINUTE GROUP BY server_id, metric_name""")
def a3(spark, d):
    return series.latest_value(B.metrics_fast(spark, d, minutes=5), AS_OF_FAST_TS, 5)


@register("A4_baseline_7d", f"""
SELECT server_id, metric_name, avg(value) AS baseline FROM metrics
WHERE ts >= {AS_OF} - INTERVAL 7 DAY GROUP BY server_id, metric_name""")
def a4(spark, d):
    return series.baseline(B.metrics(spark, d), AS_OF_TS, 7)


@register("P1_metric_series_30m", f"""
SELECT server_id, metric_name, ts, value FROM metrics_fast
WHERE ts >= {AS_OF_FAST} - INTERVAL 30 MINUTE""")
def p1(spark, d):
    return series.series_window(B.metrics_fast(spark, d, minutes=30), AS_OF_FAST_TS, 30)


@register("S13_metrics_range", f"""
SELECT server_id, metric_name, ts, value FROM metrics WHERE ts >= TIMESTAMP '2024-01-29 12:00:00'""")
def s13(spark, d):
    return series.metrics_range(B.metrics(spark, d), "2024-01-29 12:00:00")


@register("A14_scores_dedup", "SELECT server_id, metric_name, ts, score FROM scores")
def a14_scores(spark, d):
    return scores(spark, d)


@register("U2_score_sources_union", """
SELECT server_id, metric_name, ts, arg_max(score, ingest_seq) AS score,
       arg_max(model_version, ingest_seq) AS model_version, count(*) AS n_sources
FROM anomaly_scores GROUP BY server_id, metric_name, ts""")
def u2(spark, d):
    s = B.anomaly_scores(spark, d)
    return (s.groupBy("server_id", "metric_name", "ts")
            .agg(F.max_by("score", "ingest_seq").alias("score"),
                 F.max_by("model_version", "ingest_seq").alias("model_version"),
                 F.count(F.lit(1)).alias("n_sources")))


@register("P2_anomaly_scores_30m", f"""
SELECT server_id, metric_name, ts, score FROM scores WHERE ts >= {AS_OF_FAST} - INTERVAL 30 MINUTE""")
def p2(spark, d):
    return scores(spark, d).filter(series.since(AS_OF_FAST_TS, 30))


@register("T4_latest_score_5m", f"""
SELECT server_id, metric_name, arg_max(score, ts) AS score FROM scores
WHERE ts >= {AS_OF_FAST} - INTERVAL 5 MINUTE GROUP BY server_id, metric_name""")
def t4(spark, d):
    return series.latest_score(scores(spark, d), AS_OF_FAST_TS, 5)


@register("A10_anomaly_count_6h", f"""
SELECT server_id, count(*) AS anomalies6h FROM scores
WHERE ts >= {AS_OF_FAST} - INTERVAL 6 HOUR AND score >= 0.5 GROUP BY server_id""")
def a10(spark, d):
    return series.anomaly_count(scores(spark, d), AS_OF_FAST_TS, 6)


@register("W4_sparkline_buckets", f"""
SELECT server_id, metric_name, make_timestamp((epoch_us(ts) // 120000000) * 120000000) AS bucket,
       avg(value) AS avg_value
FROM metrics_fast WHERE ts >= {AS_OF_FAST} - INTERVAL 60 MINUTE GROUP BY ALL""")
def w4(spark, d):
    return series.sparkline_buckets(B.metrics_fast(spark, d, minutes=60), AS_OF_FAST_TS, 60, 30)


_SPARK_SQL = f"""
spark_pts AS (
  SELECT server_id, metric_name, round_even(avg(value), 1) AS v,
         make_timestamp((epoch_us(ts) // 120000000) * 120000000) AS bucket
  FROM metrics_fast WHERE ts >= {AS_OF_FAST} - INTERVAL 60 MINUTE GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY server_id, metric_name ORDER BY bucket) AS rn,
         count(*) OVER (PARTITION BY server_id, metric_name) AS n
  FROM spark_pts),
halves AS (
  SELECT server_id, metric_name, any_value(n) AS n,
         avg(v) FILTER (WHERE rn <= n // 2) AS first_half,
         avg(v) FILTER (WHERE rn > n // 2) AS second_half,
         arg_min(v, rn) AS first_v, arg_max(v, rn) AS last_v
  FROM ranked GROUP BY server_id, metric_name)"""


@register("W5_W6_trend", f"""
, {_SPARK_SQL.strip()}
SELECT server_id, metric_name, n AS n_points,
  CASE WHEN n < 4 THEN 'stable'
       WHEN (second_half - first_half) / greatest(first_half, 0.1) > 0.03 THEN 'up'
       WHEN (second_half - first_half) / greatest(first_half, 0.1) < -0.03 THEN 'down'
       ELSE 'stable' END AS trend,
  CASE WHEN n < 2 THEN 'stable'
       WHEN abs(second_half - first_half) < first_half * 0.02 THEN 'stable'
       WHEN second_half - first_half > 0 THEN 'up' ELSE 'down' END AS card_trend
FROM halves""")
def w5(spark, d):
    sp = series.sparkline(B.metrics_fast(spark, d, minutes=60), AS_OF_FAST_TS)
    return sp.select("server_id", "metric_name", F.size("spark").alias("n_points"),
                     series.trend("spark").alias("trend"), series.card_trend("spark").alias("card_trend"))


@register("W8_memory_projection", f"""
, {_SPARK_SQL.strip()},
cur AS (SELECT server_id, metric_name, max(value) AS value FROM metrics_fast
        WHERE ts >= {AS_OF_FAST} - INTERVAL 5 MINUTE GROUP BY ALL)
SELECT h.server_id, h.metric_name, c.value AS current_value,
  CASE WHEN c.value IS NOT NULL AND h.n >= 5 AND h.last_v - h.first_v >= 0.5
        AND (90.0 - c.value) / (h.last_v - h.first_v) > 0
        AND (90.0 - c.value) / (h.last_v - h.first_v) < 24
       THEN '90% in ~' || CAST(CAST(round_even((90.0 - c.value) / (h.last_v - h.first_v), 0) AS INTEGER) AS VARCHAR) || 'h'
  END AS projection
FROM halves h LEFT JOIN cur c USING (server_id, metric_name)""")
def w8(spark, d):
    m = B.metrics_fast(spark, d)
    sp = series.sparkline(m, AS_OF_FAST_TS)
    cur = series.latest_value(m, AS_OF_FAST_TS, 5)
    return (sp.join(cur, ["server_id", "metric_name"], "left")
            .select("server_id", "metric_name", F.col("value").alias("current_value"),
                    series.projection("value", "spark", 90.0).alias("projection")))


@register("W7_counter_rate", """
, c AS (SELECT 'srv-' || CAST(user_id % 5 AS VARCHAR) AS server_id, 'network_bytes_in' AS metric_name,
          'eth' || CAST(user_id % 2 AS VARCHAR) AS device, make_timestamp(epoch_us(ts) // 300) AS ts,
          value * 1000 AS delta FROM events),
cc AS (SELECT server_id, metric_name, device, ts,
          sum(delta) OVER (PARTITION BY server_id, metric_name, device ORDER BY ts
                           RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS counter FROM c),
r AS (SELECT *, lag(counter) OVER p AS pc, lag(ts) OVER p AS pt FROM cc
      WINDOW p AS (PARTITION BY server_id, metric_name, device ORDER BY ts))
SELECT server_id, metric_name, device, ts, counter,
       greatest(0.0, (counter - pc) / ((epoch_us(ts) - epoch_us(pt)) / 1e6)) AS rate_per_sec
FROM r WHERE pt IS NOT NULL AND epoch_us(ts) <> epoch_us(pt)""")
def w7(spark, d):
    return series.counter_rate(B.counters(spark, d))


@register("J1_P13_H6_overlay_nearest", f"""
, v AS (SELECT server_id, metric_name, ts, value FROM metrics_fast WHERE ts >= {AS_OF_FAST} - INTERVAL 30 MINUTE),
s AS (SELECT server_id, metric_name, ts, score FROM scores
      WHERE ts >= {AS_OF_FAST} - INTERVAL 30 MINUTE AND score >= 0.5),
c AS (SELECT s.server_id, s.metric_name, s.ts, s.score, v.value, v.ts AS vts,
             row_number() OVER (PARTITION BY s.server_id, s.metric_name, s.ts
                                ORDER BY abs(epoch_us(v.ts) - epoch_us(s.ts)), v.ts) AS rn
      FROM s JOIN v ON s.server_id = v.server_id AND s.metric_name = v.metric_name)
SELECT server_id, metric_name, ts, score, value,
       CASE WHEN score >= 0.8 THEN 'red' ELSE 'amber' END AS level
FROM c WHERE rn = 1""")
def j1(spark, d):
    return series.overlay(B.metrics_fast(spark, d), scores(spark, d), AS_OF_FAST_TS, 30)


_FEATURES_SQL = """
SELECT server_id, metric_name, ts, value AS raw_value,
  avg(value) OVER w AS rolling_mean_5m,
  coalesce(stddev_samp(value) OVER w, 0.0) AS rolling_std_5m,
  coalesce(CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER o) = 0 THEN 0.0
       ELSE (value - lag(value) OVER o) / ((epoch_us(ts) - epoch_us(lag(ts) OVER o)) / 1e6) END, 0.0)
       AS rate_of_change,
  sin(2 * pi() * (hour(ts) + minute(ts) / 60.0 + second(ts) / 3600.0) / 24) AS hour_sin,
  cos(2 * pi() * (hour(ts) + minute(ts) / 60.0 + second(ts) / 3600.0) / 24) AS hour_cos,
  CAST(isodow(ts) - 1 AS BIGINT) AS day_of_week,
  CAST(isodow(ts) >= 6 AS BIGINT) AS is_weekend
FROM metrics_fast
WINDOW w AS (PARTITION BY server_id, metric_name ORDER BY epoch_us(ts)
             RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW),
       o AS (PARTITION BY server_id, metric_name ORDER BY ts)"""


@register("M1_W1_W2_W3_F5_F6_feature_table", _FEATURES_SQL)
def m1(spark, d):
    return features.compute_features(B.metrics_fast(spark, d))


@register("A13_feature_watermark", f"""
SELECT server_id, metric_name, max(ts) AS watermark FROM ({_FEATURES_SQL}) GROUP BY ALL""")
def a13(spark, d):
    return series.feature_watermark(features.compute_features(B.metrics_fast(spark, d)))
