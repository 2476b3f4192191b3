"""Registered alert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.operators import alerts as A
from fleetscope.plans.catalog import AS_OF, AS_OF_FAST, AS_OF_FAST_TS, AS_OF_TS, register
from fleetscope.plans.q_series import scores
from fleetscope.sources import bindings as B

_PATTERNS = f"""
, fe AS (SELECT server_id, rule_id, triggered_at FROM alert_events
         WHERE triggered_at >= {AS_OF} - INTERVAL 7 DAY AND state = 'FIRING'),
hc AS (SELECT server_id, rule_id, hour(triggered_at) AS h, count(*) AS c FROM fe GROUP BY ALL),
pk AS (SELECT server_id, rule_id, arg_max(h, c * 100 - h) AS peak_hour FROM hc GROUP BY ALL),
pat AS (SELECT server_id, rule_id, count(*) AS fires7d, max(triggered_at) AS last_fire FROM fe GROUP BY ALL),
patterns AS (SELECT pat.*, pk.peak_hour,
                    lpad(CAST(peak_hour AS VARCHAR), 2, '0') || '–' || lpad(CAST((peak_hour + 1) % 24 AS VARCHAR), 2, '0') || 'h'
                      AS peak_window
             FROM pat JOIN pk USING (server_id, rule_id))"""

_FIRING = """
, last50 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY server_id
                                        ORDER BY triggered_at DESC, event_id DESC) AS rn FROM alert_events)
             WHERE rn <= 50),
firing AS (SELECT DISTINCT server_id, rule_id FROM last50 WHERE state = 'FIRING')"""


@register("A11_A12_rule_patterns_7d", _PATTERNS + "\nSELECT * FROM patterns")
def a11(spark, d):
    return A.rule_patterns(B.alert_events(spark, d), AS_OF_TS)


@register("T2_recent_alert_events", """
SELECT event_id, server_id, rule_id, state, triggered_at FROM (
  SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY triggered_at DESC, event_id DESC) AS rn
  FROM alert_events) WHERE rn <= 100""")
def t2(spark, d):
    return A.recent_events(B.alert_events(spark, d), 100).select("event_id", "server_id", "rule_id", "state",
                                                                 "triggered_at")


@register("J4_firing_rules", _FIRING + "\nSELECT * FROM firing")
def j4(spark, d):
    return A.firing_rules(B.alert_events(spark, d))


_REPORT = _PATTERNS + _FIRING.replace("\n, last50", ",\nlast50", 1) + f""",
cur AS (SELECT server_id, metric_name, max(value) AS current_value FROM metrics_fast
        WHERE ts >= {AS_OF_FAST} - INTERVAL 5 MINUTE GROUP BY ALL),
report AS (
  SELECT r.server_id, r.rule_id, coalesce(p.fires7d, 0) AS fires7d, p.last_fire,
         coalesce(p.peak_window, '—') AS peak_window, c.current_value,
         CASE WHEN f.rule_id IS NOT NULL THEN 'firing'
              WHEN coalesce(p.fires7d, 0) = 0 THEN 'dormant'
              WHEN p.last_fire IS NOT NULL AND epoch_us({AS_OF}) - epoch_us(p.last_fire) < 86400000000 THEN 'active'
              ELSE 'quiet' END AS state,
         greatest(0.0, r.threshold - c.current_value) AS margin
  FROM rules r LEFT JOIN cur c USING (server_id, metric_name)
       LEFT JOIN patterns p USING (server_id, rule_id)
       LEFT JOIN firing f USING (server_id, rule_id))"""


@register("H4_F10_F20_J2_J3_rule_report", _REPORT + "\nSELECT * FROM report")
def h4(spark, d):
    return A.rule_report(B.alert_rules(spark, d), B.alert_events(spark, d), B.metrics_fast(spark, d),
                         AS_OF_TS, AS_OF_FAST_TS)


@register("A20_rule_state_counts", _REPORT + """
SELECT server_id, count(*) FILTER (WHERE state = 'firing') AS firing,
       count(*) FILTER (WHERE state = 'active') AS active,
       count(*) FILTER (WHERE state = 'dormant') AS dormant
FROM report GROUP BY server_id""")
def a20(spark, d):
    rep = A.rule_report(B.alert_rules(spark, d), B.alert_events(spark, d), B.metrics_fast(spark, d),
                        AS_OF_TS, AS_OF_FAST_TS)
    return A.rule_state_counts(rep)


_BREACH = """CASE WHEN NOT (operator IN ('>', '<', '>=', '<=', '==')) THEN NULL
  WHEN coalesce(alert_mode, 'static') = 'static' THEN st
  WHEN alert_mode = 'ml' THEN CASE WHEN score IS NULL THEN st ELSE score >= ml_score_threshold END
  WHEN alert_mode = 'both' THEN st OR coalesce(score >= ml_score_threshold, FALSE)
  ELSE FALSE END"""


@register("P5_J8_J2_J5_evaluate_tick", f"""
, cur AS (SELECT server_id, metric_name, max(value) AS value FROM metrics_fast
          WHERE ts >= {AS_OF_FAST} - INTERVAL 5 MINUTE GROUP BY ALL),
sc AS (SELECT server_id, metric_name, arg_max(score, ts) AS score FROM scores
       WHERE ts >= {AS_OF_FAST} - INTERVAL 5 MINUTE GROUP BY ALL),
x AS (SELECT r.*, cur.value, sc.score,
        CASE operator WHEN '>' THEN value > threshold WHEN '<' THEN value < threshold
             WHEN '>=' THEN value >= threshold WHEN '<=' THEN value <= threshold
             WHEN '==' THEN value = threshold END AS st
      FROM rules r JOIN cur USING (server_id, metric_name) LEFT JOIN sc USING (server_id, metric_name)
      WHERE r.server_id IN (SELECT server_id FROM heartbeats))
SELECT server_id, rule_id, value, score, breached FROM (SELECT *, {_BREACH} AS breached FROM x)
WHERE breached IS NOT NULL""")
def p5(spark, d):
    ev = A.evaluate_once(B.alert_rules(spark, d), B.heartbeats(spark, d), B.metrics_fast(spark, d),
                         scores(spark, d), AS_OF_FAST_TS)
    return ev.select("server_id", "rule_id", "value", "score", "breached")


def webhooks(spark, d):
    """Webhook per server: every server with a heartbeat except srv-4."""
    return (B.heartbeats(spark, d).filter(F.col("server_id") != "srv-4")
            .select("server_id", F.concat(F.lit("https://hooks.example.invalid/"), F.col("server_id")).alias("url")))


@register("F23_J6_notification_outbox", r"""
, wh AS (SELECT server_id, 'https://hooks.example.invalid/' || server_id AS url FROM heartbeats
         WHERE server_id <> 'srv-4')
SELECT e.event_id, e.server_id, wh.url,
       CASE WHEN state = 'FIRING' THEN '🔴' ELSE '🟢' END || ' ' || state || ': ' || metric_name || ' ≠ '
         || CAST(threshold AS VARCHAR) || ' em ' || e.server_id || ' (valor: ' || printf('%.2f', value) || ')' AS text
FROM alert_events e JOIN wh USING (server_id)""")
def f23(spark, d):
    out = A.notification_outbox(B.alert_events(spark, d), webhooks(spark, d))
    return out.select("event_id", "server_id", "url", "text")


@register("J4_F10_strict_firing_rules", """
, recent AS (SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY triggered_at DESC, event_id DESC) AS rn
             FROM alert_events),
last AS (SELECT *, row_number() OVER (PARTITION BY server_id, rule_id ORDER BY triggered_at DESC, event_id DESC) AS nth
         FROM recent WHERE rn <= 50)
SELECT server_id, rule_id FROM last WHERE nth = 1 AND state = 'FIRING'""")
def j4_strict(spark, d):
    return A.firing_rules(B.alert_events(spark, d), strict=True)


@register("P12_events_24h_firing", f"""
SELECT server_id, count(*) AS events_24h, count(*) FILTER (WHERE state = 'FIRING') AS firing_24h
FROM alert_events WHERE triggered_at >= {AS_OF} - INTERVAL 24 HOUR GROUP BY server_id""")
def p12(spark, d):
    ev = B.alert_events(spark, d).filter(F.col("triggered_at") >= F.to_timestamp(F.lit("2024-01-30 00:00:00")))
    return ev.groupBy("server_id").agg(F.count(F.lit(1)).alias("events_24h"),
                                       F.count_if(F.col("state") == "FIRING").alias("firing_24h"))


_TICK = 30_000_000
_WIN = 300_000_000

_REPLAY_SQL = f"""
, smp AS (SELECT server_id, metric_name, epoch_us(ts) AS us, value FROM metrics_fast),
tk AS (SELECT server_id, metric_name, value,
              unnest(range(((us + {_TICK - 1}) // {_TICK}) * {_TICK},
                           ((us + {_WIN}) // {_TICK}) * {_TICK} + 1, {_TICK})) AS tick_us FROM smp),
tv AS (SELECT server_id, metric_name, tick_us, max(value) AS value FROM tk
       WHERE tick_us <= epoch_us({AS_OF_FAST}) GROUP BY ALL),
sp AS (SELECT server_id, metric_name, epoch_us(ts) AS us, score FROM scores),
stk AS (SELECT server_id, metric_name, us, score,
               unnest(range(((us + {_TICK - 1}) // {_TICK}) * {_TICK},
                            ((us + {_WIN}) // {_TICK}) * {_TICK} + 1, {_TICK})) AS tick_us FROM sp),
tsc AS (SELECT server_id, metric_name, tick_us, max(struct_pack(t := us, s := score)).s AS score FROM stk
        WHERE tick_us <= epoch_us({AS_OF_FAST}) GROUP BY ALL),
x AS (SELECT r.server_id, r.rule_id, r.metric_name, r.operator, r.threshold, r.severity, r.alert_mode,
             r.ml_score_threshold, r.cooldown_minutes * 60000000 AS cooldown_us, tv.tick_us, tv.value, tsc.score,
             CASE r.operator WHEN '>' THEN tv.value > r.threshold WHEN '<' THEN tv.value < r.threshold
                  WHEN '>=' THEN tv.value >= r.threshold WHEN '<=' THEN tv.value <= r.threshold
                  WHEN '==' THEN tv.value = r.threshold END AS st
      FROM rules r JOIN tv USING (server_id, metric_name) LEFT JOIN tsc USING (server_id, metric_name, tick_us)
      WHERE r.server_id IN (SELECT server_id FROM heartbeats WHERE server_id <> 'srv-3')),
bt AS (SELECT server_id, rule_id, metric_name, threshold, severity, tick_us, value, cooldown_us, {_BREACH} AS breached FROM x),
b2 AS (SELECT *, row_number() OVER (PARTITION BY server_id, rule_id ORDER BY tick_us) AS rn
       FROM bt WHERE breached IS NOT NULL),
sm AS (
  SELECT server_id, rule_id, metric_name, threshold, severity, rn,
         CASE WHEN breached THEN 'FIRING' ELSE 'INACTIVE' END AS state,
         CAST(NULL AS BIGINT) AS resolved_us,
         CASE WHEN breached THEN 'FIRING' END AS ev, tick_us, value
  FROM b2 WHERE rn = 1
  UNION ALL
  SELECT n.server_id, n.rule_id, n.metric_name, n.threshold, n.severity, n.rn,
         CASE WHEN n.breached AND sm.state <> 'FIRING'
                   AND (sm.resolved_us IS NULL OR n.tick_us - sm.resolved_us >= n.cooldown_us) THEN 'FIRING'
              WHEN NOT n.breached AND sm.state = 'FIRING' THEN 'RESOLVED'
              ELSE sm.state END,
         CASE WHEN NOT n.breached AND sm.state = 'FIRING' THEN n.tick_us ELSE sm.resolved_us END,
         CASE WHEN n.breached AND sm.state <> 'FIRING'
                   AND (sm.resolved_us IS NULL OR n.tick_us - sm.resolved_us >= n.cooldown_us) THEN 'FIRING'
              WHEN NOT n.breached AND sm.state = 'FIRING' THEN 'RESOLVED' END,
         n.tick_us, n.value
  FROM sm JOIN b2 n ON n.server_id = sm.server_id AND n.rule_id = sm.rule_id AND n.rn = sm.rn + 1)
SELECT md5(server_id || '|' || rule_id || '|' || ev || '|' || CAST(tick_us AS VARCHAR)) AS event_id,
       server_id, rule_id, metric_name, threshold, severity, ev AS state, make_timestamp(tick_us) AS triggered_at, value
FROM sm WHERE ev IS NOT NULL"""


@register("R3_R4_alert_replay", _REPLAY_SQL, recursive=True)
def r3(spark, d):
    from fleetscope.operators import alert_replay as R
    beats = B.heartbeats(spark, d).filter(F.col("server_id") != "srv-3")      # one server has gone silent
    ticks = R.breach_ticks(B.alert_rules(spark, d), B.metrics_fast(spark, d), scores(spark, d), AS_OF_FAST_TS,
                           heartbeats=beats)
    return R.replay(ticks)
