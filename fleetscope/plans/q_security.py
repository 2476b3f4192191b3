"""Registered login-security queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.functions import auth
from fleetscope.operators import security as S
from fleetscope.plans.catalog import AS_OF, AS_OF_TS, register
from fleetscope.sources import bindings as B

DAY_OF = "2024-01-30 12:00:00"          # "today" for the per-hour report
DAY_OF_SQL = f"TIMESTAMP '{DAY_OF}'"

IP_RE, USER_RE, INV_RE = auth.IP_PATTERN, auth.USER_PATTERN, auth.INVALID_USER_PATTERN
_F24 = f"""
, f AS (SELECT server_id, ts, regexp_extract(line, '{IP_RE}', 1) AS ip,
          coalesce(nullif(regexp_extract(line, '{USER_RE}', 1), ''),
                   nullif(regexp_extract(line, '{INV_RE}', 1), '')) AS u
        FROM failed_logins WHERE ts >= {AS_OF} - INTERVAL 24 HOUR)"""

_STATS = _F24 + f""",
c AS (SELECT server_id, count(*) FILTER (WHERE ts >= {AS_OF} - INTERVAL 1 HOUR) AS attempts_1h,
             count(*) AS attempts_24h, count(DISTINCT ip) AS unique_ips_24h FROM f GROUP BY server_id),
pu AS (SELECT server_id, u, count(*) AS cnt FROM f WHERE u IS NOT NULL AND u <> '' GROUP BY ALL),
t AS (SELECT server_id, u AS top_target FROM (
        SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY cnt DESC, u) AS rn FROM pu) WHERE rn = 1),
srv AS (SELECT DISTINCT server_id FROM logs),
stats AS (SELECT srv.server_id, coalesce(attempts_1h, 0) AS attempts_1h, coalesce(attempts_24h, 0) AS attempts_24h,
       coalesce(unique_ips_24h, 0) AS unique_ips_24h, top_target
FROM srv LEFT JOIN c USING (server_id) LEFT JOIN t USING (server_id))"""


def servers(spark, d):
    """Servers that ever sent a heartbeat."""
    return B.heartbeat_messages(spark, d).select("server_id").distinct()


@register("P4_failed_login_lines", "SELECT server_id, ts, line FROM failed_logins")
def p4(spark, d):
    return S.failed_logins(B.logs(spark, d)).select("server_id", "ts", "line")


@register("F2_F3_extract_ip_user", f"""
SELECT server_id, ts, regexp_extract(line, '{IP_RE}', 1) AS ip,
       coalesce(nullif(regexp_extract(line, '{USER_RE}', 1), ''),
                nullif(regexp_extract(line, '{INV_RE}', 1), '')) AS username
FROM failed_logins""")
def f2(spark, d):
    return S.failed_logins(B.logs(spark, d)).select(
        "server_id", "ts", auth.attacker_ip("line").alias("ip"), auth.target_user("line").alias("username"))


@register("A5_A6_T3_ssh_stats", _STATS + "\nSELECT * FROM stats")
def a5(spark, d):
    return S.ssh_stats(B.logs(spark, d), AS_OF_TS, servers=servers(spark, d))


@register("A7_T5_F19_attackers_top20", _F24 + f""",
g AS (SELECT server_id, ip, count(*) AS attempts, max(ts) AS last_seen,
             string_agg(DISTINCT u, ',' ORDER BY u) FILTER (WHERE u IS NOT NULL AND u <> '') AS users
      FROM f WHERE ip <> '' GROUP BY server_id, ip),
r AS (SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY attempts DESC, ip) AS rank FROM g)
SELECT server_id, rank, ip, attempts, coalesce(users, '') AS users, last_seen,
       epoch({AS_OF}) - epoch(last_seen) > 1800 AS blocked,
       CASE WHEN attempts >= 500 THEN 'critical' WHEN attempts >= 100 THEN 'attention' ELSE 'ok' END AS severity,
       starts_with(ip, '10.') OR starts_with(ip, '192.168.') AS private
FROM r WHERE rank <= 20""")
def a7(spark, d):
    return S.attackers(B.logs(spark, d), AS_OF_TS).withColumn("users", F.array_join("users", ","))


_BY_HOUR = f"""
, cnt AS (SELECT server_id, hour(ts) AS hour, count(*) AS n FROM failed_logins
          WHERE ts >= date_trunc('day', {DAY_OF_SQL}) GROUP BY ALL),
spine AS (SELECT server_id, h.hour FROM (SELECT DISTINCT server_id FROM logs),
          (SELECT range AS hour FROM range(24)) h),
by_hour AS (SELECT spine.server_id, spine.hour, coalesce(n, 0) AS count
            FROM spine LEFT JOIN cnt USING (server_id, hour))"""


@register("A8_J9_attack_by_hour", _BY_HOUR + "\nSELECT server_id, hour, count FROM by_hour")
def a8(spark, d):
    return S.attack_by_hour(B.logs(spark, d), DAY_OF, servers(spark, d))


_BASE = f"""
, daily AS (SELECT server_id, date_trunc('day', ts) AS day, count(*) AS n FROM failed_logins
            WHERE ts >= {AS_OF} - INTERVAL 7 DAY GROUP BY ALL),
bl AS (SELECT s.server_id, coalesce(avg(n), 0.0) AS avg_daily
       FROM (SELECT DISTINCT server_id FROM logs) s LEFT JOIN daily USING (server_id) GROUP BY s.server_id)"""


@register("A9_W10_ssh_baseline_7d", _BASE + "\nSELECT server_id, avg_daily FROM bl")
def a9(spark, d):
    return S.ssh_baseline(B.logs(spark, d), AS_OF_TS, servers=servers(spark, d))


@register("A21_peak_attack_hour", _BY_HOUR + """
SELECT server_id, arg_max(hour, count * 100 - hour) AS peak_hour, max(count) AS peak_count
FROM by_hour GROUP BY server_id""")
def a21(spark, d):
    return S.peak_hour(S.attack_by_hour(B.logs(spark, d), DAY_OF, servers(spark, d)))


@register("F18_hourly_bars", _BY_HOUR + _BASE.replace("\n, daily", ",\ndaily", 1) + """
SELECT h.server_id, h.hour, h.count,
       h.count / greatest(max(h.count) OVER (PARTITION BY h.server_id), bl.avg_daily / 24.0, 1.0) * 100 AS pct,
       h.count > bl.avg_daily / 24.0 * 2 AS over
FROM by_hour h JOIN bl USING (server_id)""")
def f18(spark, d):
    return S.hourly_bars(B.logs(spark, d), AS_OF_TS, DAY_OF, servers(spark, d))


@register("H3_F17_threat_summary", _STATS + _BY_HOUR.replace("\n, cnt", ",\ncnt", 1)
          + _BASE.replace("\n, daily", ",\ndaily", 1) + """,
pk AS (SELECT server_id, arg_max(hour, count * 100 - hour) AS peak_hour, max(count) AS peak_count,
              max(count) AS max_hour_count FROM by_hour GROUP BY server_id),
ov AS (SELECT h.server_id, count(*) FILTER (WHERE h.count > bl.avg_daily / 24.0 * 2) AS hours_over_baseline
       FROM by_hour h JOIN bl USING (server_id) GROUP BY h.server_id),
x AS (SELECT stats.server_id, attempts_24h AS today, bl.avg_daily AS baseline,
             CASE WHEN bl.avg_daily > 0 THEN attempts_24h / bl.avg_daily ELSE 0.0 END AS ratio,
             peak_hour, peak_count, hours_over_baseline,
             greatest(CAST(max_hour_count AS DOUBLE), bl.avg_daily / 24.0, 1.0) AS bar_scale
      FROM stats JOIN bl USING (server_id) JOIN pk USING (server_id) JOIN ov USING (server_id))
SELECT server_id, today, baseline, ratio,
       CASE WHEN ratio > 2.5 THEN 'critical' WHEN ratio > 1.5 THEN 'attention' ELSE 'ok' END AS state,
       CASE WHEN ratio > 2 THEN 'critical' WHEN ratio > 1.3 THEN 'attention' ELSE 'ok' END AS band,
       peak_hour, peak_count, hours_over_baseline, bar_scale
FROM x""")
def h3(spark, d):
    return S.threat_summary(B.logs(spark, d), AS_OF_TS, DAY_OF, servers(spark, d))


_CLASSIFY = " ".join(
    f"WHEN regexp_matches(line, '{pat}') THEN {{'type': '{typ}', 'action': '{act}', "
    f"'username': regexp_extract(line, '{pat}', 1), 'source_ip': regexp_extract(line, '{pat}', 2), "
    f"'result': '{res}'}}"
    for pat, typ, act, res in auth.CLASSES)


@register("F1_H2_T1_ssh_events_last200", f"""
, tail AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY server_id, log_file ORDER BY ts DESC, seq DESC) AS rn
    FROM logs WHERE log_file = 'auth.log') WHERE rn <= 200),
c AS (SELECT server_id, ts, CASE {_CLASSIFY} END AS k FROM tail)
SELECT server_id, ts, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS timestamp,
       k.type AS type, k.action AS action, k.username AS username, k.source_ip AS source_ip, k.result AS result
FROM c WHERE k IS NOT NULL""")
def f1(spark, d):
    return S.ssh_events(B.logs(spark, d), 200)


@register("A19_attacker_totals", _F24 + """,
g AS (SELECT server_id, ip, count(*) AS attempts FROM f WHERE ip <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY attempts DESC, ip) AS rank FROM g)
SELECT server_id, CAST(sum(attempts) AS BIGINT) AS total_attempts, count(*) AS attackers FROM r WHERE rank <= 20 GROUP BY server_id""")
def a19(spark, d):
    return S.attacker_totals(S.attackers(B.logs(spark, d), AS_OF_TS))
