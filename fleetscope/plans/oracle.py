"""DuckDB twins of the bindings in ``sources.bindings``.

The driver registers the raw parquet tables as views; these CTEs rebuild the
observability tables from them with the same derivation rules, so every
registered query can be checked against an independent SQL engine.
"""

from __future__ import annotations

# ---- fixed values (the same as sources.bindings) ---------------------------
AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
# as_of on the compressed clock: epoch_us(as_of) // 300
AS_OF_FAST = "make_timestamp(epoch_us(TIMESTAMP '2024-01-31 00:00:00') // 300)"
# -----------------------------------------------------------------------------

_SERVER = "'srv-' || CAST(user_id % 5 AS VARCHAR)"
_METRIC = ("CASE event_type WHEN 'click' THEN 'cpu_usage_percent' "
           "WHEN 'view' THEN 'memory_usage_percent' WHEN 'purchase' THEN 'disk_usage_percent' "
           "WHEN 'error' THEN 'network_bytes_in_per_sec' WHEN 'signup' THEN 'process_count' END")
_FAST = "make_timestamp(epoch_us(ts) // 300)"


def _s(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


_PORT = f"CAST(40000 + event_id % 1000 AS VARCHAR)"

_LINE = f"""CASE
  WHEN event_id % 6 = 0 THEN 'Failed password for root from 10.0.' || {_s('user_id % 7')} || '.' || {_s('user_id % 11')} || ' port ' || {_PORT} || ' ssh2'
  WHEN event_id % 6 = 1 THEN 'Invalid user guest' || {_s('user_id % 13')} || ' from 203.0.113.' || {_s('user_id % 17')} || ' port ' || {_PORT}
  WHEN event_id % 6 = 2 THEN 'Failed password for invalid user admin' || {_s('user_id % 9')} || ' from 198.51.100.' || {_s('user_id % 23')} || ' port ' || {_PORT} || ' ssh2'
  WHEN event_id % 6 = 3 THEN 'Accepted publickey for deploy' || {_s('user_id % 3')} || ' from 192.168.1.' || {_s('user_id % 5')} || ' port 22 ssh2'
  WHEN event_id % 6 = 4 THEN 'Connection closed by authenticating user root 10.0.' || {_s('user_id % 7')} || '.' || {_s('user_id % 11')} || ' port ' || {_PORT} || ' [preauth]'
  WHEN event_type = 'error' THEN 'sshd[' || {_s('event_id')} || ']: error: kex_exchange_identification: reset'
  WHEN event_type = 'signup' THEN 'sshd[' || {_s('event_id')} || ']: Warning: Permanently added host key'
  ELSE 'sshd[' || {_s('event_id')} || ']: pam_unix(sshd:session): session opened for user ubuntu'
END"""

_RULE_OP = ("CASE metric_name WHEN 'cpu_usage_percent' THEN '>' WHEN 'memory_usage_percent' THEN '>=' "
            "WHEN 'disk_usage_percent' THEN '<' WHEN 'network_bytes_in_per_sec' THEN '<=' "
            "WHEN 'process_count' THEN '==' END")
_RULE_THR = ("CASE metric_name WHEN 'cpu_usage_percent' THEN 80.0 WHEN 'memory_usage_percent' THEN 90.0 "
             "WHEN 'disk_usage_percent' THEN 5.0 WHEN 'network_bytes_in_per_sec' THEN 10.0 "
             "WHEN 'process_count' THEN 42.0 END")
_RULE_SEV = ("CASE metric_name WHEN 'cpu_usage_percent' THEN 'critical' "
             "WHEN 'memory_usage_percent' THEN 'critical' ELSE 'warning' END")
_RULE_MODE = ("CASE metric_name WHEN 'memory_usage_percent' THEN 'ml' "
              "WHEN 'disk_usage_percent' THEN 'both' ELSE 'static' END")

VIEWS = {
    "metrics": f"""SELECT {_SERVER} AS server_id, {_METRIC} AS metric_name, value, ts,
        props FROM events""",
    "metrics_fast": f"""SELECT {_SERVER} AS server_id, {_METRIC} AS metric_name, value,
        {_FAST} AS ts, props FROM events""",
    "logs": f"""SELECT {_SERVER} AS server_id, 'auth.log' AS log_file, ts, {_LINE} AS line,
        event_id AS seq FROM events""",
    "heartbeat_messages": f"""SELECT {_SERVER} AS server_id, {_FAST} AS "timestamp",
        '1.0.' || {_s('event_id % 3')} AS agent_version,
        CASE WHEN event_type = 'error' THEN 'failed' ELSE 'active' END AS nginx_status,
        event_id AS arrival_seq FROM events""",
    "heartbeats": """SELECT server_id, arg_max("timestamp", arrival_seq) AS "timestamp",
        arg_max(agent_version, arrival_seq) AS agent_version,
        arg_max(nginx_status, arrival_seq) AS nginx_status
        FROM heartbeat_messages GROUP BY server_id""",
    "rules_v1": f"""SELECT server_id || ':' || metric_name || ':r1' AS rule_id, server_id, metric_name,
        {_RULE_OP} AS operator, CAST({_RULE_THR} AS DOUBLE) AS threshold, {_RULE_SEV} AS severity,
        CAST(5 AS BIGINT) AS cooldown_minutes, TRUE AS enabled, created_at, CAST(1 AS BIGINT) AS version,
        {_RULE_MODE} AS alert_mode, CAST(0.7 AS DOUBLE) AS ml_score_threshold
        FROM (SELECT server_id, metric_name, min(ts) AS created_at FROM metrics GROUP BY server_id, metric_name)""",
    "alert_rules": """SELECT * FROM rules_v1 UNION ALL
        SELECT rule_id, server_id, metric_name,
               CASE WHEN server_id = 'srv-2' THEN '!=' ELSE operator END AS operator,
               CASE WHEN server_id = 'srv-0' THEN threshold + 10 ELSE threshold END AS threshold,
               severity, cooldown_minutes, server_id <> 'srv-1' AS enabled, created_at,
               CAST(2 AS BIGINT) AS version, alert_mode, ml_score_threshold
        FROM rules_v1
        WHERE server_id = 'srv-0'
           OR (server_id = 'srv-1' AND metric_name = 'network_bytes_in_per_sec')
           OR (server_id = 'srv-2' AND metric_name = 'process_count')""",
    "alert_events": f"""SELECT 'evt-' || {_s('event_id')} AS event_id,
        {_SERVER} || ':' || ({_METRIC}) || ':r1' AS rule_id, {_SERVER} AS server_id,
        {_METRIC} AS metric_name, value, CAST(150.0 AS DOUBLE) AS threshold,
        CASE WHEN value > 300 THEN 'critical' ELSE 'warning' END AS severity,
        CASE WHEN event_id % 3 = 2 THEN 'RESOLVED' ELSE 'FIRING' END AS state,
        ts AS triggered_at
        FROM events WHERE value > 150""",
    "anomaly_scores": f"""SELECT {_SERVER} AS server_id, {_METRIC} AS metric_name,
            make_timestamp(epoch_us(ts) // 300 + (event_id % 11) * 1000000) AS ts,
            value / (value + 50.0) AS score, 'iforest-1' AS model_version, CAST(1 AS BIGINT) AS ingest_seq
        FROM events
        UNION ALL
        SELECT {_SERVER} AS server_id, {_METRIC} AS metric_name,
            make_timestamp(epoch_us(ts) // 300 + (event_id % 11) * 1000000) AS ts,
            least(CAST(1.0 AS DOUBLE), value / 100.0) AS score, 'hst-1' AS model_version, CAST(2 AS BIGINT) AS ingest_seq
        FROM events WHERE event_id % 4 = 0""",
    # A14 applied: the latest ingested score per key
    "scores": """SELECT server_id, metric_name, ts, arg_max(score, ingest_seq) AS score
        FROM anomaly_scores GROUP BY server_id, metric_name, ts""",
    # A14 applied to rules, then enabled only
    "rules": """SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY server_id, rule_id ORDER BY version DESC) AS rn
          FROM alert_rules) WHERE rn = 1 AND enabled""",
    "failed_logins": """SELECT * FROM logs WHERE log_file = 'auth.log'
        AND regexp_matches(line, 'Failed password|Invalid user')""",
}


def with_views(body: str, recursive: bool = False) -> str:
    ctes = ",\n".join(f"{name} AS (\n{sql}\n)" for name, sql in VIEWS.items())
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"
