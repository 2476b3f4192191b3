"""Edge cases of payload parsing, heartbeat defaults, rule validation and
server status (fixtures the reference leaves untested)."""

from datetime import datetime

from pyspark.sql import functions as F

from fleetscope.operators import fleet
from fleetscope.sources import ingest


def test_metric_payloads(spark):
    raw = [
        '{"server_id": "s", "metric_name": "cpu", "value": 1.5, "timestamp": "2026-05-12T10:00:00Z"}',
        '{"server_id": "s", "metric_name": "cpu", "value": "12.5", "timestamp": "2026-05-12T10:00:00.123456789Z",'
        ' "tags": null}',
        '{"server_id": "s", "metric_name": "cpu", "value": 2, "timestamp": "2026-05-12T06:00:00.5-04:00",'
        ' "tags": {"mount": "/"}}',
        '{"metric_name": "cpu", "value": 1, "timestamp": "2026-05-12T10:00:00Z"}',
        '{"server_id": "s", "metric_name": "cpu", "value": "abc", "timestamp": "2026-05-12T10:00:00Z"}',
        '{"server_id": "s", "metric_name": "cpu", "value": 1, "timestamp": "yesterday"}',
        "not json at all",
    ]
    df = spark.createDataFrame([(r,) for r in raw], "data string")
    good, bad = ingest.parse_metrics(df)
    g = good.orderBy("value").collect()
    assert [r.value for r in g] == [1.5, 2.0, 12.5]
    assert g[1].ts == datetime(2026, 5, 12, 10, 0, 0, 500000)          # -04:00 -> UTC
    assert g[2].ts == datetime(2026, 5, 12, 10, 0, 0, 123456)          # 9 digits -> microseconds
    assert g[0].tags == {} and g[1].tags == {"mount": "/"} and g[2].tags == {}
    reasons = sorted(r.reason for r in bad.collect())
    assert reasons == ["bad timestamp", "bad value", "missing server_id", "not a metric record"]


def test_heartbeat_defaults(spark):
    raw = ['{"server_id": "a", "timestamp": "2026-05-12T10:00:00Z"}',
           '{"server_id": "b", "timestamp": "2026-05-12T10:00:00Z", "agent_version": "1.2",'
           ' "watched_logs": ["/var/log/x"], "inventory": [{"name": "sshd", "version": "9", "status": "active"}]}',
           '{"timestamp": "2026-05-12T10:00:00Z"}', 'not json', '{"server_id": "c", "timestamp": "soon"}']
    hb, bad = ingest.parse_heartbeats(spark.createDataFrame([(r,) for r in raw], "data string"))
    assert sorted((r.raw, r.reason) for r in bad.collect()) == sorted([
        (raw[2], "missing server_id"), (raw[3], "missing server_id"), (raw[4], "bad timestamp")])
    rows = {r.server_id: r for r in hb.collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"].agent_version == "unknown" and rows["a"].watched_logs == [] and rows["a"].inventory == []
    assert rows["b"].inventory[0].name == "sshd"


def test_latest_heartbeat_is_last_arrival(spark):
    df = spark.createDataFrame([("a", "2026-05-12 10:00:05", 1), ("a", "2026-05-12 10:00:01", 2)],
                               "server_id string, t string, arrival_seq long")
    df = df.select("server_id", F.to_timestamp("t").alias("timestamp"), "arrival_seq")
    assert ingest.latest_heartbeat(df).first().timestamp == datetime(2026, 5, 12, 10, 0, 1)
    assert ingest.latest_heartbeat(df, order="timestamp").first().timestamp == datetime(2026, 5, 12, 10, 0, 5)


def test_rule_validation(spark):
    rows = [(">", "warning", 5, "static", 0.7, "cpu_usage_percent"),
            ("!=", "warning", 5, "static", 0.7, "cpu_usage_percent"),
            (">", "info", 5, "static", 0.7, "cpu_usage_percent"),
            (">", "critical", 0, "static", 0.7, "cpu_usage_percent"),
            (">", "critical", 1441, "static", 0.7, "cpu_usage_percent"),
            (">", "critical", None, "magic", 0.7, "cpu_usage_percent"),
            ("<=", "critical", 1440, "both", 1.5, "cpu_usage_percent"),
            ("==", "critical", 1, None, None, "Bad-Name")]
    df = spark.createDataFrame(rows, "operator string, severity string, cooldown_minutes int, alert_mode string, "
                                     "ml_score_threshold double, metric_name string")
    got = [r.reason for r in ingest.validate_rules(df).collect()]
    # metric names are not validated on rule input (the name rule applies to agents)
    assert got == [None, "operator", "severity", "cooldown_minutes", "cooldown_minutes", "alert_mode",
                   "ml_score_threshold", None]


def test_server_status(spark):
    df = spark.createDataFrame([("a", "2026-05-12 10:00:00", "1"), ("b", "2026-05-12 09:58:29", "1"),
                                ("c", None, None)], "server_id string, t string, agent_version string")
    df = df.select("server_id", F.to_timestamp("t").alias("timestamp"), "agent_version")
    got = {r.server_id: r.status for r in fleet.server_status(df, datetime(2026, 5, 12, 10, 1, 30)).collect()}
    assert got == {"a": "online", "b": "offline", "c": "unknown"}


def test_log_dead_letters(spark):
    rows = [("a", "auth.log", "2026-05-12T10:00:00Z", "ok\r\n"), ("a", "auth.log", "never", "x"), ("a", "auth.log", "2026-05-12T10:00:00Z", "\n"),
            (None, "auth.log", "2026-05-12T10:00:00Z", "x"), ("a", "auth.log", "2026-05-12T10:00:00Z", None)]
    good, bad = ingest.parse_logs(spark.createDataFrame(rows, "server_id string, log_file string, timestamp string, line string"))
    assert [r.line for r in good.collect()] == ["ok"]
    assert sorted(r.reason for r in bad.collect()) == ["bad timestamp", "empty line", "empty line", "missing server_id"]
