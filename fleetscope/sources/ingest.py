"""Ingestion: parse agent payloads, keep latest heartbeats, validate and
version rules (S1-S5, S10-S12, S15-S17, P7).

Parsing is ``from_json`` + ``try_cast``; bad records go to a dead-letter
frame with a reason instead of being dropped silently.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import logtext
from fleetscope.operators.dedup import latest_version, newest_n
from fleetscope.operators.series import to_dt, ts_lit

METRIC_PAYLOAD = ("server_id string, metric_name string, value string, timestamp string, "
                  "tags map<string,string>")
HEARTBEAT_PAYLOAD = ("server_id string, timestamp string, agent_version string, watched_logs array<string>, "
                     "inventory array<struct<name:string,version:string,status:string,uptime_since:string>>")
LOG_FIELDS = ["server_id", "log_file", "timestamp", "line"]

# ---- fixed values: rule input domain ---------------------------------------
OPERATORS = [">", "<", ">=", "<=", "=="]
SEVERITIES = ["warning", "critical"]
MODES = ["static", "ml", "both"]
COOLDOWN_RANGE = (1, 1440)
DEFAULT_COOLDOWN = 5
DEFAULT_SCORE_THRESHOLD = 0.7
# -----------------------------------------------------------------------------


def parse_instant(s):
    """RFC 3339 text -> instant: 'Z' or offsets, 1-9 fraction digits
    (beyond microseconds truncated); unparseable -> NULL."""
    return s.try_cast("timestamp")


def _parse_once(raw: DataFrame, col: str, schema: str) -> DataFrame:
    """``from_json`` evaluated once per record: the generator is a plan
    barrier, so later references to the parsed fields do not re-run the
    parser (or the expression that produced the text)."""
    return raw.select(F.col(col).alias("raw"), *[c for c in raw.columns if c != col],
                      F.inline_outer(F.array(F.from_json(F.col(col), schema))))


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters) of a checked frame: one with the record's text
    in ``raw`` and a ``reason`` where it is bad."""
    return (checked.filter(F.col("reason").isNull()).drop("reason", "raw"),
            checked.filter(F.col("reason").isNotNull()).select("raw", "reason"))


def parse_metrics(raw: DataFrame, col: str = "data") -> tuple[DataFrame, DataFrame]:
    """JSON metric payloads -> (good rows, dead letters)."""
    return split(check_metrics(raw, col))


def check_metrics(raw: DataFrame, col: str = "data") -> DataFrame:
    """Value may be a JSON number or a numeric string; null/missing tags
    -> {}."""
    p = _parse_once(raw.select(col), col, METRIC_PAYLOAD)
    parsed = p.select(
        "raw", "server_id", "metric_name",
        F.col("value").try_cast("double").alias("value"),
        parse_instant(F.col("timestamp")).alias("ts"),
        F.coalesce(F.col("tags"), F.create_map().cast("map<string,string>")).alias("tags"))
    reason = (F.when(F.col("server_id").isNull() & F.col("metric_name").isNull() & F.col("ts").isNull(),
                     F.lit("not a metric record"))
              .when(F.col("server_id").isNull(), F.lit("missing server_id"))
              .when(F.col("metric_name").isNull(), F.lit("missing metric_name"))
              .when(F.col("value").isNull(), F.lit("bad value"))
              .when(F.col("ts").isNull(), F.lit("bad timestamp")))
    return parsed.withColumn("reason", reason)


def parse_logs(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3 + F24: flat log events -> (good rows, dead letters)."""
    return split(check_logs(raw))


def check_logs(raw: DataFrame) -> DataFrame:
    """S3 + F24: trailing CR/LF trimmed; records without a server, a readable
    time or any text are bad."""
    x = raw.select(F.to_json(F.struct(*LOG_FIELDS)).alias("raw"), "server_id", "log_file",
                   parse_instant(F.col("timestamp")).alias("ts"), logtext.clean_line("line").alias("line"))
    return x.withColumn("reason", F.when(F.col("server_id").isNull(), F.lit("missing server_id"))
                        .when(F.col("ts").isNull(), F.lit("bad timestamp"))
                        .when(F.coalesce(F.col("line"), F.lit("")) == "", F.lit("empty line")))


def parse_heartbeats(raw: DataFrame, col: str = "data") -> tuple[DataFrame, DataFrame]:
    """Heartbeat payloads -> (good rows, dead letters)."""
    return split(check_heartbeats(raw, col))


def check_heartbeats(raw: DataFrame, col: str = "data") -> DataFrame:
    """Defaults are agent_version 'unknown' and empty watched_logs and
    inventory; records without a server or a readable time are bad."""
    p = _parse_once(raw, col, HEARTBEAT_PAYLOAD)
    out = p.select(
        "raw", F.col("server_id"),
        parse_instant(F.col("timestamp")).alias("timestamp"),
        F.coalesce(F.col("agent_version"), F.lit("unknown")).alias("agent_version"),
        F.coalesce(F.col("watched_logs"), F.array().cast("array<string>")).alias("watched_logs"),
        F.coalesce(F.col("inventory"),
                   F.array().cast("array<struct<name:string,version:string,status:string,uptime_since:string>>"))
        .alias("inventory"),
        *[c for c in raw.columns if c != col])
    return out.withColumn("reason", F.when(F.col("server_id").isNull(), F.lit("missing server_id"))
                          .when(F.col("timestamp").isNull(), F.lit("bad timestamp")))


def latest_heartbeat(messages: DataFrame, order: str | Column = "arrival_seq") -> DataFrame:
    """One row per server, the last message by arrival (the reference's
    hash overwrite); pass ``order='timestamp'`` for event-time semantics."""
    return latest_version(messages, ["server_id"], order)


def validate_rules(rules: DataFrame) -> DataFrame:
    """``valid`` flag and the first failing ``reason`` for rule input."""
    cd = F.coalesce(F.col("cooldown_minutes"), F.lit(DEFAULT_COOLDOWN))
    st = F.coalesce(F.col("ml_score_threshold"), F.lit(DEFAULT_SCORE_THRESHOLD))
    mode = F.coalesce(F.col("alert_mode"), F.lit("static"))
    reason = (F.when(~F.coalesce(F.col("operator").isin(*OPERATORS), F.lit(False)), F.lit("operator"))
              .when(~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False)), F.lit("severity"))
              .when(~cd.between(*COOLDOWN_RANGE), F.lit("cooldown_minutes"))
              .when(~mode.isin(*MODES), F.lit("alert_mode"))
              .when(~st.between(0.0, 1.0), F.lit("ml_score_threshold")))
    return (rules.withColumn("cooldown_minutes", cd).withColumn("ml_score_threshold", st)
            .withColumn("alert_mode", mode)
            .withColumn("reason", reason).withColumn("valid", F.col("reason").isNull()))


def latest_rules(rules: DataFrame) -> DataFrame:
    """A14 on rules: highest version per (server_id, rule_id)."""
    return latest_version(rules, ["server_id", "rule_id"], "version")


def soft_delete(rules: DataFrame, requests: DataFrame, version_ts) -> DataFrame:
    """Append a disabled version for every requested (server, rule)
    whose latest version is enabled; unknown or already disabled rules are
    'not found' (no row).  ``version_ts`` plays the reference's unix-ms
    version clock."""
    cur = latest_rules(rules).filter("enabled")
    hit = cur.join(requests.select("server_id", "rule_id"), ["server_id", "rule_id"], "left_semi")
    new_version = (F.unix_micros(ts_lit(version_ts)) / 1000).cast("long")
    return hit.withColumn("enabled", F.lit(False)).withColumn("version", new_version)


def upsert_rules(rules: DataFrame, incoming: DataFrame, version_ts) -> DataFrame:
    """Valid incoming rules appended as a new version."""
    v = validate_rules(incoming).filter("valid").drop("valid", "reason")
    new_version = (F.unix_micros(ts_lit(version_ts)) / 1000).cast("long")
    return v.withColumn("version", new_version).select(*rules.columns)


def retain(df: DataFrame, as_of, days: int, ts: str = "ts") -> DataFrame:
    """Age-based retention (90 d metrics/events/features/scores, 30 d logs)."""
    return df.filter(F.col(ts) > ts_lit(to_dt(as_of) - timedelta(days=days)))


# ---- fixed values: rows a stream keeps --------------------------------------
STREAM_BOUNDS = {"metrics": 10_000, "logs": 20_000, "heartbeats": 1_000}
# -----------------------------------------------------------------------------


def newest_per_stream(df: DataFrame, ts: str, tiebreak: list[str]) -> DataFrame:
    """Bounded stream retention re-aimed as "newest N per stream" over the
    rows of all streams (column ``stream``); rows of one instant are ordered by
    ``tiebreak``, so what survives is defined.  Unknown streams keep nothing."""
    bound = F.lit(0)
    for stream, n in STREAM_BOUNDS.items():
        bound = F.when(F.col("stream") == stream, F.lit(n)).otherwise(bound)
    return newest_n(df, ["stream"], ts, bound, tiebreak, at_most=max(STREAM_BOUNDS.values()),
                    few_keys=True)      # the known streams
