"""Alert rules and events: patterns, firing state, reports, outbox
(A11, A12, A15, A20, T2, J2-J6, J8, F10, F20, F23, H4, P5, P12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.operators.dedup import newest_n
from fleetscope.operators.series import latest_score, latest_value, since, ts_lit
from fleetscope.sources.ingest import latest_rules

# ---- fixed values -----------------------------------------------------------
NO_PEAK = "—"
ICON_FIRING = "🔴"
ICON_OTHER = "🟢"
OP_SYMBOL = "≠"
# -----------------------------------------------------------------------------


def compare(op: Column | str, value: Column | str, threshold: Column | str) -> Column:
    """P5: rule comparator by operator string; unknown operator -> NULL."""
    o = F.col(op) if isinstance(op, str) else op
    v = F.col(value) if isinstance(value, str) else value
    t = F.col(threshold) if isinstance(threshold, str) else threshold
    return (F.when(o == ">", v > t).when(o == "<", v < t).when(o == ">=", v >= t)
            .when(o == "<=", v <= t).when(o == "==", v == t))


def enabled_rules(rules: DataFrame) -> DataFrame:
    """Dedup first (A14), then keep enabled rules."""
    return latest_rules(rules).filter("enabled")


def recent_events(events: DataFrame, limit: int = 100) -> DataFrame:
    """Newest N alert events per server."""
    return newest_n(events, ["server_id"], "triggered_at", limit, ["event_id"])


def peak_window(hour: Column) -> Column:
    """``HH–HH+1h`` label of the modal hour, '—' when none."""
    return F.coalesce(F.format_string("%02d–%02dh", hour, (hour + 1) % 24), F.lit(NO_PEAK))


def rule_patterns(events: DataFrame, as_of, days: int = 7) -> DataFrame:
    """A11 + A12: per rule, FIRING events in 7 days, last fire and the most
    common hour (ties -> smallest hour)."""
    f = events.filter(since(as_of, days=days, ts="triggered_at") & (F.col("state") == "FIRING"))
    return (f.groupBy("server_id", "rule_id")
            .agg(F.count(F.lit(1)).alias("fires7d"), F.max("triggered_at").alias("last_fire"),
                 F.mode(F.hour("triggered_at"), deterministic=True).alias("peak_hour"))
            .withColumn("peak_window", peak_window(F.col("peak_hour"))))


def firing_rules(events: DataFrame, window: int = 50, strict: bool = False) -> DataFrame:
    """Rules with a FIRING event among the server's 50 newest events;
    ``strict``: rules whose last event among them is FIRING, so a rule that has
    resolved since does not count."""
    recent = recent_events(events, window)
    if strict:
        last = F.max_by("state", F.struct("triggered_at", "event_id"))
        return (recent.groupBy("server_id", "rule_id").agg(last.alias("state"))
                .filter(F.col("state") == "FIRING").select("server_id", "rule_id"))
    return recent.filter(F.col("state") == "FIRING").select("server_id", "rule_id").distinct()


def rule_report(rules: DataFrame, events: DataFrame, metrics: DataFrame, as_of_events, as_of_values,
                recent_hours: int = 24, strict: bool = False) -> DataFrame:
    """Enabled rules with current value (J2), 7-day pattern (J3,
    defaults 0 / NULL / '—'), firing flag (J4) and the pattern state:
    firing -> dormant (no fire in 7 d) -> active (last fire < 24 h) -> quiet.
    ``strict`` as in ``firing_rules``."""
    r = enabled_rules(rules).select("server_id", "rule_id", "metric_name", "operator", "threshold", "created_at")
    cur = latest_value(metrics, as_of_values, 5).withColumnRenamed("value", "current_value")
    pat = rule_patterns(events, as_of_events)
    fire = firing_rules(events, strict=strict).withColumn("_firing", F.lit(True))
    x = (r.join(cur, ["server_id", "metric_name"], "left")
         .join(pat, ["server_id", "rule_id"], "left")
         .join(fire, ["server_id", "rule_id"], "left"))
    fires = F.coalesce(F.col("fires7d"), F.lit(0))
    age = F.unix_micros(ts_lit(as_of_events)) - F.unix_micros("last_fire")
    state = (F.when(F.coalesce(F.col("_firing"), F.lit(False)), F.lit("firing"))
             .when(fires == 0, F.lit("dormant"))
             .when(F.col("last_fire").isNotNull() & (age < recent_hours * 3_600_000_000), F.lit("active"))
             .otherwise(F.lit("quiet")))
    return x.select("server_id", "rule_id", fires.alias("fires7d"), "last_fire",
                    F.coalesce(F.col("peak_window"), F.lit(NO_PEAK)).alias("peak_window"),
                    "current_value", state.alias("state"),
                    F.greatest(F.lit(0.0), F.col("threshold") - F.col("current_value")).alias("margin"))


def rule_state_counts(report: DataFrame) -> DataFrame:
    """Firing / active / dormant rules per server."""
    return report.groupBy("server_id").agg(
        F.count_if(F.col("state") == "firing").alias("firing"),
        F.count_if(F.col("state") == "active").alias("active"),
        F.count_if(F.col("state") == "dormant").alias("dormant"))


def evaluate_once(rules: DataFrame, heartbeats: DataFrame, metrics: DataFrame, scores: DataFrame,
                  as_of, window_minutes: int = 5) -> DataFrame:
    """One evaluation tick for the fleet (J8 + J2 + J5 + P5): servers with a
    heartbeat x their enabled rules, current value (5-min max), latest score;
    ``breached`` per mode (static / ml / both; ml falls back to static
    without a score).  Rules without a value or with an unknown operator are
    skipped (no row)."""
    r = enabled_rules(rules).join(heartbeats.select("server_id"), "server_id", "left_semi")
    cur = latest_value(metrics, as_of, window_minutes)
    sc = latest_score(scores, as_of, window_minutes)
    x = r.join(cur, ["server_id", "metric_name"], "inner").join(sc, ["server_id", "metric_name"], "left")
    return x.withColumn("breached", breach(F.col("value"), F.col("score"))).filter(
        F.col("breached").isNotNull())


def breach(value: Column, score: Column) -> Column:
    """Breach flag of a rule row with columns operator, threshold,
    alert_mode, ml_score_threshold; NULL for an unknown operator."""
    static = compare("operator", value, "threshold")
    mode = F.coalesce(F.col("alert_mode"), F.lit("static"))
    ml = F.coalesce(score >= F.col("ml_score_threshold"), F.lit(False))
    return (F.when(static.isNull(), F.lit(None).cast("boolean"))
            .when(mode == "static", static)
            .when(mode == "ml", F.when(score.isNull(), static).otherwise(ml))
            .when(mode == "both", static | ml)
            .otherwise(F.lit(False)))


def iso_seconds_or_micros(ts: Column) -> Column:
    """Python ``isoformat`` of a UTC instant with a Z: fraction only when
    the microseconds are non-zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(frac != "000000", F.concat(F.lit("."), frac)).otherwise(F.lit("")), F.lit("Z"))


def plain_number(x: Column) -> Column:
    """A double as Python prints it between 1e-4 and 1e16: no exponent, and
    ``.0`` after a whole number."""
    whole = (x == F.floor(x)) & (F.abs(x) >= 1e7) & (F.abs(x) < 1e16)
    large = (F.abs(x) >= 1e7) & (F.abs(x) < 1e16)
    digits = F.regexp_replace(x.cast("string").cast("decimal(38,10)").cast("string"), "0+$", "")
    return (F.when(whole, F.concat(x.cast("long").cast("string"), F.lit(".0"))).when(large, digits)
            .otherwise(x.cast("string")))


def notification_outbox(events: DataFrame, webhooks: DataFrame) -> DataFrame:
    """F23 + J6: one webhook payload per event of a server that has a
    webhook.  The webhook table holds one row per server (bounded by the
    fleet size), so the join can broadcast it."""
    icon = F.when(F.col("state") == "FIRING", F.lit(ICON_FIRING)).otherwise(F.lit(ICON_OTHER))
    text = F.concat(icon, F.lit(" "), F.col("state"), F.lit(": "), F.col("metric_name"), F.lit(" "),
                    F.lit(OP_SYMBOL), F.lit(" "), plain_number(F.col("threshold")), F.lit(" em "),
                    F.col("server_id"), F.lit(" (valor: "), F.format_string("%.2f", F.col("value")), F.lit(")"))
    payload = F.to_json(F.struct(
        text.alias("text"), "server_id", "metric_name", "value", "threshold", "severity", "state",
        iso_seconds_or_micros(F.col("triggered_at")).alias("triggered_at")), {"ignoreNullFields": "false"})
    return (events.join(webhooks, "server_id", "inner")
            .select("event_id", "server_id", "url", text.alias("text"), payload.alias("payload")))
