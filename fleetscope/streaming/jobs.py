"""Structured Streaming jobs (S1, S3, R1, R6, R7, R8; R2 as availableNow).

Sources are pluggable: tests and local runs use file sources (JSON lines /
parquet); a deployment swaps in ``format("kafka")`` with the same
transformations.  Every query writes to a checkpointed sink, so a restart
resumes exactly where the last committed micro-batch ended (the reference
acks after insert and drops a batch after three failed inserts; here
failed tasks are retried and nothing is dropped).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fleetscope.sources import ingest
from fleetscope.sources.manifest import ManifestTable, append_rows, upsert_latest
from fleetscope.sources.sinks import append_layout

OFFLINE_AFTER_S = 90


def json_lines(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Stream of raw payload strings (column ``data``) from JSON-lines files."""
    return (spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path)
            .withColumnRenamed("value", "data"))


def _append_batches(raw: DataFrame, check, table_path: str, dead_path: str, checkpoint: str, ts: str,
                    keys: list[str], trigger_s: int):
    """Each micro-batch is parsed once; good rows go to the table, laid out as
    its batch appends are (month first, so a month bound lists its own folders
    only), bad ones with their reason to the dead letters.  Both are kept by
    batch id: a batch that runs again replaces what it wrote before."""
    def write(batch: DataFrame, batch_id: int) -> None:
        x = check(batch).withColumn("batch", F.lit(batch_id).cast("long")).persist()
        try:
            good = x.filter(F.col("reason").isNull()).drop("reason", "raw")
            (append_layout(good, ts, keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("month", "batch").parquet(table_path))
            (x.filter(F.col("reason").isNotNull()).select("raw", "reason", "batch").write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(dead_path))
        finally:
            x.unpersist()

    return (raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(processingTime=f"{trigger_s} seconds").start())


def metrics_to_table(raw: DataFrame, table_path: str, dead_path: str, checkpoint: str, trigger_s: int = 5):
    """S1 + S2 + R1: metric payloads (column ``data``) to the metrics table."""
    return _append_batches(raw, ingest.check_metrics, table_path, dead_path, checkpoint, "ts",
                           ["server_id", "metric_name"], trigger_s)


def logs_to_table(raw: DataFrame, table_path: str, dead_path: str, checkpoint: str, trigger_s: int = 5):
    """S3 + R1: flat log events to the log table."""
    return _append_batches(raw, ingest.check_logs, table_path, dead_path, checkpoint, "ts",
                           ["server_id", "log_file"], trigger_s)


def heartbeats_to_table(raw: DataFrame, table_path: str, dead_path: str, checkpoint: str, trigger_s: int = 5):
    """Heartbeat payloads (column ``data``) to the heartbeat table; the
    latest state per server (S5) is ``latest_heartbeats`` of that table."""
    return _append_batches(raw, ingest.check_heartbeats, table_path, dead_path, checkpoint, "timestamp",
                           ["server_id"], trigger_s)


def append_to_manifest(raw: DataFrame, check, table: ManifestTable, dead: ManifestTable, checkpoint: str, ts: str,
                       keys: list[str], trigger_s: int | None = 5):
    """R1 into a table whose files are listed by version, which can be compacted
    and expired while the stream runs.  ``check`` is a parser of ``ingest``;
    ``trigger_s`` None: until the input is used up."""
    def write(batch: DataFrame, batch_id: int) -> None:
        x = check(batch).persist()
        try:
            good = x.filter(F.col("reason").isNull()).drop("reason", "raw")
            append_rows(table, good, ts, keys, checkpoint, batch_id)
            bad = x.filter(F.col("reason").isNotNull()).select("raw", "reason", F.lit(batch_id).cast("long").alias("batch"))
            dead.append(bad, checkpoint, batch_id)
        finally:
            x.unpersist()

    w = raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if trigger_s is None else w.trigger(processingTime=f"{trigger_s} seconds")).start()


def heartbeats_to_latest(raw: DataFrame, table: ManifestTable, checkpoint: str, trigger_s: int | None = 5, buckets: int = 16):
    """Heartbeat payloads (column ``data``) merged into one row per server;
    ``table`` is partitioned by ``bucket``.  F7, P10 and P11 read it alone."""
    def write(batch: DataFrame, batch_id: int) -> None:
        good, _ = ingest.parse_heartbeats(batch)
        upsert_latest(table, good, ["server_id"], "timestamp", checkpoint, batch_id, buckets)

    w = raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if trigger_s is None else w.trigger(processingTime=f"{trigger_s} seconds")).start()


def latest_heartbeats(spark: SparkSession, table_path: str) -> DataFrame:
    """S5 over the heartbeat table: the last batch that has the server, and in
    it the newest instant."""
    order = F.struct("batch", "timestamp")
    return ingest.latest_heartbeat(spark.read.parquet(table_path), order).drop("batch", "month")


def features_to_table(metrics: DataFrame, metrics_path: str, features_path: str, checkpoint: str, buckets: int = 16):
    """R2 as an ``availableNow`` job: when samples have arrived since the last
    run, append the feature rows newer than each series' watermark.

    Watermarks are a table of their own beside the features (one row per series,
    dealt into ``buckets``), so no run scans what is stored.  A batch writes its
    features first, into folders of its id, and then its watermarks with its id:
    a batch that is run again either finds its id and stops, or computes from
    the watermarks before it and replaces its folders."""
    from fleetscope.operators import features

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marks = ManifestTable(spark, watermarks_of(features_path), "bucket")
        now = marks.snapshot()
        last = batch.agg(F.max(F.unix_micros("ts"))).first()[0]
        if last is None or now.batches.get(checkpoint, -1) >= batch_id:
            return
        before = marks.read(now.version).select("server_id", "metric_name", "watermark") if now.files else None
        as_of = datetime(1970, 1, 1) + timedelta(microseconds=last)
        new = features.incremental_features(spark.read.parquet(metrics_path), None, as_of, watermarks=before)
        new = new.withColumn("batch", F.lit(batch_id).cast("long")).persist()
        try:
            (append_layout(new, "ts", ["server_id", "metric_name"]).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("month", "batch").parquet(features_path))
            top = new.groupBy("server_id", "metric_name").agg(F.max("ts").alias("watermark"))
            upsert_latest(marks, top, ["server_id", "metric_name"], "watermark", checkpoint, batch_id, buckets)
        finally:
            new.unpersist()

    return (metrics.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def watermarks_of(features_path: str) -> str:
    """Where the watermarks of a feature table lie."""
    return features_path.rstrip("/") + "_watermarks"


def partials_to_table(rows: DataFrame, reduce, table: ManifestTable, checkpoint: str, keys: list[str],
                      trigger_s: int | None = 60):
    """Keep a rollup: the partials (``operators.rollups``) of each micro-batch
    are appended once, by batch id; ``reduce`` makes them from rows.  Late rows
    are partials of an older bucket.  ``trigger_s`` None: until the input is
    used up."""
    def write(batch: DataFrame, batch_id: int) -> None:
        append_rows(table, reduce(batch), "bucket", keys, checkpoint, batch_id)

    w = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if trigger_s is None else w.trigger(processingTime=f"{trigger_s} seconds")).start()


def live_tail(logs: DataFrame, server_id: str, log_file: str) -> DataFrame:
    """The rows of one log as they arrive (start with a 1 s trigger).
    Every row is delivered once; unlike polling ``ts > last_ts`` no row that
    shares the last timestamp is lost."""
    return logs.filter((F.col("server_id") == server_id) & (F.col("log_file") == log_file))


def tail_to_table(logs: DataFrame, server_id: str, log_file: str, path: str, checkpoint: str, every_s: int = 1):
    """R6 as a started job: every second the new rows of one log go to ``path``,
    in a folder of their batch that a repeated batch replaces."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (live_tail(logs, server_id, log_file).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(processingTime=f"{every_s} seconds").start())


def bucket_counts(metrics: DataFrame, minutes: int = 2, lateness: str = "10 minutes") -> DataFrame:
    """Tumbling-window means per series with a watermark, so append mode
    emits each bucket once when it can no longer change."""
    return (metrics.withWatermark("ts", lateness)
            .groupBy("server_id", "metric_name", F.window("ts", f"{minutes} minutes").alias("bucket"))
            .agg(F.avg("value").alias("avg_value"), F.count(F.lit(1)).alias("n")))


STATUS_SCHEMA = "server_id string, status string, at timestamp"
STATE_SCHEMA = "last_seen timestamp, online boolean"


def _presence(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    (server_id,) = key
    if state.hasTimedOut:
        last_seen = state.get[0]
        state.remove()
        yield pd.DataFrame({"server_id": [server_id], "status": ["offline"],
                            "at": [last_seen + pd.Timedelta(seconds=OFFLINE_AFTER_S)]})
        return
    latest = None
    for pdf in batches:
        m = pdf["timestamp"].max()
        latest = m if latest is None or m > latest else latest
    was_online = state.exists and state.get[1]
    if state.exists and state.get[0] is not None and state.get[0] > latest:
        latest = state.get[0]
    state.update((latest, True))
    state.setTimeoutTimestamp(int(latest.timestamp() * 1000) + OFFLINE_AFTER_S * 1000)
    if not was_online:
        yield pd.DataFrame({"server_id": [server_id], "status": ["online"], "at": [latest]})


def presence_transitions(heartbeats: DataFrame, lateness: str = "30 seconds") -> DataFrame:
    """R7 (stream): online when a heartbeat arrives for a server that was
    not online; offline when 90 s of event time pass without one (event-time
    timer per server in keyed state)."""
    hb = heartbeats.select("server_id", F.col("timestamp").cast("timestamp").alias("timestamp"))
    return (hb.withWatermark("timestamp", lateness).groupBy("server_id")
            .applyInPandasWithState(_presence, STATUS_SCHEMA, STATE_SCHEMA, "append",
                                    GroupStateTimeout.EventTimeTimeout))


def heartbeat_gaps(heartbeats: DataFrame, offline_after_s: int = OFFLINE_AFTER_S) -> DataFrame:
    """R7 (batch history): offline spells = gaps longer than 90 s between
    consecutive heartbeats of a server (chunk-safe previous-row lookup)."""
    from fleetscope.operators.chunked import with_previous
    x = with_previous(heartbeats.select("server_id", "timestamp"), ["server_id"], "timestamp", [], prefix="prev_")
    gap = F.unix_micros("timestamp") - F.unix_micros("prev_timestamp")
    return (x.filter(gap > offline_after_s * 1_000_000)
            .select("server_id", F.col("prev_timestamp").alias("last_seen"),
                    (F.col("prev_timestamp") + F.expr(f"INTERVAL {offline_after_s} SECONDS")).alias("offline_at"),
                    F.col("timestamp").alias("back_online_at")))


def uptime_sessions(heartbeats: DataFrame, offline_after_s: int = OFFLINE_AFTER_S) -> DataFrame:
    """Spells of a server being online: heartbeats at most ``offline_after_s``
    apart (a beat after exactly 90 s still belongs to the spell).  The spells and
    ``heartbeat_gaps`` complement each other.

    A stream takes a watermark first and, in append mode, emits a spell when no
    heartbeat can lengthen it any more; its spells are merged in each input
    partition before the shuffle (a setting of ``configure``).  In batch they are
    made per (server, chunk of time) and then joined over the chunks' borders, so
    a hot server is one row a chunk where it comes together."""
    spell = F.session_window("timestamp", f"{offline_after_s} seconds").alias("_spell")
    beats = [F.min("timestamp").alias("online_from"), F.max("timestamp").alias("last_seen"), F.count(F.lit(1)).alias("heartbeats")]
    if heartbeats.isStreaming:
        return heartbeats.groupBy("server_id", spell).agg(*beats).drop("_spell")
    from fleetscope.operators.chunked import chunk_size
    from fleetscope.sources.bindings import idiv
    chunk = idiv(F.unix_micros("timestamp"), chunk_size()).alias("_chunk")
    parts = heartbeats.select("server_id", "timestamp", chunk).groupBy("server_id", "_chunk", spell).agg(*beats)
    w = Window.partitionBy("server_id").orderBy("online_from")
    apart = F.unix_micros("online_from") - F.unix_micros(F.lag("last_seen").over(w))
    fresh = F.when(apart <= offline_after_s * 1_000_000, 0).otherwise(1)
    return (parts.withColumn("_new", fresh).withColumn("_nr", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("server_id", "_nr").agg(F.min("online_from").alias("online_from"), F.max("last_seen").alias("last_seen"),
                                             F.sum("heartbeats").alias("heartbeats")).drop("_nr"))


# --- alert evaluation (R3 streaming twin) -----------------------------------

ALERT_EVENT_SCHEMA = ("event_id string, server_id string, rule_id string, metric_name string, threshold double, "
                      "severity string, state string, triggered_at timestamp, value double")
ALERT_STATE_SCHEMA = "state string, resolved_us long"


def _alert_fsm(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """FIRING / RESOLVED transitions of one (server, rule) over the ticks of
    one micro-batch (a handful per trigger), state kept in the state store."""
    cur, resolved = state.get if state.exists else ("INACTIVE", None)
    rows = pd.concat(list(batches)).sort_values("tick_us")
    out = []
    for r in rows.itertuples(index=False):
        if r.breached and cur != "FIRING":
            if resolved is not None and r.tick_us - resolved < r.cooldown_us:
                continue
            cur = "FIRING"
            out.append((r.server_id, r.rule_id, r.metric_name, r.threshold, r.severity, cur, r.tick_us, r.value))
        elif not r.breached and cur == "FIRING":
            cur, resolved = "RESOLVED", int(r.tick_us)
            out.append((r.server_id, r.rule_id, r.metric_name, r.threshold, r.severity, cur, r.tick_us, r.value))
    state.update((cur, None if resolved is None else int(resolved)))
    df = pd.DataFrame(out, columns=["server_id", "rule_id", "metric_name", "threshold", "severity", "state", "tick_us",
                                    "value"])
    df["event_id"] = [hashlib.md5("|".join((r.server_id, r.rule_id, r.state, str(r.tick_us))).encode()).hexdigest()
                      for r in df.itertuples(index=False)]
    df["triggered_at"] = pd.to_datetime(df["tick_us"].astype("int64"), unit="us")
    yield df[["event_id", "server_id", "rule_id", "metric_name", "threshold", "severity", "state", "triggered_at", "value"]]


def alert_state_machine(ticks: DataFrame) -> DataFrame:
    """R3/R4 stream: breach ticks (``operators.alert_replay.breach_ticks``
    rows, or one ``alerts.evaluate_once`` result per trigger) -> alert
    events, keyed by (server, rule) with the rule's state in the state store."""
    return (ticks.groupBy("server_id", "rule_id")
            .applyInPandasWithState(_alert_fsm, ALERT_EVENT_SCHEMA, ALERT_STATE_SCHEMA, "append",
                                    GroupStateTimeout.NoTimeout))


def evaluator(trigger_source: DataFrame, tables: dict[str, str], ticks_path: str, checkpoint: str,
              every_s: int = 30):
    """The 30-second evaluator: on every trigger, evaluate all rules of
    servers with a heartbeat at the trigger time and append the breach rows
    to the ticks table that ``alert_state_machine`` streams from.

    ``tables`` holds the paths of rules, heartbeats, metrics and scores; they
    are listed anew in each trigger, so rows appended since are seen.  The
    instant is the batch's newest ``timestamp``, in microseconds: a batch that
    is run again evaluates the same instant, whatever zone the driver is in."""
    from fleetscope.operators import alerts as A

    def run(batch: DataFrame, batch_id: int) -> None:
        now_us = batch.agg(F.max(F.unix_micros("timestamp"))).first()[0]
        if now_us is None:
            return
        now = datetime(1970, 1, 1) + timedelta(microseconds=now_us)
        rules, heartbeats, metrics, scores = (batch.sparkSession.read.parquet(tables[t])
                                              for t in ("rules", "heartbeats", "metrics", "scores"))
        ev = A.evaluate_once(rules, heartbeats, metrics, scores, now)
        (ev.select("server_id", "rule_id", "metric_name", "threshold", "severity",
                   F.lit(now_us).cast("long").alias("tick_us"), "value", "breached",
                   (F.col("cooldown_minutes").cast("long") * 60_000_000).alias("cooldown_us"))
         .write.mode("overwrite").parquet(f"{ticks_path}/batch={batch_id}"))

    return (trigger_source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(processingTime=f"{every_s} seconds").start())
