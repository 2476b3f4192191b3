"""R3 + R4 + S5 as one stateful stream: everything the evaluator knows about a
server lives in keyed state, and timers evaluate its rules every 30 seconds.

The input is one stream of records of four kinds, made by ``signals``:
samples, scores, rule versions and heartbeats.  State per server, in the
RocksDB store:

* ``heartbeat`` (value): the last heartbeat by arrival;
* ``rules`` (map rule_id -> newest version of the rule);
* ``recent`` (list): partials of the last five minutes, one per metric and
  30-second bucket, whatever the sampling rate;
* ``alerts`` (map rule_id -> FIRING or RESOLVED, and when it resolved);
* ``clock`` (value): the next tick to evaluate, which has the only timer.

A tick is evaluated when the watermark has passed it, so no sample of its
window can still come; catching up over many ticks takes one timer.  The same
samples give the events of ``operators.alert_replay`` in any split into
batches, and across restarts.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetscope.operators.alert_replay import SERIES
from fleetscope.sources.ingest import DEFAULT_COOLDOWN

PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

TICK_MS, WINDOW_TICKS = 30_000, 10          # every 30 s over the last 5 minutes

SIGNAL = ("kind string, server_id string, ts timestamp, metric_name string, bucket_ms long, value double, at_us long, "
          "edge_value double, edge_at_us long, rule_id string, operator string, threshold double, severity string, "
          "alert_mode string, ml_score_threshold double, cooldown_us long, version long, enabled boolean, beat_us long, "
          "agent_version string")
EVENT = ("event_id string, server_id string, rule_id string, metric_name string, threshold double, severity string, "
         "state string, triggered_at timestamp, value double")
RULE_FIELDS = ("metric_name string, operator string, threshold double, severity string, alert_mode string, "
               "ml_score_threshold double, cooldown_us long, version long, enabled boolean")


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB state store."""
    spark.conf.set(PROVIDER_CONF, ROCKSDB)


# ---- the input --------------------------------------------------------------

def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Samples or scores of one batch as partials per (server, metric, bucket),
    so a server with most of the samples sends few rows to its state.  A bucket
    is the first tick at or after its samples; a sample exactly on a tick is
    seen by one tick more, so those have a partial of their own.  ``newest``
    says that the latest row of a bucket counts instead of the largest."""
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        us = pc.cast(t.column("ts"), pa.int64())
        tick = TICK_MS * 1000
        bucket = pc.multiply(pc.divide(pc.add(us, tick - 1 if pc.min(us).as_py() >= 0 else 0), tick), tick)
        edge = pc.equal(us, bucket)
        t = t.append_column("us", us).append_column("bucket", bucket).append_column(
            "edge_value", pc.if_else(edge, t.column("value"), None)).append_column("edge_us", pc.if_else(edge, us, None))
        # rows of a group in rising order of what counts: its last one is kept
        newest = t.column("kind")[0].as_py() == "score"
        order = ["us", "value"] if newest else ["value", "us"]
        t = t.sort_by([("server_id", "ascending"), ("metric_name", "ascending"), ("bucket", "ascending"),
                       *[(c, "ascending") for c in order]])
        g = t.group_by(["server_id", "metric_name", "bucket"], use_threads=False).aggregate(
            [("kind", "first"), ("ts", "max"), ("value", "last"), ("us", "last"), ("edge_value", "last"), ("edge_us", "last")])
        yield pa.RecordBatch.from_arrays(
            [g.column(c).combine_chunks() for c in ("kind_first", "server_id", "ts_max", "metric_name")]
            + [pc.divide(g.column("bucket"), 1000).combine_chunks()]
            + [g.column(c).combine_chunks() for c in ("value_last", "us_last", "edge_value_last", "edge_us_last")],
            ["kind", "server_id", "ts", "metric_name", "bucket_ms", "value", "at_us", "edge_value", "edge_at_us"])


PARTIAL = ("kind string, server_id string, ts timestamp, metric_name string, bucket_ms long, value double, at_us long, "
           "edge_value double, edge_at_us long")


def _partials(rows: DataFrame, kind: str, value: str) -> DataFrame:
    x = rows.select(F.lit(kind).alias("kind"), *SERIES, F.col("ts").cast("timestamp").alias("ts"),
                    F.col(value).cast("double").alias("value"))
    x = x.where(F.col("server_id").isNotNull() & F.col("metric_name").isNotNull() & F.col("ts").isNotNull()
                & F.col("value").isNotNull() & ~F.isnan("value"))
    return x.mapInArrow(_combine, PARTIAL)


def _fill(rows: DataFrame) -> DataFrame:
    """The columns of ``SIGNAL``, those that the kind lacks as nulls."""
    from pyspark.sql.types import _parse_datatype_string
    schema = _parse_datatype_string(SIGNAL)
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns
                         else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def signals(metrics: DataFrame, scores: DataFrame | None = None, rules: DataFrame | None = None,
            heartbeats: DataFrame | None = None, lateness: str = "30 seconds") -> DataFrame:
    """One stream of what the processor reads.  ``metrics`` (server_id,
    metric_name, ts, value) and ``scores`` (..., score) set the watermark;
    ``rules`` (rule versions) and ``heartbeats`` (server_id, timestamp,
    agent_version) take effect when they arrive and have no event time: an old
    rule is not late.  Samples without a number, a series or an instant are
    left out."""
    out = _fill(_partials(metrics, "sample", "value"))
    if scores is not None:
        out = out.unionByName(_fill(_partials(scores, "score", "score")))
    if rules is not None:
        out = out.unionByName(_fill(rules.where("server_id is not null and rule_id is not null").withColumns(
            {"kind": F.lit("rule"), "cooldown_us": F.coalesce("cooldown_minutes", F.lit(DEFAULT_COOLDOWN)).cast("long") * 60_000_000}).drop("ts")))
    if heartbeats is not None:
        out = out.unionByName(_fill(heartbeats.where("server_id is not null").select(
            F.lit("beat").alias("kind"), "server_id", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("beat_us"),
            F.col("agent_version").cast("string").alias("agent_version"))))
    return out.withWatermark("ts", lateness)


# ---- the processor ----------------------------------------------------------

def compare(op: str, value: float, threshold: float) -> bool | None:
    """P5: an unknown operator has no answer."""
    return {">": value > threshold, "<": value < threshold, ">=": value >= threshold, "<=": value <= threshold,
            "==": value == threshold}.get(op)


def breached(rule: dict, value: float, score: float | None) -> bool | None:
    """The rule's flag by its mode; ml without a score falls back to static."""
    static = compare(rule["operator"], value, rule["threshold"])
    if static is None:
        return None
    ml = score is not None and score >= rule["ml_score_threshold"]
    mode = rule["alert_mode"] or "static"
    return {"static": static, "ml": static if score is None else ml, "both": static or ml}.get(mode, False)


def _is(x) -> bool:
    return x is not None and not (isinstance(x, float) and math.isnan(x)) and x is not pd.NaT


#: Rows of several kinds share columns, so pandas may hold whole numbers as floats.
RULE_COLUMNS = [tuple(f.split()) for f in RULE_FIELDS.split(", ")]


def _plain(x, kind: str):
    return None if not _is(x) else {"string": str, "double": float, "long": int, "boolean": bool}[kind](x)


def spread(partials: list[tuple], kind: str, first: int, last: int) -> dict[str, dict[int, tuple]]:
    """metric -> tick -> (value, us) over the ticks first .. last: the largest
    sample, or the newest score, of the five minutes that end with the tick."""
    out: dict[str, dict[int, tuple]] = defaultdict(dict)
    order = (lambda p: p[0]) if kind == "sample" else (lambda p: (p[1], p[0]))
    for k, metric, bucket, value, at, edge_value, edge_at in partials:
        if k != kind:
            continue
        ticks = out[metric]
        for n in range(WINDOW_TICKS + 1):
            p = (value, at) if n < WINDOW_TICKS else (edge_value, edge_at)
            tick = bucket + n * TICK_MS
            if first <= tick <= last and _is(p[0]) and (tick not in ticks or order(p) > order(ticks[tick])):
                ticks[tick] = p
    return out


class AlertProcessor(StatefulProcessor):
    """See the module: one server's rules, recent values and alert states."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.heartbeat = handle.getValueState("heartbeat", "beat_us long, agent_version string")
        self.rules = handle.getMapState("rules", "rule_id string", RULE_FIELDS)
        self.recent = handle.getListState("recent", "kind string, metric_name string, bucket_ms long, value double, "
                                                    "at_us long, edge_value double, edge_at_us long")
        self.alerts = handle.getMapState("alerts", "rule_id string", "state string, resolved_us long")
        self.clock = handle.getValueState("clock", "tick_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        merged, versions, beat = {}, {}, None
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                if r.kind == "beat":
                    beat = (int(r.beat_us), r.agent_version)
                elif r.kind == "rule":
                    if r.rule_id not in versions or r.version > versions[r.rule_id][7]:
                        versions[r.rule_id] = tuple(_plain(getattr(r, c), kind) for c, kind in RULE_COLUMNS)
                else:
                    self._merge(merged, (r.kind, r.metric_name, int(r.bucket_ms), r.value, r.at_us, r.edge_value, r.edge_at_us))
        if beat is not None:
            self.heartbeat.update(beat)
        for rid, rule in versions.items():
            old = self.rules.getValue((rid,)) if self.rules.containsKey((rid,)) else None
            if old is None or rule[7] > old[7]:
                self.rules.updateValue((rid,), rule)
        if merged:
            oldest = min(k[2] for k in merged)
            for p in self.recent.get():
                self._merge(merged, tuple(p))
            self.recent.put([self._row(k, v) for k, v in sorted(merged.items())])
            self._wake(oldest)
        yield from ()

    @staticmethod
    def _merge(merged: dict, p: tuple) -> None:
        kind, metric, bucket, value, at, edge_value, edge_at = p
        full = (value, int(at))
        edge = (edge_value, int(edge_at)) if _is(edge_value) else None
        old = merged.get((kind, metric, bucket))
        order = (lambda x: x[0]) if kind == "sample" else (lambda x: (x[1], x[0]))
        if old is not None:
            full = max(full, old[0], key=order)
            edge = max((e for e in (edge, old[1]) if e is not None), key=order, default=None)
        merged[kind, metric, bucket] = (full, edge)

    @staticmethod
    def _row(k: tuple, v: tuple) -> tuple:
        return (*k, float(v[0][0]), v[0][1], *((float(v[1][0]), v[1][1]) if v[1] else (None, None)))

    def _wake(self, tick: int) -> None:
        """The timer stands at the first tick that is still to be evaluated."""
        now = self.clock.get()[0] if self.clock.exists() else None
        if now is not None and now <= tick:
            return
        if now is not None:
            self.handle.deleteTimer(now)
        self.clock.update((tick,))
        self.handle.registerTimer(tick)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first = expiredTimerInfo.getExpiryTimeInMs()
        last = timerValues.getCurrentWatermarkInMs() // TICK_MS * TICK_MS
        partials = [tuple(p) for p in self.recent.get()]
        events = self._evaluate(key[0], partials, first, last) if self.heartbeat.exists() else []
        # what the next tick can still see
        left = [p for p in partials if p[2] + WINDOW_TICKS * TICK_MS > last]
        self.clock.clear()
        if left:
            self.recent.put(left)
            after = max(last + TICK_MS, min(p[2] for p in left))
            self.clock.update((after,))
            self.handle.registerTimer(after)
        else:
            self.recent.clear()
        if events:
            yield pd.DataFrame(events, columns=[c.split()[0] for c in EVENT.split(", ")])

    def _evaluate(self, server: str, partials: list[tuple], first: int, last: int) -> list[tuple]:
        values, scores = (spread(partials, k, first, last) for k in ("sample", "score"))
        states = {k[0]: tuple(v) for k, v in self.alerts.iterator()}
        events = []
        for (rid,), row in self.rules.iterator():
            rule = {c: x for (c, _), x in zip(RULE_COLUMNS, row)}
            if not rule["enabled"]:
                continue
            state, resolved = before = states.get(rid, ("INACTIVE", None))
            for tick, (value, _) in sorted(values.get(rule["metric_name"], {}).items()):
                flag = breached(rule, value, scores.get(rule["metric_name"], {}).get(tick, (None,))[0])
                us = tick * 1000
                if flag and state != "FIRING":
                    if resolved is not None and us - resolved < rule["cooldown_us"]:
                        continue
                    state = "FIRING"
                elif flag is False and state == "FIRING":
                    state, resolved = "RESOLVED", us
                else:
                    continue
                digest = hashlib.md5("|".join((server, rid, state, str(us))).encode()).hexdigest()
                events.append((digest, server, rid, rule["metric_name"], rule["threshold"], rule["severity"], state,
                               pd.Timestamp(us, unit="us"), value))
            if (state, resolved) != before:
                self.alerts.updateValue((rid,), (state, resolved))
        return events

    def close(self) -> None:
        pass


def alert_events(signal: DataFrame) -> DataFrame:
    """FIRING / RESOLVED events of ``signals``, appended as they happen; the
    event id is made from server, rule, state and instant, so an event written
    twice by a retried batch is the same row.  Servers without a heartbeat are
    not evaluated, and their ticks pass; a tick without a sample in its window,
    or a rule with an unknown operator, changes nothing.  Rules act from the
    batch in which they arrive; the newest version counts."""
    use_rocksdb(signal.sparkSession)
    return signal.groupBy("server_id").transformWithStateInPandas(
        AlertProcessor(), EVENT, "append", "eventTime")


def alerts_to_table(signal: DataFrame, path: str, checkpoint: str, every_s: int | None = 30):
    """Start the evaluator (``every_s`` None: until the input is used up): each
    batch replaces what an earlier attempt at it wrote."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path))

    w = alert_events(signal).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if every_s is None else w.trigger(processingTime=f"{every_s} seconds")).start()


def stored_heartbeats(spark: SparkSession, checkpoint: str) -> DataFrame:
    """S5 out of the evaluator's own state: (server_id, timestamp,
    agent_version), the last heartbeat of each server by arrival."""
    use_rocksdb(spark)
    x = spark.read.format("statestore").option("stateVarName", "heartbeat").load(checkpoint)
    return x.select(F.col("key.server_id").alias("server_id"), F.timestamp_micros("value.beat_us").alias("timestamp"),
                    F.col("value.agent_version").alias("agent_version"))
