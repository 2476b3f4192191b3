"""Streaming jobs on file sources: the stream equals the batch form."""

import os
import tempfile

from pyspark.sql import functions as F

from fleetscope.plans.q_ingest import metric_payloads
from fleetscope.sources import ingest
from fleetscope.streaming import jobs
from tests.conftest import SMALL


def test_metric_stream_matches_batch(spark):
    d = tempfile.mkdtemp(prefix="fs-stream-")
    src, out, dead, ck = (os.path.join(d, x) for x in ("src", "out", "dead", "ck"))
    payloads = metric_payloads(spark, SMALL)
    payloads.select("data").write.text(src)
    q = jobs.metrics_to_table(jobs.json_lines(spark, src), out, dead, ck)
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(out).count()
    good, bad = ingest.parse_metrics(payloads)
    assert got == good.count()
    assert spark.read.parquet(dead).count() == bad.count()


def test_log_and_heartbeat_streams_match_batch(spark):
    import json
    d = tempfile.mkdtemp(prefix="fs-streams-")
    logs = [("a", "auth.log", f"2024-01-{1 + i % 28:02d}T00:00:00Z" if i % 7 else "never", f"line {i}\r\n" if i % 5 else "\n")
            for i in range(60)]
    raw = spark.createDataFrame(logs, "server_id string, log_file string, timestamp string, line string").repartition(3)
    raw.write.parquet(f"{d}/logs")
    beats = [json.dumps({"server_id": f"s{i % 4}", "timestamp": f"2024-01-01T00:00:{i:02d}Z", "agent_version": str(i)}) for i in range(40)]
    beats += ["not json", '{"server_id": "x", "timestamp": "soon"}']
    hb = spark.createDataFrame([(b,) for b in beats], "data string").coalesce(1)
    hb.write.text(f"{d}/beats")

    def run(q):
        q.processAllAvailable()
        q.stop()
    run(jobs.logs_to_table(spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/logs"),
                           f"{d}/log_table", f"{d}/log_dead", f"{d}/ck1"))
    run(jobs.heartbeats_to_table(jobs.json_lines(spark, f"{d}/beats"), f"{d}/hb_table", f"{d}/hb_dead", f"{d}/ck2"))
    for (good, bad), table in ((ingest.parse_logs(raw), "log"), (ingest.parse_heartbeats(hb), "hb")):
        assert spark.read.parquet(f"{d}/{table}_table").count() == good.count() > 0
        assert spark.read.parquet(f"{d}/{table}_dead").count() == bad.count() > 0
    latest = {r.server_id: r.agent_version for r in jobs.latest_heartbeats(spark, f"{d}/hb_table").collect()}
    assert latest == {f"s{i}": str(36 + i) for i in range(4)}


def test_feature_job_runs_twice_to_the_full_table(spark):
    from datetime import timedelta

    from fleetscope.operators import features
    from fleetscope.plans.catalog import AS_OF_FAST_TS
    from fleetscope.sources import bindings as B
    d = tempfile.mkdtemp(prefix="fs-features-")
    m = B.metrics_fast(spark, SMALL).select("server_id", "metric_name", "ts", "value")
    cut = F.lit((AS_OF_FAST_TS - timedelta(minutes=40)).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")
    for part in (m.filter(F.col("ts") < cut), m.filter(F.col("ts") >= cut)):
        part.write.mode("append").parquet(f"{d}/metrics")
        q = jobs.features_to_table(spark.readStream.schema(m.schema).parquet(f"{d}/metrics"), f"{d}/metrics", f"{d}/features", f"{d}/ck")
        q.awaitTermination()
    got, want = spark.read.parquet(f"{d}/features"), features.compute_features(m)
    key = ["server_id", "metric_name", "ts", "raw_value", "rate_of_change"]
    assert got.count() == want.count()
    assert got.select(*key).exceptAll(want.select(*key)).count() == 0


def test_bucket_counts_stream(spark):
    from fleetscope.sources import bindings as B
    d = tempfile.mkdtemp(prefix="fs-buckets-")
    m = B.metrics_fast(spark, SMALL).select("server_id", "metric_name", "ts", "value")
    m.write.parquet(os.path.join(d, "m"))
    s = spark.readStream.schema(m.schema).parquet(os.path.join(d, "m"))
    q = (jobs.bucket_counts(s).writeStream.outputMode("update").format("memory").queryName("buckets_t")
         .option("checkpointLocation", os.path.join(d, "ck")).start())
    q.processAllAvailable()
    q.stop()
    total = spark.sql("SELECT sum(n) AS n FROM buckets_t").first().n
    assert total == m.count()


def test_presence_transitions(spark):
    d = tempfile.mkdtemp(prefix="fs-presence-")
    hb = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:30"),
                                ("b", "2024-01-01 00:00:10")], "server_id string, t string")
    hb = hb.select("server_id", F.to_timestamp("t").alias("timestamp"))
    hb.write.parquet(os.path.join(d, "hb1"))
    s = spark.readStream.schema(hb.schema).parquet(os.path.join(d, "hb1"))
    q = (jobs.presence_transitions(s).writeStream.outputMode("append").format("memory").queryName("presence_t")
         .option("checkpointLocation", os.path.join(d, "ck")).start())
    q.processAllAvailable()
    q.stop()
    rows = {(r.server_id, r.status) for r in spark.sql("SELECT * FROM presence_t").collect()}
    assert ("a", "online") in rows and ("b", "online") in rows


def test_live_tail_delivers_every_row(spark):
    from fleetscope.sources import bindings as B
    d = tempfile.mkdtemp(prefix="fs-tail-")
    lg = B.logs(spark, SMALL).select("server_id", "log_file", "ts", "line")
    lg.write.parquet(os.path.join(d, "logs"))
    s = spark.readStream.schema(lg.schema).parquet(os.path.join(d, "logs"))
    q = (jobs.live_tail(s, "srv-1", "auth.log").writeStream.format("memory").queryName("tail_t")
         .option("checkpointLocation", os.path.join(d, "ck")).trigger(processingTime="1 second").start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT count(*) AS n FROM tail_t").first().n
    assert got == lg.filter("server_id = 'srv-1' AND log_file = 'auth.log'").count()


def test_alert_stream_matches_batch_replay(spark):
    from fleetscope.operators import alert_replay as R
    from fleetscope.plans.catalog import AS_OF_FAST_TS
    from fleetscope.plans.q_series import scores
    from fleetscope.sources import bindings as B
    d = tempfile.mkdtemp(prefix="fs-alerts-")
    ticks = R.breach_ticks(B.alert_rules(spark, SMALL), B.metrics_fast(spark, SMALL), scores(spark, SMALL),
                           AS_OF_FAST_TS)
    # several files in tick order -> several micro-batches
    ticks = ticks.withColumn("part", (F.col("tick_us") / 1_800_000_000).cast("long"))
    ticks.repartition("part").sortWithinPartitions("tick_us").write.partitionBy("part").parquet(f"{d}/ticks")
    schema = spark.read.parquet(f"{d}/ticks").schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/ticks")
    q = (jobs.alert_state_machine(s).writeStream.outputMode("append").format("memory").queryName("alerts_t")
         .option("checkpointLocation", f"{d}/ck").start())
    q.processAllAvailable()
    q.stop()
    got = sorted((r.server_id, r.rule_id, r.state, r.us) for r in spark.sql(
        "SELECT server_id, rule_id, state, unix_micros(triggered_at) AS us FROM alerts_t").collect())
    exp = sorted((r.server_id, r.rule_id, r.state, r.us) for r in R.replay(ticks.drop("part")).select(
        "server_id", "rule_id", "state", F.unix_micros("triggered_at").alias("us")).collect())
    assert got == exp and len(exp) > 0


def test_hst_stream_matches_replay(spark):
    from fleetscope.operators.anomaly import hst
    from fleetscope.sources import bindings as B
    d = tempfile.mkdtemp(prefix="fs-hst-")
    m = (B.metrics_fast(spark, SMALL).select("server_id", "metric_name", "ts", "value")
         .filter(F.col("server_id").isin("srv-0", "srv-1")))
    m = m.withColumn("part", (F.unix_micros("ts") / 1_800_000_000).cast("long"))
    m.repartition("part").write.partitionBy("part").parquet(f"{d}/m")
    schema = spark.read.parquet(f"{d}/m").schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/m").drop("part")
    q = (hst.stream_scores(s, window=10).writeStream.outputMode("append").format("memory").queryName("hst_t")
         .option("checkpointLocation", f"{d}/ck").start())
    q.processAllAvailable()
    q.stop()
    got = {(r.server_id, r.metric_name, r.ts): r.score for r in spark.sql("SELECT * FROM hst_t").collect()}
    exp = {(r.server_id, r.metric_name, r.ts): r.score
           for r in hst.online_scores(m.drop("part"), window=10).collect()}
    assert got.keys() == exp.keys() and len(exp) > 0
    assert all(abs(got[k] - exp[k]) < 1e-12 for k in exp)


def test_evaluator_rereads_its_tables_and_feeds_the_state_machine(spark):
    from fleetscope.operators import alerts as A
    from fleetscope.plans.catalog import AS_OF_FAST_TS
    from fleetscope.plans.q_series import scores
    from fleetscope.sources import bindings as B
    d = tempfile.mkdtemp(prefix="fs-evaluator-")
    tables = {t: f"{d}/{t}" for t in ("rules", "heartbeats", "metrics", "scores")}
    B.alert_rules(spark, SMALL).write.parquet(tables["rules"])
    B.heartbeats(spark, SMALL).write.parquet(tables["heartbeats"])
    scores(spark, SMALL).write.parquet(tables["scores"])
    m = B.metrics_fast(spark, SMALL).select("server_id", "metric_name", "ts", "value")
    m.limit(0).write.parquet(tables["metrics"])
    spark.createDataFrame([(AS_OF_FAST_TS.strftime("%Y-%m-%d %H:%M:%S.%f"),)], "t string").select(
        F.to_timestamp("t").alias("timestamp")).write.parquet(f"{d}/clock")

    def tick():
        source = spark.readStream.schema("timestamp timestamp").parquet(f"{d}/clock")
        q = jobs.evaluator(source, tables, f"{d}/ticks", f"{d}/ck", every_s=0)
        q.processAllAvailable()
        q.stop()
    tick()
    assert spark.read.parquet(f"{d}/ticks").count() == 0
    m.write.mode("append").parquet(tables["metrics"])                      # samples arrive after the start
    spark.read.parquet(f"{d}/clock").write.mode("append").parquet(f"{d}/clock")
    tick()
    ticks = spark.read.parquet(f"{d}/ticks")
    want = A.evaluate_once(B.alert_rules(spark, SMALL), B.heartbeats(spark, SMALL), m, scores(spark, SMALL), AS_OF_FAST_TS)
    got = sorted((r.server_id, r.rule_id, r.value, r.breached) for r in ticks.collect())
    assert got == sorted((r.server_id, r.rule_id, r.value, r.breached) for r in want.collect()) and got
    q = (jobs.alert_state_machine(spark.readStream.schema(ticks.schema).parquet(f"{d}/ticks")).writeStream
         .outputMode("append").format("memory").queryName("evaluator_t").option("checkpointLocation", f"{d}/ck2").start())
    q.processAllAvailable()
    q.stop()
    events = spark.sql("SELECT * FROM evaluator_t")
    assert events.count() == sum(b for *_, b in got)
    hooks = spark.createDataFrame([(f"srv-{i}", "https://hooks.example.invalid/x") for i in range(5)], "server_id string, url string")
    assert A.notification_outbox(events, hooks).count() == events.count()


def test_online_stream_at_the_default_window(spark):
    """Score slices end at window borders: batches of any size equal the replay."""
    import numpy as np
    import pandas as pd

    from fleetscope.operators.anomaly import hst
    rng = np.random.default_rng(3)
    n = 1100
    m = pd.DataFrame({"server_id": "s", "metric_name": "m", "value": rng.uniform(0, 1, n),
                      "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) * 60, unit="s")})
    df = spark.createDataFrame(m, "server_id string, metric_name string, value double, ts timestamp")
    want = {r.ts: r.score for r in hst.online_scores(df).collect()}
    rows = hst.with_time_features(df).orderBy("ts").toPandas()

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value
    state, fn = State(), hst._stream_fn(*hst.make_trees(len(hst.FEATURES)), hst.HEIGHT, hst.WINDOW)
    got, a = {}, 0
    for size in (7, 243, 251, 499, 100):
        for out in fn(("s", "m"), iter([rows.iloc[a:a + size]]), state):
            got.update(zip(out.ts.tolist(), out.score))
        a += size
    assert a == n and len(want) == n
    assert all(abs(want[t] - s) < 1e-12 for t, s in got.items()) and max(got.values()) > 0


def test_heartbeat_gaps_hold_no_message(spark):
    """A server that sent heartbeats all along is not reported as offline."""
    from fleetscope.plans import catalog
    from fleetscope.sources import bindings as B
    messages = B.heartbeat_messages(spark, SMALL).select(F.col("server_id").alias("of"), "timestamp")
    for name in ("R7_heartbeat_gaps", "R7_heartbeat_gaps_event_clock"):
        beats = messages if name == "R7_heartbeat_gaps" else B.heartbeat_messages(spark, SMALL, clock="raw").select(
            F.col("server_id").alias("of"), "timestamp")
        gaps = catalog.queries()[name](spark, SMALL)
        inside = (F.col("of") == F.col("server_id")) & (F.col("timestamp") > F.col("last_seen")) & (
            F.col("timestamp") < F.col("back_online_at"))
        assert gaps.join(beats, inside).count() == 0, name
