"""The stateful evaluator equals the batch replay, in any split and across restarts."""

import os

import pytest
from pyspark.sql import functions as F

from fleetscope.operators import alert_replay as R
from fleetscope.plans.catalog import AS_OF_FAST_TS
from fleetscope.plans.q_series import scores
from fleetscope.sources import bindings as B
from fleetscope.streaming import alert_processor as P
from tests.conftest import SMALL

COLS = ["event_id", "server_id", "rule_id", "metric_name", "threshold", "severity", "state", "value"]


def rows(df):
    return sorted((*(r[c] for c in COLS), r.us) for r in df.withColumn("us", F.unix_micros("triggered_at")).collect())


def streams(spark, d):
    """The four inputs as file streams, one file a batch."""
    out = {}
    for name in ("metrics", "scores", "rules", "beats"):
        schema = spark.read.parquet(f"{d}/{name}").schema
        out[name] = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/{name}")
    return P.signals(out["metrics"], out["scores"], out["rules"], out["beats"])


def put(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def run(spark, d):
    q = P.alerts_to_table(streams(spark, d), f"{d}/events", f"{d}/ck", every_s=None)
    q.awaitTermination()


@pytest.fixture(scope="module")
def fleet(spark):
    rules = B.alert_rules(spark, SMALL)
    metrics = B.metrics_fast(spark, SMALL).select("server_id", "metric_name", "ts", "value")
    sc = scores(spark, SMALL).select("server_id", "metric_name", "ts", "score")
    beats = B.heartbeats(spark, SMALL).select("server_id", "timestamp", "agent_version").filter("server_id <> 'srv-3'")
    ticks = R.breach_ticks(rules, metrics, sc, AS_OF_FAST_TS, heartbeats=beats)
    return rules, metrics, sc, beats, rows(R.replay(ticks))


def test_events_equal_the_replay_across_two_restarts(spark, fleet, tmp_path):
    rules, metrics, sc, beats, expected = fleet
    d = str(tmp_path)
    put(rules, f"{d}/rules")
    put(beats, f"{d}/beats")
    last = metrics.agg(F.max("ts")).first()[0]
    cuts = [r[0] for r in metrics.select(F.explode(F.expr("percentile_approx(ts, array(0.3, 0.31, 0.7))"))).collect()]
    lows, highs = [None, *cuts], [*cuts, None]
    for i, (a, b) in enumerate(zip(lows, highs)):
        part = F.lit(True)
        if a is not None:
            part &= F.col("ts") >= F.lit(a)
        if b is not None:
            part &= F.col("ts") < F.lit(b)
        put(metrics.filter(part), f"{d}/metrics")
        put(sc.filter(part), f"{d}/scores")
        if i != 1:              # the second slice waits for the third: batches of several files
            run(spark, d)       # each run is a new query on the same checkpoint
    end = F.lit(last) + F.expr("INTERVAL 1 HOUR")
    put(metrics.limit(1).select(F.lit("other").alias("server_id"), "metric_name", end.alias("ts"), "value"), f"{d}/metrics")
    put(sc.limit(1).select(F.lit("other").alias("server_id"), "metric_name", end.alias("ts"), "score"), f"{d}/scores")
    run(spark, d)
    limit = F.lit(AS_OF_FAST_TS.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")
    got = rows(spark.read.parquet(f"{d}/events").filter(F.col("triggered_at") <= limit))
    assert got == expected and len(expected) > 20
    # S5 from the state of the stopped query
    stored = {r.server_id: r.agent_version for r in P.stored_heartbeats(spark, f"{d}/ck").collect()}
    assert stored == {r.server_id: r.agent_version for r in beats.collect()}


def sample(spark, rows_):
    return spark.createDataFrame([(s, m, t, v) for s, m, t, v in rows_], "server_id string, metric_name string, t long, value double").select(
        "server_id", "metric_name", F.timestamp_seconds("t").alias("ts"), "value")


def rule(spark, **kw):
    r = {"server_id": "a", "rule_id": "r", "metric_name": "cpu", "operator": ">", "threshold": 10.0, "severity": "warning",
         "alert_mode": "static", "ml_score_threshold": 0.7, "cooldown_minutes": 5, "version": 1, "enabled": True, **kw}
    return spark.createDataFrame([tuple(r.values())], "server_id string, rule_id string, metric_name string, operator string, "
                                 "threshold double, severity string, alert_mode string, ml_score_threshold double, "
                                 "cooldown_minutes int, version long, enabled boolean")


def test_rules_change_while_the_stream_runs(spark, tmp_path):
    """A breach fires at its first tick, resolves when the window is clean, does
    not fire again in the cooldown; a disabled version stops the rule."""
    d = str(tmp_path)
    base = 1_700_000_010 // 30 * 30
    put(rule(spark), f"{d}/rules")
    put(sample(spark, []).withColumnRenamed("value", "score"), f"{d}/scores")
    put(spark.createDataFrame([("a", "2024-01-01", "1.0")], "server_id string, timestamp string, agent_version string").withColumn(
        "timestamp", F.to_timestamp("timestamp")), f"{d}/beats")
    put(sample(spark, [("a", "cpu", base - 5, 50.0), ("a", "cpu", base - 1, 60.0)] + [("a", "cpu", base + 30 * i, 1.0) for i in range(1, 16)]
               + [("b", "cpu", base, 99.0), ("a", "cpu", base + 3, float("nan")), ("a", "cpu", base + 3, None)]), f"{d}/metrics")
    run(spark, d)
    put(rule(spark, version=2, enabled=False), f"{d}/rules")
    put(sample(spark, [("a", "cpu", base + 900, 70.0), ("a", "cpu", base + 1500, 1.0)]), f"{d}/metrics")
    run(spark, d)
    put(rule(spark, version=3), f"{d}/rules")
    put(rule(spark, version=1, threshold=1000.0), f"{d}/rules")         # an old version that comes late changes nothing
    put(sample(spark, [("a", "cpu", base + 2400, 70.0), ("x", "cpu", base + 9000, 1.0)]), f"{d}/metrics")
    run(spark, d)
    got = [(int(r.s) - base, r.state, r.value) for r in spark.read.parquet(f"{d}/events").withColumn(
        "s", F.unix_seconds("triggered_at")).orderBy("triggered_at").collect()]
    # 60 is in the windows of the ticks 0 .. 270; the next clean tick is 300
    assert got == [(0, "FIRING", 60.0), (300, "RESOLVED", 1.0), (2400, "FIRING", 70.0)]


def test_partials_do_not_grow_with_the_sampling_rate(spark):
    many = sample(spark, [("a", "cpu", 1_700_000_000 + i % 60, float(i)) for i in range(5000)]).coalesce(1)
    parts = P._partials(many, "sample", "value").collect()
    assert len(parts) <= 4 and max(p.value for p in parts) == 4999.0
    edge = [p for p in parts if p.edge_value is not None]
    assert all(p.edge_at_us == p.bucket_ms * 1000 for p in edge) and edge


@pytest.mark.parametrize("op,answers", [(">", (False, False, True)), ("<", (True, False, False)), (">=", (False, True, True)),
                                        ("<=", (True, True, False)), ("==", (False, True, False)), ("!", (None, None, None))])
def test_comparators(op, answers):
    assert tuple(P.compare(op, v, 2.0) for v in (1.0, 2.0, 3.0)) == answers
