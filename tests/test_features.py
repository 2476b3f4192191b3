"""Feature-table assertions ported from the reference's unit tests, plus
chunk-size invariance of the chunked windows."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetscope.operators import features

T0 = datetime(2026, 5, 12, 10, 0, 0)  # a Tuesday


def frame(spark, values, step_s=15, start=T0, key=("s1", "cpu_usage_percent")):
    rows = [(key[0], key[1], (start + timedelta(seconds=i * step_s)).strftime("%Y-%m-%d %H:%M:%S"), float(v))
            for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "server_id string, metric_name string, t string, value double")
    return df.select("server_id", "metric_name", F.to_timestamp("t").alias("ts"), "value")


def run(df, **kw):
    return features.compute_features(df, **kw).orderBy("ts").collect()


def test_empty(spark):
    df = frame(spark, []).limit(0)
    assert features.compute_features(df).count() == 0


def test_columns(spark):
    assert features.compute_features(frame(spark, [1.0, 2.0])).columns == features.FEATURE_COLUMNS


def test_constant_series(spark):
    rows = run(frame(spark, [42.0] * 30))
    assert all(abs(r.rolling_mean_5m - 42.0) < 1e-9 and r.rolling_std_5m == 0.0 for r in rows)


def test_first_rate_zero_and_linear_rate(spark):
    rows = run(frame(spark, [0, 10, 20, 30, 40], step_s=10))
    assert rows[0].rate_of_change == 0.0
    assert all(abs(r.rate_of_change - 1.0) < 1e-9 for r in rows[1:])


def test_unit_circle(spark):
    for r in run(frame(spark, range(10), step_s=1000)):
        assert abs(r.hour_sin ** 2 + r.hour_cos ** 2 - 1.0) < 1e-9


def test_weekdays(spark):
    df = spark.createDataFrame([("s", "m", t, 1.0) for t in ("2026-05-11 12:00:00", "2026-05-16 12:00:00",
                                                             "2026-05-17 12:00:00")],
                               "server_id string, metric_name string, t string, value double")
    df = df.select("server_id", "metric_name", F.to_timestamp("t").alias("ts"), "value")
    rows = run(df)
    assert [(r.day_of_week, r.is_weekend) for r in rows] == [(0, 0), (5, 1), (6, 1)]


def test_mean_within_range_and_raw(spark):
    rows = run(frame(spark, range(40)))
    for i, r in enumerate(rows):
        assert 0 <= r.rolling_mean_5m <= 39 and r.raw_value == float(i)


def test_rolling_frame_is_half_open(spark):
    # points at 0 s and exactly 300 s: the second frame excludes the first
    rows = run(frame(spark, [10.0, 20.0], step_s=300))
    assert rows[1].rolling_mean_5m == 20.0


def test_chunking_is_exact(spark):
    import random
    random.seed(1)
    vals = [random.random() * 100 for _ in range(400)]
    df = frame(spark, vals, step_s=37)
    a = run(df)
    b = run(df, chunk_us=400_000_000)   # chunks of 400 s, frames cross edges
    for x, y in zip(a, b):
        assert x.ts == y.ts
        assert math.isclose(x.rolling_mean_5m, y.rolling_mean_5m, rel_tol=1e-9)
        assert math.isclose(x.rolling_std_5m, y.rolling_std_5m, rel_tol=1e-7, abs_tol=1e-9)
        assert math.isclose(x.rate_of_change, y.rate_of_change, rel_tol=1e-9, abs_tol=1e-12)


def test_incremental_emits_strictly_newer(spark):
    df = frame(spark, [1.0, 2.0, 3.0])
    stored = features.compute_features(df.filter(F.col("value") == 1.0))
    out = features.incremental_features(df, stored, T0 + timedelta(hours=1)).orderBy("ts").collect()
    assert [r.raw_value for r in out] == [2.0, 3.0]
    assert abs(out[0].rate_of_change - 1 / 15) < 1e-12


def test_chunk_length_does_not_change_features(spark):
    from fleetscope.operators import chunked
    from fleetscope.sources import bindings as B
    from tests.conftest import SMALL
    m = B.metrics_fast(spark, SMALL)
    assert chunked.chunk_size() == 3_600_000_000 and chunked.chunk_size(floor_us=chunked.DAY_US) == chunked.DAY_US
    base = features.compute_features(m, chunk_us=chunked.DAY_US)
    spark.conf.set(chunked.CHUNK_CONF, "400")
    try:
        assert chunked.chunk_size() == 400_000_000
        small = features.compute_features(m)
    finally:
        spark.conf.unset(chunked.CHUNK_CONF)
    cols = ["server_id", "metric_name", "ts", "raw_value", "rate_of_change"]
    assert base.select(*cols).exceptAll(small.select(*cols)).count() == 0
    a = {(r.server_id, r.metric_name, r.ts): r.rolling_std_5m for r in base.collect()}
    for r in small.collect():
        assert abs(a[(r.server_id, r.metric_name, r.ts)] - r.rolling_std_5m) < 1e-9


def test_two_incremental_runs_equal_one(spark):
    from fleetscope.sources import bindings as B
    from fleetscope.plans.catalog import AS_OF_FAST_TS
    from tests.conftest import SMALL
    m = B.metrics_fast(spark, SMALL)
    cut1, cut2 = (AS_OF_FAST_TS - timedelta(minutes=k) for k in (60, 30))
    upto = lambda t: m.filter(F.col("ts") < F.lit(t.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp"))
    stored = features.compute_features(upto(cut1))
    second = stored.unionByName(features.incremental_features(upto(cut2), stored, cut2)).cache()
    third = second.unionByName(features.incremental_features(m, second, AS_OF_FAST_TS))
    want = features.compute_features(m)
    key = ["server_id", "metric_name", "ts", "raw_value", "rate_of_change"]
    assert third.count() == want.count() > second.count() > stored.count()
    assert third.select(*key).exceptAll(want.select(*key)).count() == 0


def test_rolling_frames_are_running_aggregates(spark):
    """Against plain sums over dense rows with ties, nulls and a flat stretch;
    no frame of the plan is summed up anew for each row."""
    import random
    import statistics
    random.seed(3)
    at = sorted(random.choice(range(0, 1500)) for _ in range(600)) + [1800, 2100, 2400, 2401]
    vals = [None if i % 17 == 0 else 0.1 if i > 400 else 1e6 + random.random() for i in range(len(at))]
    rows = [("s1", "m", (T0 + timedelta(seconds=t)).strftime("%Y-%m-%d %H:%M:%S"), v) for t, v in zip(at, vals)]
    df = spark.createDataFrame(rows, "server_id string, metric_name string, t string, value double")
    df = df.select("server_id", "metric_name", F.to_timestamp("t").alias("ts"), "value")
    for chunk in (None, 400_000_000):
        out = features.compute_features(df, chunk_us=chunk)
        assert out.count() == len(at)
        for r in out.collect():
            t = int((r.ts - T0).total_seconds())
            own = [v for s, v in zip(at, vals) if t - 300 < s <= t and v is not None]
            assert (r.rolling_mean_5m is None) == (not own)
            if own:
                assert math.isclose(r.rolling_mean_5m, statistics.fmean(own), rel_tol=1e-12)
            if len(set(own)) < 2:
                assert r.rolling_std_5m == 0.0
            else:
                assert math.isclose(r.rolling_std_5m, statistics.stdev(own), rel_tol=1e-6)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "RangeFrame, -" not in plan and "unboundedfollowing" not in plan.lower()


def test_model_queries_compute_the_features_once(spark):
    """Gate, sample and scores read stored features; before, each of them had
    the rolling windows in its own plan."""
    from fleetscope.plans import q_ml
    from tests.conftest import SMALL
    out = q_ml.a22_fixed(spark, SMALL)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 25
