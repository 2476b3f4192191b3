"""Operators checked against brute force on small fixtures."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetscope.operators import chunked
from tests.conftest import SMALL


def test_nearest_matches_loop(spark):
    random.seed(7)
    t0 = datetime(2024, 1, 1)
    vals = sorted(random.sample(range(0, 200_000), 60))
    pts = sorted(random.sample(range(0, 200_000), 80))
    v = spark.createDataFrame([("a", (t0 + timedelta(seconds=s)).isoformat(sep=" "), float(i))
                               for i, s in enumerate(vals)], "k string, t string, value double")
    p = spark.createDataFrame([("a", (t0 + timedelta(seconds=s)).isoformat(sep=" ")) for s in pts + vals[:5]],
                              "k string, t string")
    v = v.select("k", F.to_timestamp("t").alias("ts"), "value")
    p = p.select("k", F.to_timestamp("t").alias("ts"))
    for chunk in (chunked.DAY_US, 7_000_000_000):
        got = {(r.ts): r.nearest_value for r in chunked.nearest(p, v, ["k"], "ts", "value", chunk_us=chunk).collect()}
        for s in pts + vals[:5]:
            best = min(range(len(vals)), key=lambda i: (abs(vals[i] - s), vals[i]))
            assert got[t0 + timedelta(seconds=s)] == float(best)


def sequential_replay(rows: list[tuple]) -> list[tuple]:
    """Sequential replay for tests: rows = (rule, tick_us, value, breached,
    cooldown_us) sorted; returns (rule, state, tick_us, value)."""
    out, state = [], {}
    for rule, tick, value, breached, cd in rows:
        st = state.setdefault(rule, {"state": "INACTIVE", "resolved": None})
        if breached and st["state"] != "FIRING":
            if st["resolved"] is not None and tick - st["resolved"] < cd:
                continue
            out.append((rule, "FIRING", tick, value))
            st["state"] = "FIRING"
        elif not breached and st["state"] == "FIRING":
            out.append((rule, "RESOLVED", tick, value))
            st["state"], st["resolved"] = "RESOLVED", tick
    return out


def test_alert_replay_matches_sequential(spark):
    from fleetscope.operators import alert_replay as R
    from fleetscope.plans.catalog import AS_OF_FAST_TS
    from fleetscope.plans.q_series import scores
    from fleetscope.sources import bindings as B
    ticks = R.breach_ticks(B.alert_rules(spark, SMALL), B.metrics_fast(spark, SMALL), scores(spark, SMALL),
                           AS_OF_FAST_TS).cache()
    rows = sorted((r.server_id + "|" + r.rule_id, r.tick_us, r.value, r.breached, r.cooldown_us)
                  for r in ticks.collect())
    ref = sorted(sequential_replay(rows))
    for rounds in (None, 12):           # rounds from the longest chain, and more than needed
        got = sorted((r.server_id + "|" + r.rule_id, r.state, r.us, r.value) for r in R.replay(
            ticks, max_rounds=rounds).select(
            "server_id", "rule_id", "state", F.unix_micros("triggered_at").alias("us"), "value").collect())
        assert got == ref and len(ref) > 0


def test_alert_replay_needs_a_heartbeat(spark):
    from fleetscope.operators import alert_replay as R
    from fleetscope.plans.catalog import AS_OF_FAST_TS
    from fleetscope.sources import bindings as B
    beats = B.heartbeats(spark, SMALL).where("server_id <> 'srv-1'")
    ticks = R.breach_ticks(B.alert_rules(spark, SMALL), B.metrics_fast(spark, SMALL), None, AS_OF_FAST_TS, heartbeats=beats)
    servers = {r.server_id for r in ticks.select("server_id").distinct().collect()}
    assert servers and "srv-1" not in servers


def test_tick_values_brute_force(spark):
    from fleetscope.operators import alert_replay as R
    from fleetscope.plans.catalog import AS_OF_FAST_TS
    from fleetscope.sources import bindings as B
    m = B.metrics_fast(spark, SMALL).filter(F.col("server_id") == "srv-1")
    samples = [(r.metric_name, r.us, r.value) for r in m.select("metric_name", F.unix_micros("ts").alias("us"),
                                                                "value").collect()]
    tv = {(r.metric_name, r.tick_us): r.value for r in R.tick_values(m, AS_OF_FAST_TS).collect()}
    for (name, tick), val in list(tv.items())[:200]:
        exp = max(v for n, us, v in samples if n == name and tick - 300_000_000 <= us <= tick)
        assert exp == val


def test_iforest_invariants(spark):
    import numpy as np
    from fleetscope.operators.anomaly import iforest
    rng = np.random.default_rng(0)
    rows = []
    t0 = datetime(2026, 5, 11, 10)
    for i in range(600):
        ts = t0 + timedelta(seconds=15 * i)
        anomalous = i >= 580
        k = 10 if anomalous else 1
        rows.append(("s", "m", ts.isoformat(sep=" "), float(rng.normal(50, 3)) * k + (200 if anomalous else 0),
                     float(rng.uniform(0.5, 3)) * k, float(rng.normal(0, 0.1)) * k,
                     float(np.sin(2 * np.pi * ts.hour / 24)), float(np.cos(2 * np.pi * ts.hour / 24)), 0, 0))
    df = spark.createDataFrame(rows, "server_id string, metric_name string, t string, rolling_mean_5m double, "
                                     "rolling_std_5m double, rate_of_change double, hour_sin double, "
                                     "hour_cos double, day_of_week int, is_weekend int")
    df = df.withColumn("ts", F.to_timestamp("t")).drop("t")
    sc = iforest.fit_and_score(df, min_samples=500, n_trees=30).toPandas()
    assert len(sc) == 600 and sc.score.between(0, 1).all()
    sc = sc.sort_values("ts").reset_index(drop=True)
    assert sc.score[580:].mean() > sc.score[:580].mean()
    assert iforest.fit_and_score(df.limit(50), min_samples=500, n_trees=5).count() == 0


def test_hst_invariants(spark):
    from fleetscope.operators.anomaly import hst
    t0 = datetime(2026, 5, 12)
    rows = [("s", "m", (t0 + timedelta(hours=i % 24, seconds=i)).isoformat(sep=" "), 0.5 + i % 5 / 100)
            for i in range(200)]
    rows += [("s", "m", (t0 + timedelta(days=1, seconds=1)).isoformat(sep=" "), 0.52),
             ("s", "m", (t0 + timedelta(days=1, seconds=2)).isoformat(sep=" "), 0.99)]
    df = spark.createDataFrame(rows, "server_id string, metric_name string, t string, value double")
    df = df.select("server_id", "metric_name", F.to_timestamp("t").alias("ts"), "value")
    other = df.withColumn("metric_name", F.lit("m2"))
    out = hst.online_scores(df.unionByName(other), window=50).toPandas()
    assert len(out) == 404 and out.score.between(0, 1).all()
    a = out[out.metric_name == "m"].sort_values("ts").reset_index(drop=True)
    b = out[out.metric_name == "m2"].sort_values("ts").reset_index(drop=True)
    assert (a.score.to_numpy() == b.score.to_numpy()).all()        # independent models per metric
    assert (a.score[:50] == 0).all()                               # no reference window yet
    assert a.score.iloc[-1] >= a.score.iloc[-2]                    # spike >= normal


def test_row_index_is_chunk_independent(spark):
    from fleetscope.sources import bindings as B
    m = B.metrics_fast(spark, SMALL)
    a = chunked.row_index(m, ["server_id", "metric_name"], "ts", ["value"], chunk_us=chunked.DAY_US)
    b = chunked.row_index(m, ["server_id", "metric_name"], "ts", ["value"], chunk_us=600_000_000)
    key = ["server_id", "metric_name", "ts", "value", "idx"]
    assert a.select(*key).exceptAll(b.select(*key)).count() == 0


def test_sinks_roundtrip(spark):
    import tempfile
    from fleetscope.operators.dedup import latest_version
    from fleetscope.sources import bindings as B
    from fleetscope.sources import sinks
    d = tempfile.mkdtemp(prefix="fs-sink-")
    m = B.metrics(spark, SMALL)
    sinks.append_table(m, f"{d}/metrics", sort_keys=["server_id", "metric_name"])
    back = sinks.read_table(spark, f"{d}/metrics", since_month=202401)
    assert back.count() == m.count() and "month" in back.columns
    s = B.anomaly_scores(spark, SMALL).select("server_id", "metric_name", "ts", "score")
    sinks.append_keyed(s, f"{d}/scores", 1)
    sinks.append_keyed(s.withColumn("score", F.lit(0.25)), f"{d}/scores", 2)
    read = latest_version(spark.read.parquet(f"{d}/scores").drop("month"),
                          ["server_id", "metric_name", "ts"], "ingest_seq")
    assert read.filter(F.col("score") != 0.25).count() == 0
    assert read.count() == s.select("server_id", "metric_name", "ts").distinct().count()


def test_model_registry_and_bounds(spark):
    from fleetscope.operators import features
    from fleetscope.operators.anomaly import iforest
    from fleetscope.sources import bindings as B
    f = features.compute_features(B.metrics_fast(spark, "/root/testdata/sf0.01"))
    trees = iforest.train(f, min_samples=200, n_trees=5, version="2024-01-01").cache()
    newer = trees.withColumn("version", F.lit("2024-02-01"))
    latest = iforest.latest_models(trees.unionByName(newer))
    assert {r.version for r in latest.select("version").distinct().collect()} == {"2024-02-01"}
    assert latest.count() == trees.count()
    raw = iforest.raw_scores(f, trees)
    b = {(r.server_id, r.metric_name): r for r in iforest.bounds(raw).collect()}
    n = {(r.server_id, r.metric_name): r["count"] for r in f.groupBy("server_id", "metric_name").count().collect()}
    assert b and all(b[k].n_samples == n[k] and b[k].score_min <= b[k].score_max for k in b)
    s = iforest.normalise(raw, iforest.bounds(raw)).groupBy("server_id", "metric_name").agg(
        F.min("score").alias("lo"), F.max("score").alias("hi")).collect()
    assert all(abs(r.lo) < 1e-12 and abs(r.hi - 1) < 1e-12 for r in s)   # per-model min 0 / max 1


def test_publish_and_read_models(spark):
    import tempfile
    from fleetscope.operators import features
    from fleetscope.operators.anomaly import iforest
    from fleetscope.sources import bindings as B
    d = tempfile.mkdtemp(prefix="fs-models-")
    f = features.compute_features(B.metrics_fast(spark, "/root/testdata/sf0.01"))
    v1 = iforest.train(f, min_samples=200, n_trees=3, version="20240101T000000")
    with pytest.raises(ValueError):
        iforest.publish(v1, f"{d}/models")                       # trees alone cannot score
    v1 = iforest.with_metadata(v1, iforest.bounds(iforest.raw_scores(f, v1)), "2024-01-01 00:00:00", 0.05).cache()
    v1 = v1.toDF(*v1.columns)
    iforest.publish(v1, f"{d}/models")
    iforest.publish(v1.withColumn("version", F.lit("20240201T000000")), f"{d}/models")
    got = iforest.read_published(spark, f"{d}/models")
    assert {r.version for r in got.select("version").distinct().collect()} == {"20240201T000000"}
    assert got.count() == v1.count()
    far = f.withColumn("rolling_mean_5m", F.col("rolling_mean_5m") + 1e6).withColumn("rate_of_change", F.lit(-1e9))
    scored = iforest.score_published(f.unionByName(far), got).collect()
    assert len(scored) == 2 * f.join(v1.select("server_id", "metric_name").distinct(), ["server_id", "metric_name"]).count()
    assert all(0 <= r.score <= 1 for r in scored)


def test_approx_distinct_ips_close(spark):
    from fleetscope.operators import security
    from fleetscope.plans.catalog import AS_OF_TS
    from fleetscope.sources import bindings as B
    lg = B.logs(spark, "/root/testdata/sf0.01")
    exact = {r.server_id: r.unique_ips_24h for r in security.ssh_stats(lg, AS_OF_TS).collect()}
    approx = {r.server_id: r.unique_ips_24h for r in security.ssh_stats(lg, AS_OF_TS, approx_ips=True).collect()}
    assert all(abs(approx[k] - exact[k]) <= max(2, 0.1 * exact[k]) for k in exact)


def test_forest_samples_and_is_repeatable(spark):
    """More rows than a tree draws: every tree holds exactly its sample, and
    neither partitioning nor order changes the forest."""
    from fleetscope.operators.anomaly import iforest
    df = spark.range(3000).selectExpr(
        "'s' AS server_id", "'m' AS metric_name", "timestamp_seconds(1700000000 + id) AS ts",
        *[f"(pmod(xxhash64(id, {i}), 1000)) / 1000.0D AS {c}" for i, c in enumerate(iforest.FEATURES)])
    key = ["tree_id", "feature", "split", "left", "right", "size", "sample_size"]
    a = {r.tree_id: r for r in iforest.train(df, n_trees=25).select(*key).collect()}
    b = {r.tree_id: r for r in iforest.train(df.repartition(7, "ts").sort(F.desc("ts")), n_trees=25).select(*key).collect()}
    assert a == b and len(a) == 25
    assert all(r.size[0] == r.sample_size == iforest.SAMPLE_SIZE for r in a.values())
    assert len({tuple(r.split) for r in a.values()}) == 25


def test_newest_n_across_days_ties_and_nulls(spark):
    from fleetscope.operators.dedup import newest_n
    rows = [("a", f"2024-01-{1 + i // 5:02d} 00:00:{i % 5:02d}", i) for i in range(50)] + [("b", None, 1), ("b", "2024-01-01 00:00:00", 2)]
    rows += [("a", "2024-01-10 00:00:04", 100)]
    df = spark.createDataFrame(rows, "k string, t string, v int").select("k", F.to_timestamp("t").alias("ts"), "v")
    got = newest_n(df, ["k"], "ts", 7, ["v"]).collect()
    assert sorted(r.v for r in got if r.k == "a") == [44, 45, 46, 47, 48, 49, 100]
    assert sorted(r.v for r in got if r.k == "b") == [1, 2]
    assert {r.v for r in newest_n(df, ["k"], "ts", 1, ["v"]).collect()} == {100, 2}


def test_numbers_in_webhook_texts(spark):
    from fleetscope.operators import alerts as A
    values = [10000000.0, 80.0, 0.5, 123456789.25, 1e15, -2e7, 42.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r.s for r in df.select(A.plain_number(F.col("x")).alias("s")).collect()] == [repr(v) for v in values]


def test_no_frame_runs_to_the_end_of_its_partition(spark):
    """Such a frame is evaluated anew for every row; the matches stay the same
    over several chunks, with ties and keys without a partner."""
    from fleetscope.operators import chunked
    import random
    random.seed(5)
    left = [(k, random.randrange(0, 400)) for k in "ab" for _ in range(80)]
    right = [("a", random.randrange(0, 400), i) for i in range(12)]
    t = F.timestamp_micros(F.col("_u") * 1_000_000).alias("ts")
    p = spark.createDataFrame(left, "k string, _u long").select("k", t)
    v = spark.createDataFrame(right, "k string, _u long, i long").select("k", t, F.col("_u").cast("double").alias("value"))
    near = chunked.nearest(p, v, ["k"], "ts", "value", chunk_us=60_000_000)
    spots = sorted(u for _, u, _ in right)
    for r in near.withColumn("_u", F.unix_micros("ts") / 1_000_000).collect():
        want = min(spots, key=lambda s: (abs(s - r._u), s)) if r.k == "a" else None
        assert r.nearest_value == want
    lt = spark.createDataFrame(left, "k string, t long")
    rt = spark.createDataFrame([(k, u, u) for k, u, _ in right], "k string, t long, j long")
    later = chunked.first_at_or_after(lt, rt, ["k"], "t", "j", "j", chunk_us=60)
    for r in later.collect():
        assert r.j == (next((s for s in spots if s >= r.t), None) if r.k == "a" else None)
    for out in (near, later):
        assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_path_lengths_match_a_walk_of_single_rows():
    import numpy as np
    from fleetscope.operators.anomaly import iforest
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 7)).round(1)
    x[::50, 2] = np.nan
    feat, split, left, right, size = iforest.build_tree(np.nan_to_num(x[:256]), rng, 8)
    for row, got in zip(x, iforest.path_lengths(x, feat, split, left, right, size)):
        node = depth = 0
        while feat[node] >= 0:
            node, depth = (left if row[feat[node]] < split[node] else right)[node], depth + 1
        assert got == depth + iforest._c([size[node]])[0]


def test_newest_n_ranks_only_the_seconds_it_needs(spark):
    """One day, many seconds: all rows of the day were ranked before."""
    from fleetscope.operators.dedup import newest_n
    rows = [(k, f"2024-01-02 00:{i // 60:02d}:{i % 60:02d}", j) for k in "ab" for i in range(600) for j in range(2)]
    rows += [("a", None, 7), ("c", None, 1), ("c", None, 2), ("c", "2023-01-01 00:00:00", 3)]
    df = spark.createDataFrame(rows, "k string, t string, j long").select("k", F.to_timestamp("t").alias("ts"), "j")
    want = {"a": [(f"2024-01-02 00:09:{s}", j) for s, j in ((59, 1), (59, 0), (58, 1))],
            "c": [("2023-01-01 00:00:00", 3), ("None", 2)]}
    for few in (False, True):
        out = newest_n(df, ["k"], "ts", F.when(F.col("k") == "a", 3).when(F.col("k") == "c", 2).otherwise(0), ["j"],
                       at_most=3, few_keys=few)
        got = {}
        for r in sorted(out.collect(), key=lambda r: (str(r.ts) != "None", str(r.ts), r.j), reverse=True):
            got.setdefault(r.k, []).append((str(r.ts), r.j))
        assert got == want
        assert "date_trunc(second" in out._jdf.queryExecution().optimizedPlan().toString()
