"""Rollup tables equal the scan of all rows; sketches keep their error bound;
sessions, watermark table, append mode and group limits."""

import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetscope.operators import rollups, security, series
from fleetscope.plans.catalog import AS_OF_FAST_TS, queries
from fleetscope.sources import bindings as B
from fleetscope.sources.manifest import ManifestTable
from fleetscope.streaming import jobs
from tests.conftest import SMALL
from tests.test_plans import plan_of

AT = datetime(2024, 1, 30, 12, 34, 56)


def keep(spark, d, rows, reduce, keys, name):
    """A rollup kept over two runs of its stream, with late rows in the second."""
    table = ManifestTable(spark, f"{d}/{name}_table")
    for i in (1, 0):                                     # newer rows first
        rows.filter((F.unix_micros("ts") / 1_000_000).cast("long") % 2 == i).write.mode("append").parquet(f"{d}/{name}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{d}/{name}")
        jobs.partials_to_table(stream, reduce, table, f"{d}/{name}_ck", keys, None).awaitTermination()
    return table


def as_dict(df, keys, value):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


@pytest.mark.parametrize("at", [AT, datetime(2024, 1, 30), AT + timedelta(days=400)])
def test_means_from_partials_equal_the_scan(spark, at):
    d = tempfile.mkdtemp(prefix="fs-rollup-")
    m = B.metrics(spark, SMALL).select("server_id", "metric_name", "ts", "value")
    table = keep(spark, d, m, rollups.metric_partials, series.SERIES, "m")
    for _ in range(2):
        got = as_dict(rollups.baseline(table.read(), m, at), series.SERIES, "baseline")
        want = as_dict(series.baseline(m, at), series.SERIES, "baseline")
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 * max(1, abs(want[k])) for k in want)
        table.compact(["server_id", "metric_name", "bucket"])


def test_a_batch_is_added_once(spark):
    d = tempfile.mkdtemp(prefix="fs-rollup-")
    m = B.metrics(spark, SMALL).select("server_id", "metric_name", "ts", "value")
    table = keep(spark, d, m, rollups.metric_partials, series.SERIES, "m")
    n = table.read().agg(F.sum("n")).first()[0]
    stream = spark.readStream.schema(m.schema).parquet(f"{d}/m")
    assert n == m.filter("value IS NOT NULL").count()
    # batch 0 again, as after a crash between the commit of the table and that of the stream
    from fleetscope.sources.manifest import append_rows
    append_rows(table, rollups.metric_partials(m), "bucket", series.SERIES, f"{d}/m_ck", 0)
    assert stream.isStreaming and table.read().agg(F.sum("n")).first()[0] == n


def test_rows_without_value_or_instant_and_empty_tables(spark):
    rows = spark.createDataFrame([("a", "m", datetime(2024, 1, 1, 0, 5), 1.0), ("a", "m", datetime(2024, 1, 1, 0, 6), None),
                                  ("a", "m", None, 3.0), ("b", "m", datetime(2024, 1, 1, 0, 7), None)],
                                 "server_id string, metric_name string, ts timestamp, value double")
    p = rollups.metric_partials(rows)
    assert [(r.server_id, r.n, r.total) for r in p.collect()] == [("a", 1, 1.0)]
    assert rollups.baseline(p, rows, datetime(2024, 1, 2)).count() == 1
    assert rollups.metric_partials(rows.limit(0)).count() == 0


def test_sparkline_buckets_from_minute_partials(spark):
    m = B.metrics_fast(spark, SMALL).select("server_id", "metric_name", "ts", "value")
    at = AS_OF_FAST_TS + timedelta(seconds=17)
    key = [*series.SERIES, "bucket"]
    got = as_dict(rollups.sparkline_buckets(rollups.metric_partials(m, 1), m, at), key, "avg_value")
    want = as_dict(series.sparkline_buckets(m, at), key, "avg_value")
    assert got.keys() == want.keys() and len(want) > 0 and all(abs(got[k] - want[k]) < 1e-9 * max(1, abs(want[k])) for k in want)
    with pytest.raises(ValueError):
        rollups.sparkline_buckets(m, m, at, stored_minutes=4)


def test_login_rollup_equals_the_scan(spark):
    d = tempfile.mkdtemp(prefix="fs-rollup-")
    lg = B.logs(spark, SMALL).select("server_id", "log_file", "ts", "line")
    servers = lg.select("server_id").union(spark.createDataFrame([("quiet",)], "server_id string"))
    table = keep(spark, d, lg, rollups.login_partials, ["server_id"], "l")
    got = as_dict(rollups.ssh_baseline(table.read(), lg, servers, AT), ["server_id"], "avg_daily")
    want = as_dict(security.ssh_baseline(lg, AT, servers=servers), ["server_id"], "avg_daily")
    assert got == pytest.approx(want) and want[("quiet",)] == 0.0
    stats = {r.server_id: r for r in security.ssh_stats(lg, AT, servers=servers).collect()}
    for r in rollups.unique_ips(table.read(), lg, servers, AT).collect():
        assert (r.attempts, r.unique_ips) == (stats[r.server_id].attempts_24h, stats[r.server_id].unique_ips_24h)


def test_united_sketches_keep_their_error_bound(spark):
    """60 000 addresses, each seen in several hours: the union of 24 hourly
    sketches is off by less than four deviations, and hours do not add up."""
    n = 60_000
    lines = (spark.range(3 * n).select(
        F.lit("s").alias("server_id"), F.lit("auth.log").alias("log_file"),
        (F.lit("2024-01-01 00:30:00").cast("timestamp") + F.make_interval(hours=(F.col("id") % 23).cast("int"))).alias("ts"),
        F.concat(F.lit("Failed password for root from ip"), (F.col("id") % n).cast("string"), F.lit(" port 1 ssh2")).alias("line")))
    p = rollups.login_partials(lines)
    got = rollups.unique_ips(p, lines, lines.select("server_id"), datetime(2024, 1, 2)).first()
    assert got.attempts == 3 * n
    assert abs(got.unique_ips - n) < 4 * 0.8 / 2 ** (rollups.LG_K / 2) * n
    bare = lines.limit(1).withColumn("line", F.lit("Failed password without address"))
    assert rollups.unique_ips(rollups.login_partials(bare), bare, bare, datetime(2024, 1, 2)).first().unique_ips == 1


def beats(spark, seconds):
    start = datetime(2024, 1, 1)
    return spark.createDataFrame([(s, start + timedelta(microseconds=round(x * 1e6))) for s, x in seconds],
                                 "server_id string, timestamp timestamp")


def test_sessions_are_the_complement_of_the_gaps(spark):
    hb = beats(spark, [("a", 0), ("a", 90), ("a", 180.000001), ("a", 180.000001), ("a", 1000), ("b", 5),
                       ("c", 3590), ("c", 3600), ("c", 3690), ("c", 7200)])
    spells = sorted((r.server_id, r.online_from.second, r.heartbeats) for r in jobs.uptime_sessions(hb).collect())
    assert spells == [("a", 0, 2), ("a", 0, 2), ("a", 40, 1), ("b", 5, 1), ("c", 0, 1), ("c", 50, 3)]
    raw = B.heartbeat_messages(spark, SMALL, clock="raw")
    for x in (hb, raw):
        s, g = jobs.uptime_sessions(x).collect(), jobs.heartbeat_gaps(x).collect()
        first = {r.server_id: r.t for r in x.groupBy("server_id").agg(F.min("timestamp").alias("t")).collect()}
        starts = [(r.server_id, r.online_from) for r in s if r.online_from != first[r.server_id]]
        assert sorted(starts) == sorted((r.server_id, r.back_online_at) for r in g)
        ends = {(r.server_id, r.last_seen) for r in s}
        assert all((r.server_id, r.last_seen) in ends for r in g) and len(s) == len(g) + len(first)
        assert sum(r.heartbeats for r in s) == x.count()


def test_sessions_of_a_stream_in_append_mode(spark):
    d = tempfile.mkdtemp(prefix="fs-sessions-")
    parts = [[("a", 0), ("b", 10), ("a", 60)], [("a", 140), ("b", 400)], [("z", 5000)], [("z", 9000)]]
    whole = beats(spark, [x for p in parts for x in p])
    for i, p in enumerate(parts):
        beats(spark, p).coalesce(1).write.parquet(f"{d}/in/part={i}")
        s = spark.readStream.schema(whole.schema).parquet(f"{d}/in/*").withWatermark("timestamp", "10 seconds")
        (jobs.uptime_sessions(s).writeStream.outputMode("append").format("parquet").option("path", f"{d}/out")
         .option("checkpointLocation", f"{d}/ck").trigger(availableNow=True).start().awaitTermination())
    got = spark.read.parquet(f"{d}/out").filter("server_id <> 'z'")
    want = jobs.uptime_sessions(whole).filter("server_id <> 'z'")
    assert got.count() == want.count() == 3 and got.exceptAll(want.select(*got.columns)).count() == 0


def test_sessions_are_dealt_by_server_and_chunk(spark):
    plan = plan_of(queries()["R7_uptime_sessions"](spark, SMALL))
    first = plan.split("Exchange")[-1]
    assert "_chunk" in first.split("\n")[0] and "MergingSessions" in plan


def test_bucket_stream_in_append_mode_emits_each_bucket_once(spark):
    d = tempfile.mkdtemp(prefix="fs-append-")
    m = B.metrics_fast(spark, SMALL).select("server_id", "metric_name", "ts", "value")
    last = m.agg(F.max("ts")).first()[0] + timedelta(hours=2)
    end = spark.createDataFrame([("-", "-", last, 0.0)], m.schema)
    for i, part in enumerate([m.filter(F.col("ts") < AS_OF_FAST_TS - timedelta(hours=1)),
                              m.filter(F.col("ts") >= AS_OF_FAST_TS - timedelta(hours=1)), end]):
        part.coalesce(1).write.mode("append").parquet(f"{d}/in")
        s = spark.readStream.schema(m.schema).parquet(f"{d}/in")
        (jobs.bucket_counts(s, 2).writeStream.outputMode("append").format("parquet").option("path", f"{d}/out")
         .option("checkpointLocation", f"{d}/ck").trigger(availableNow=True).start().awaitTermination())
    got = spark.read.parquet(f"{d}/out")
    key = ["server_id", "metric_name", "bucket", "n"]
    want = jobs.bucket_counts(m, 2)
    assert got.select(*key).exceptAll(want.select(*key)).count() == 0
    assert got.count() == want.count() == got.select(*key[:3]).distinct().count()


def test_feature_job_reads_its_watermarks_and_not_the_features(spark):
    """Between the runs the stored features are made unreadable; a batch that
    has its watermarks in the table changes nothing."""
    import os
    d = tempfile.mkdtemp(prefix="fs-marks-")
    m = B.metrics_fast(spark, SMALL).select("server_id", "metric_name", "ts", "value")
    cut = F.lit((AS_OF_FAST_TS - timedelta(minutes=40)).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")

    def run(part):
        part.write.mode("append").parquet(f"{d}/metrics")
        jobs.features_to_table(spark.readStream.schema(m.schema).parquet(f"{d}/metrics"), f"{d}/metrics", f"{d}/features",
                               f"{d}/ck").awaitTermination()
    run(m.filter(F.col("ts") < cut))
    stored = [os.path.join(p, f) for p, _, fs in os.walk(f"{d}/features") for f in fs if f.endswith(".parquet")]
    assert stored and all("/month=" in f and f.index("/month=") < f.index("/batch=") for f in stored)
    for f in stored:
        with open(f, "wb") as out:
            out.write(b"unreadable")
    run(m.filter(F.col("ts") >= cut))
    new = spark.read.parquet(*[p for p, _, fs in os.walk(f"{d}/features") if p.endswith("batch=1") and fs])
    assert new.count() == m.filter(F.col("ts") >= cut).count()
    marks = ManifestTable(spark, jobs.watermarks_of(f"{d}/features"), "bucket").read()
    want = series.feature_watermark(m)
    assert marks.select(*want.columns).exceptAll(want).count() == 0 and marks.count() == want.count()


def test_stream_bounds_have_a_map_side_limit(spark):
    plan = plan_of(queries()["S17_newest_per_stream"](spark, SMALL))
    assert "WindowGroupLimit" in plan and "Partial" in plan.split("WindowGroupLimit", 1)[1]
