"""The online score writer equals the replay, across restarts and stored models."""

import pytest
from pyspark.sql import functions as F

from fleetscope.operators import chunked
from fleetscope.operators.anomaly import hst
from fleetscope.sources import bindings as B
from fleetscope.streaming import score_writer as W
from tests.conftest import SMALL

SMALL_TREES = {"n_trees": 4, "height": 5, "window": 10}


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def samples(spark):
    m = B.metrics_fast(spark, SMALL).select("server_id", "metric_name", "ts", "value")
    return m.filter(F.col("server_id").isin("srv-0", "srv-1"))


def thirds(m):
    cuts = [r[0] for r in m.select(F.explode(F.expr("percentile_approx(ts, array(0.4, 0.7))"))).collect()]
    return [m.filter(F.col("ts") < F.lit(cuts[0])), m.filter((F.col("ts") >= F.lit(cuts[0])) & (F.col("ts") < F.lit(cuts[1]))),
            m.filter(F.col("ts") >= F.lit(cuts[1]))]


def feed(spark, d, df, checkpoint="ck", **kw):
    df.coalesce(1).write.mode("append").parquet(f"{d}/metrics")
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/metrics")
    W.scores_to_table(s, f"{d}/scores", f"{d}/{checkpoint}", every_s=None, **SMALL_TREES, **kw).awaitTermination()


def rounded(df):
    return sorted((r.server_id, r.metric_name, r.us, round(r.score, 9)) for r in df.withColumn("us", F.unix_micros("ts")).collect())


@pytest.mark.parametrize("scale", hst.SCALES)
def test_stream_equals_replay_across_restarts(spark, samples, tmp_path, scale):
    d = str(tmp_path)
    for part in thirds(samples):
        feed(spark, d, part, scale=scale)
    got = spark.read.parquet(f"{d}/scores")
    expected = hst.online_scores(samples, **SMALL_TREES, scale=scale)
    assert rounded(got) == rounded(expected)
    assert {r.model_version for r in got.select("model_version").distinct().collect()} == {"river"}
    assert sum(s[3] > 0 for s in rounded(got)) > 50


def test_a_stored_model_seeds_a_new_query(spark, samples, tmp_path):
    d, parts = str(tmp_path), thirds(samples)
    feed(spark, d, parts[0], scale="running_minmax")
    feed(spark, d, parts[1], scale="running_minmax")
    W.stored_models(spark, f"{d}/ck", "running_minmax").write.parquet(f"{d}/models")
    before = spark.read.parquet(f"{d}/scores").count()
    # a new checkpoint reads all samples again: those up to the watermark are not scored twice
    feed(spark, d, parts[2], "other", scale="running_minmax", models=spark.read.parquet(f"{d}/models"))
    got = spark.read.parquet(f"{d}/scores")
    latest = got.groupBy(*hst.KEY, "ts").agg(F.max_by("score", "ingest_seq").alias("score"))
    assert got.count() >= before
    expected = hst.online_scores(samples, **SMALL_TREES, scale="running_minmax")
    third = F.unix_micros("ts") >= parts[2].agg(F.min(F.unix_micros("ts"))).first()[0]
    assert rounded(latest.filter(third)) == rounded(expected.filter(third).dropDuplicates([*hst.KEY, "ts"]))


def test_late_samples_and_the_first_look_back(spark, tmp_path):
    d = str(tmp_path)
    rows = lambda ts: spark.createDataFrame([("a", "cpu", t, float(t % 7)) for t in ts] + [("a", "cpu", 500, None), (None, "cpu", 500, 1.0)],
                                            "server_id string, metric_name string, t long, value double").select(
        "server_id", "metric_name", F.timestamp_seconds("t").alias("ts"), "value")
    feed(spark, d, rows([100, 399, 400, 430, 460]), start_at="1970-01-01 00:06:40")       # 400 s
    feed(spark, d, rows([410, 460, 490]))                                                # 410 is late, 460 is new again
    got = sorted(r.t for r in spark.read.parquet(f"{d}/scores").select(F.unix_seconds("ts").alias("t")).collect())
    assert got == [400, 430, 460, 460, 490]


def test_running_extremes_across_chunks(spark):
    import random
    pick = random.Random(4)
    rows = [(k, t, pick.choice([None, pick.uniform(-5, 5)])) for k in "ab" for t in range(0, 900, 7)]
    df = spark.createDataFrame(rows, "k string, t long, v double").select("k", F.timestamp_seconds("t").alias("ts"), "t", "v")
    got = {(r.k, r.t): (r.low, r.high) for r in chunked.running_extremes(df, ["k"], "ts", "v", chunk_us=60_000_000).collect()}
    for k in "ab":
        seen = []
        for _, t, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            seen += [] if v is None else [v]
            assert got[k, t] == ((min(seen), max(seen)) if seen else (None, None))
