"""Table-driven checks of sparkline trend, card trend and projection."""

from pyspark.sql import functions as F

from fleetscope.operators import series


def run(spark, arrays, current=None):
    rows = [(a, c) for a, c in zip(arrays, current or [None] * len(arrays))]
    df = spark.createDataFrame(rows, "spark array<double>, cur double")
    return df.select(series.trend("spark").alias("t"), series.card_trend("spark").alias("c"),
                     series.projection("cur", "spark", 90.0).alias("p")).collect()


def test_trend_rules(spark):
    arrays = [[], [1.0, 2.0, 3.0], [10.0, 10.0, 10.5, 10.5], [10.0, 10.0, 9.0, 9.0],
              [0.0, 0.0, 0.05, 0.05], [10.0, 10.0, 10.2, 10.2]]
    got = [(r.t, r.c) for r in run(spark, arrays)]
    # n<4 -> stable; +5 % up; -10 % down; first half 0 -> divisor 0.1 (0.5 -> up); +2 % stable / card up
    assert got == [("stable", "stable"), ("stable", "up"), ("up", "up"), ("down", "down"),
                   ("up", "up"), ("stable", "stable")]


def test_projection_rules(spark):
    arrays = [[50.0, 51.0, 52.0, 53.0, 60.0], [50.0, 51.0, 52.0, 53.0, 50.4], [50.0, 51.0, 52.0, 53.0],
              [10.0, 10.0, 10.0, 10.0, 12.5], [50.0, 51.0, 52.0, 53.0, 60.0]]
    cur = [60.0, 60.0, 60.0, 10.0, 95.0]
    got = [r.p for r in run(spark, arrays, cur)]
    # (90-60)/10 = 3h; rate 0.4 < 0.5 none; <5 points none; 80/2.5 = 32h none; already above none
    assert got == ["90% in ~3h", None, None, None, None]


def test_projection_rounds_half_even(spark):
    got = [r.p for r in run(spark, [[0.0, 0.0, 0.0, 0.0, 4.0], [0.0, 0.0, 0.0, 0.0, 4.0]], [80.0, 76.0])]
    assert got == ["90% in ~2h", "90% in ~4h"]          # 2.5 -> 2, 3.5 -> 4


def test_snapshot_server_without_metrics(spark):
    from datetime import datetime, timedelta
    from fleetscope.operators import fleet
    t0 = datetime(2026, 5, 12, 10, 0, 0)
    pts = [("a", m, (t0 + timedelta(minutes=2 * i)).isoformat(sep=" "), v + i)
           for m, v in (("cpu_usage_percent", 20.0), ("memory_usage_percent", 60.0), ("disk_usage_percent", 50.0))
           for i in range(30)]
    m = spark.createDataFrame(pts, "server_id string, metric_name string, t string, value double").select(
        "server_id", "metric_name", F.to_timestamp("t").alias("ts"), "value")
    hb = spark.createDataFrame([("a",), ("b",)], "server_id string").select(
        "server_id", F.array(F.struct(F.lit("sshd").alias("name"), F.lit("9").alias("version"),
                                      F.lit("active").alias("status"))).alias("inventory"))
    sc = spark.createDataFrame([], "server_id string, metric_name string, ts timestamp, score double")
    as_of = t0 + timedelta(minutes=60)
    rows = {r.server_id: r for r in fleet.health_snapshot(m, m, sc, hb, as_of, as_of).collect()}
    assert rows["b"].state == "critical" and rows["b"].headline == "offline — no metric collection."
    assert rows["b"].mem_projection is None and rows["b"].cpu_spark == []
    # memory climbs 1 per 2 minutes: sparkline rate 29 per hour, current 89 -> (90-89)/29 h rounds to 0
    assert rows["a"].mem_trend == "up" and rows["a"].mem_projection == "90% in ~0h"
    assert rows["a"].state == "attention" and rows["a"].headline == "memory rising — projected 90% in ~0h"
