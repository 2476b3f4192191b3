"""Registered model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.operators import features
from fleetscope.operators.anomaly import hst, iforest
from fleetscope.operators.anomaly.model_store import ModelStore
from fleetscope.plans.catalog import register
from fleetscope.plans.q_series import _FEATURES_SQL
from fleetscope.session import cut_lineage, scratch
from fleetscope.sources import bindings as B

# the driver tables hold ~400 rows per series at sf0.01, where results are
# compared with SQL: below the default gate of 500, which would leave nothing
MIN_SAMPLES = 200
N_TREES = iforest.N_TREES


def feats(spark, d):
    return features.compute_features(B.metrics_fast(spark, d))


@register("A23_training_gate", f"""
SELECT server_id, metric_name, count(*) AS n FROM metrics_fast GROUP BY ALL HAVING count(*) >= {MIN_SAMPLES}""")
def a23(spark, d):
    return iforest.eligible(feats(spark, d), MIN_SAMPLES)


def _trained(f, seed, trained_at):
    path = scratch(f.sparkSession, "trees")
    iforest.train(f, MIN_SAMPLES, N_TREES, seed=seed).write.parquet(path)      # read by the scores and by the model
    trees = f.sparkSession.read.parquet(path)
    seen = f.join(iforest.eligible(f, MIN_SAMPLES).select(*iforest.KEY), iforest.KEY, "left_semi")
    return iforest.with_metadata(trees, iforest.bounds(iforest.raw_scores(seen, trees)), trained_at)


@register("M2_M4_model_registry", f"""
SELECT server_id, metric_name, 'v2' AS version, CAST({N_TREES} AS BIGINT) AS n_trees, count(*) AS n_samples,
       max(ts) AS data_range_end
FROM metrics_fast GROUP BY ALL HAVING count(*) >= {MIN_SAMPLES}""")
def m2(spark, d):
    """Version 1 is trained on the older rows, version 2 on all of them; version
    3 is broken (its bounds are turned round) and must not be served."""
    store = ModelStore(spark, scratch(spark, "models"))
    feats(spark, d).write.parquet(f"{store.path}/features")
    f = spark.read.parquet(f"{store.path}/features")
    cut = f.agg(F.expr("percentile_approx(unix_micros(ts), 0.8)")).first()[0]
    store.publish(_trained(f.filter(F.unix_micros("ts") < cut), 1, "2024-01-30 00:00:00"), "v1", N_TREES)
    store.publish(_trained(f, 2, "2024-01-31 00:00:00"), "v2", N_TREES)
    served = store.models()
    store.publish(served.withColumn("score_min", F.col("score_max") + 1), "v3", N_TREES)
    return store.models().groupBy("server_id", "metric_name", "version").agg(
        F.count(F.lit(1)).alias("n_trees"), F.max("n_samples").alias("n_samples"), F.max("data_range_end").alias("data_range_end"))


@register("M3_F22_iforest_scores", None)
def m3(spark, d):
    return iforest.fit_and_score(feats(spark, d), MIN_SAMPLES, N_TREES)


@register("A22_model_bounds", None)
def a22(spark, d):
    f = cut_lineage(feats(spark, d))        # read by the gate, the sample and the scores
    trees = iforest.train(f, MIN_SAMPLES, N_TREES)
    return iforest.bounds(iforest.raw_scores(f, trees))


# A small fixed forest (feature name, split, left, right; a number is a leaf's
# size), so that scoring and normalisation can be followed in SQL.
FIXED_FOREST = [
    ("rolling_mean_5m", 40.0, ("rolling_std_5m", 10.0, 30, 12), ("rate_of_change", 0.0, 90, ("hour_sin", 0.1, 64, 1))),
    ("rolling_std_5m", 25.0, ("day_of_week", 2.5, 100, ("rolling_mean_5m", 60.0, 77, 2)), 9),
    ("hour_cos", -0.2, ("is_weekend", 0.5, 3, 50), ("rolling_mean_5m", 20.0, 8, 128)),
]
FIXED_SAMPLE = 256


def _flat_tree(tree):
    """(feature, split, left, right, size) arrays of a nested tree."""
    cells = []

    def add(node):
        at = len(cells)
        cells.append([-1, 0.0, -1, -1, 0])
        if isinstance(node, int):
            cells[at][4] = node
        else:
            cells[at][:2] = [iforest.FEATURES.index(node[0]), node[1]]
            cells[at][2], cells[at][3] = add(node[2]), add(node[3])
        return at
    add(tree)
    return [list(c) for c in zip(*cells)]


def _path_sql(node, depth=0):
    if isinstance(node, int):
        return repr(depth + float(iforest._c([node])[0]))
    return f"CASE WHEN {node[0]} < {node[1]} THEN {_path_sql(node[2], depth + 1)} ELSE {_path_sql(node[3], depth + 1)} END"


_FIXED_SQL = f"""
, ff AS ({_FEATURES_SQL}),
raw AS (SELECT server_id, metric_name, ts,
  pow(CAST(2 AS DOUBLE), -(({') + ('.join(_path_sql(t) for t in FIXED_FOREST)})) / {len(FIXED_FOREST)}
      / {float(iforest._c([FIXED_SAMPLE])[0])!r}) AS raw FROM ff),
b AS (SELECT server_id, metric_name, min(raw) AS score_min, max(raw) AS score_max, count(*) AS n_samples,
             min(ts) AS data_range_start, max(ts) AS data_range_end FROM raw GROUP BY ALL)"""


def _fixed_trees(spark, f):
    forest = spark.createDataFrame([(i, *_flat_tree(t), FIXED_SAMPLE, "fixed") for i, t in enumerate(FIXED_FOREST)],
                                   iforest.TREE_SCHEMA.split("metric_name string, ")[1] + ", version string")
    trees = (f.select(*iforest.KEY).distinct()
             .withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(len(FIXED_FOREST) - 1)))).join(forest, "tree_id"))
    # fresh column identities: both sides of the scoring cogroup come from the features
    return trees.select(*iforest.KEY, *forest.columns).toDF(*iforest.KEY, *forest.columns)


def _fixed_raw(spark, d):
    f = cut_lineage(feats(spark, d))
    return iforest.raw_scores(f, _fixed_trees(spark, f))


@register("M3_F22_fixed_forest_scores", _FIXED_SQL + """
SELECT server_id, metric_name, ts,
       CASE WHEN score_max = score_min THEN 0.5 ELSE (raw - score_min) / (score_max - score_min) END AS score
FROM raw JOIN b USING (server_id, metric_name)""")
def m3_fixed(spark, d):
    raw = cut_lineage(_fixed_raw(spark, d))
    return iforest.normalise(raw, iforest.bounds(raw))


@register("A22_fixed_forest_bounds", _FIXED_SQL + """
SELECT server_id, metric_name, score_min, score_max, n_samples, data_range_start, data_range_end FROM b""")
def a22_fixed(spark, d):
    return iforest.bounds(_fixed_raw(spark, d))


@register("M4_F22_score_new_rows", _FIXED_SQL + """,
half AS (SELECT make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2) AS cut FROM raw),
old AS (SELECT server_id, metric_name, min(raw) AS lo, max(raw) AS hi FROM raw, half WHERE ts < cut GROUP BY ALL)
SELECT server_id, metric_name, ts,
       CASE WHEN hi = lo THEN 0.5 ELSE greatest(0.0, least(1.0, (raw - lo) / (hi - lo))) END AS score
FROM raw JOIN old USING (server_id, metric_name)""")
def m4_new(spark, d):
    """A model fitted on the older half of the history scores all of it: rows
    outside the range it has seen are clamped."""
    f = cut_lineage(feats(spark, d))
    low, high = f.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    old = f.filter(F.unix_micros("ts") < (low + high) // 2)
    trees = _fixed_trees(spark, f)
    b = iforest.bounds(iforest.raw_scores(old, trees)).toDF(*iforest.KEY, "score_min", "score_max", "n_samples",
                                                            "data_range_start", "data_range_end")
    models = iforest.with_metadata(trees, b, "2024-01-31 00:00:00")
    models = models.toDF(*models.columns)
    return iforest.score_published(f, models)


def _online_sql(scaled: bool = False):
    """The online replay in SQL: descend the fixed trees level by level, count
    node masses per window, score against the window before."""
    so_far = "OVER (PARTITION BY server_id, metric_name ORDER BY ts, value ROWS UNBOUNDED PRECEDING)"
    fed = "value" if not scaled else (f"CASE WHEN max(value) {so_far} > min(value) {so_far} THEN (value - min(value) {so_far}) "
                                      f"/ (max(value) {so_far} - min(value) {so_far}) ELSE 0.5 END")
    feat, split = hst.make_trees(len(hst.FEATURES))
    cells = ", ".join(f"({t}, {n}, {feat[t, n]}, {float(split[t, n])!r})" for t in range(hst.N_TREES) for n in range(1, 2 ** hst.HEIGHT))
    value = "CASE s.q " + " ".join(f"WHEN {i} THEN l.{c}" for i, c in enumerate(hst.FEATURES)) + " END"
    levels = "".join(f"""
l{k + 1} AS (SELECT l.* REPLACE (2 * l.node + CASE WHEN {value} >= s.split THEN 1 ELSE 0 END AS node)
     FROM l{k} l JOIN splits s ON s.t = l.t AND s.node = l.node),""" for k in range(hst.HEIGHT))
    return f"""
, splits AS (SELECT * FROM (VALUES {cells}) v(t, node, q, split)),
pts AS (SELECT server_id, metric_name, ts, {fed} AS value,
  row_number() OVER (PARTITION BY server_id, metric_name ORDER BY ts, value) - 1 AS idx,
  sin(2 * pi() * (hour(ts) + minute(ts) / 60.0 + second(ts) / 3600.0) / 24) AS hour_sin,
  cos(2 * pi() * (hour(ts) + minute(ts) / 60.0 + second(ts) / 3600.0) / 24) AS hour_cos,
  CAST(isodow(ts) - 1 AS DOUBLE) AS day_of_week, CASE WHEN isodow(ts) >= 6 THEN 1.0 ELSE 0.0 END AS is_weekend
  FROM metrics_fast),
l0 AS (SELECT *, idx // {hst.WINDOW} AS win, unnest(range({hst.N_TREES})) AS t, CAST(1 AS BIGINT) AS node FROM pts),{levels}
path AS (SELECT server_id, metric_name, ts, idx, win, t, d, node >> CAST({hst.HEIGHT} - d AS BIGINT) AS node
  FROM l{hst.HEIGHT}, (SELECT unnest(range({hst.HEIGHT + 1})) AS d)),
mass AS (SELECT server_id, metric_name, win + 1 AS win, t, d, node, count(*) AS r FROM path GROUP BY ALL),
seen AS (SELECT p.*, coalesce(m.r, 0) AS r FROM path p LEFT JOIN mass m USING (server_id, metric_name, win, t, d, node)),
stops AS (SELECT *, coalesce(min(CASE WHEN r < {hst.LIMIT * hst.WINDOW} THEN d END)
  OVER (PARTITION BY server_id, metric_name, idx, t), {hst.HEIGHT}) AS stop FROM seen)
SELECT server_id, metric_name, ts,
  CASE WHEN win = 0 THEN 0.0 ELSE greatest(0.0, least(1.0,
    1 - sum(CASE WHEN d <= stop THEN r * pow(2, d) ELSE 0 END) / {hst.max_score(hst.N_TREES, hst.HEIGHT, hst.WINDOW)})) END AS score
FROM stops GROUP BY server_id, metric_name, ts, idx, win"""


@register("R5_online_hst_scores", _online_sql())
def r5(spark, d):
    return hst.online_scores(B.metrics_fast(spark, d))


@register("R5_online_scores_running_minmax", _online_sql(scaled=True))
def r5_scaled(spark, d):
    return hst.online_scores(B.metrics_fast(spark, d), scale="running_minmax")


@register("R5_hst_window_index", """
SELECT server_id, metric_name, (rn - 1) // 250 AS win, count(*) AS n FROM (
  SELECT server_id, metric_name, row_number() OVER (PARTITION BY server_id, metric_name ORDER BY ts, value) AS rn
  FROM metrics_fast) GROUP BY ALL""")
def r5_windows(spark, d):
    from fleetscope.operators.chunked import row_index
    x = row_index(B.metrics_fast(spark, d), ["server_id", "metric_name"], "ts", ["value"], chunk_us=3_600_000_000)
    return (x.groupBy("server_id", "metric_name", (F.col("idx") / 250).cast("long").alias("win"))
            .agg(F.count(F.lit(1)).alias("n")))


@register("S14_training_scan", f"""
, ff AS ({_FEATURES_SQL}),
el AS (SELECT server_id, metric_name FROM metrics_fast GROUP BY ALL HAVING count(*) >= {MIN_SAMPLES})
SELECT server_id, metric_name, ts, rolling_mean_5m, rolling_std_5m, rate_of_change, hour_sin, hour_cos,
       day_of_week, is_weekend
FROM ff JOIN el USING (server_id, metric_name)""")
def s14(spark, d):
    f = feats(spark, d)
    return f.join(iforest.eligible(f, MIN_SAMPLES).select("server_id", "metric_name"),
                  ["server_id", "metric_name"], "left_semi").select(
        "server_id", "metric_name", "ts", *iforest.FEATURES)


@register("A22_training_metadata", f"""
SELECT server_id, metric_name, count(*) AS n_samples, min(ts) AS data_range_start, max(ts) AS data_range_end
FROM metrics_fast GROUP BY ALL HAVING count(*) >= {MIN_SAMPLES}""")
def a22_meta(spark, d):
    f = cut_lineage(feats(spark, d))
    trees = iforest.train(f, MIN_SAMPLES, N_TREES)
    raw = iforest.raw_scores(f.join(iforest.eligible(f, MIN_SAMPLES).select("server_id", "metric_name"),
                                    ["server_id", "metric_name"], "left_semi"), trees)
    return iforest.bounds(raw).select("server_id", "metric_name", "n_samples", "data_range_start", "data_range_end")


@register("M3_F22_score_invariants", f"""
SELECT server_id, metric_name, count(*) AS n_scored, TRUE AS has_zero, TRUE AS has_one, TRUE AS in_range
FROM metrics_fast GROUP BY ALL HAVING count(*) >= {MIN_SAMPLES}""")
def m3_inv(spark, d):
    s = iforest.fit_and_score(feats(spark, d), MIN_SAMPLES, N_TREES)
    return s.groupBy("server_id", "metric_name").agg(
        F.count(F.lit(1)).alias("n_scored"),
        (F.min("score") == 0.0).alias("has_zero"),
        (F.max("score") == 1.0).alias("has_one"),
        F.bool_and(F.col("score").between(0.0, 1.0)).alias("in_range"))


@register("R5_hst_score_invariants", """
SELECT server_id, metric_name, count(*) AS n_scored, TRUE AS first_window_silent, TRUE AS in_range
FROM metrics_fast GROUP BY ALL""")
def r5_inv(spark, d):
    s = hst.online_scores(B.metrics_fast(spark, d))
    return s.groupBy("server_id", "metric_name").agg(
        F.count(F.lit(1)).alias("n_scored"),
        (F.count_if(F.col("score") == 0.0) >= F.least(F.count(F.lit(1)), F.lit(hst.WINDOW))).alias(
            "first_window_silent"),
        F.bool_and(F.col("score").between(0.0, 1.0)).alias("in_range"))
