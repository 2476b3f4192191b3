"""Per-series isolation forests.

Spark does the data work; numpy only builds and walks trees inside tasks:

* A23 gate: series with fewer than ``min_samples`` feature rows are skipped.
* M2 train: every tree draws its ``sample_size`` rows from all rows of its
  series, by a hash of (row, tree): a row is sent to the trees whose hash is
  low enough, and each tree keeps its lowest.  Rows meet per (series, block of
  trees), so a long series is trained by many tasks, and the same data and
  seed give the same forest whatever the partitioning.
* M3 score: feature rows are spread over ``ceil(n / rows_per_task)`` salts
  per series and cogrouped with that series' trees, so a huge series is
  scored by many tasks.
* A22 bounds: min/max raw score, sample count and time range per series,
  aggregated over all scored training rows; F22 normalises with them.
* M4 registry: models carry a ``version``; readers keep the latest version.

The algorithm follows Liu, Ting & Zhou (2008): random feature, uniform split
between the node's min and max, depth limit ceil(log2(sample_size)),
path length corrected by c(n) at leaves, score 2^(-E[h]/c(psi)).
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.operators.dedup import latest_version

# ---- fixed values: model inputs and defaults -------------------------------
FEATURES = ["rolling_mean_5m", "rolling_std_5m", "rate_of_change", "hour_sin", "hour_cos",
            "day_of_week", "is_weekend"]
MIN_SAMPLES = 500
N_TREES = 100
SAMPLE_SIZE = 256
SEED = 42
# -----------------------------------------------------------------------------

# trees that one grouped task builds, and how many times its sample a tree is sent on average
TREES_PER_TASK = 10
OVERDRAW = 1.5

KEY = ["server_id", "metric_name"]
TREE_SCHEMA = ("server_id string, metric_name string, tree_id int, feature array<int>, split array<double>, "
               "left array<int>, right array<int>, size array<int>, sample_size int")
TREE_COLUMNS = ["tree_id", "feature", "split", "left", "right", "size", "sample_size"]
MODEL_COLUMNS = [*KEY, *TREE_COLUMNS, "version", "score_min", "score_max", "n_samples", "data_range_start",
                 "data_range_end", "trained_at", "contamination"]
SCORE_SCHEMA = "server_id string, metric_name string, ts timestamp, raw double"


def _c(n):
    """Average path length of an unsuccessful BST search among n points."""
    n = np.asarray(n, dtype=np.float64)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + 0.5772156649) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def build_tree(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    feat, split, left, right, size = [], [], [], [], []
    stack = [(np.arange(len(x)), 0, -1, False)]
    while stack:
        idx, depth, parent, is_right = stack.pop()
        node = len(feat)
        if parent >= 0:
            (right if is_right else left)[parent] = node
        feat.append(-1), split.append(0.0), left.append(-1), right.append(-1), size.append(len(idx))
        if depth >= max_depth or len(idx) <= 1:
            continue
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if len(cand) == 0:
            continue
        f = int(rng.choice(cand))
        s = float(rng.uniform(lo[f], hi[f]))
        feat[node], split[node] = f, s
        go_left = sub[:, f] < s
        stack.append((idx[~go_left], depth + 1, node, True))
        stack.append((idx[go_left], depth + 1, node, False))
    return feat, split, left, right, size


def path_lengths(x: np.ndarray, feat, split, left, right, size) -> np.ndarray:
    feat, split = np.asarray(feat), np.asarray(split)
    left, right = np.asarray(left), np.asarray(right)
    leaf = _c(np.asarray(size))
    out = np.zeros(len(x), dtype=np.float64)
    # rows go down the tree together, one set of row numbers a node
    stack = [(0, 0, np.arange(len(x)))]
    while stack:
        node, depth, idx = stack.pop()
        if feat[node] < 0:
            out[idx] = depth + leaf[node]
            continue
        go_left = x[idx, feat[node]] < split[node]
        for child, own in ((left[node], idx[go_left]), (right[node], idx[~go_left])):
            if len(own):
                stack.append((child, depth + 1, own))
    return out


def _train_group(sample_size: int, seed: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        key = (pdf["server_id"].iloc[0], pdf["metric_name"].iloc[0])
        series = zlib.crc32(f"{key[0]}\x00{key[1]}".encode())
        psi = int(min(sample_size, pdf["n"].iloc[0]))
        depth = max(1, math.ceil(math.log2(max(psi, 2))))
        rows = []
        for t, own in pdf.groupby("tree_id"):
            x = own.sort_values(["h", *FEATURES])[FEATURES].to_numpy(dtype=np.float64)[:psi]
            tree = build_tree(x, np.random.default_rng([seed, series, int(t)]), depth)
            rows.append((*key, int(t), *tree, psi))
        return pd.DataFrame(rows, columns=["server_id", "metric_name", "tree_id", "feature", "split",
                                           "left", "right", "size", "sample_size"])
    return fn


def _score_group(keys, feats: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
    if feats.empty or trees.empty:
        return pd.DataFrame({"server_id": pd.Series([], dtype=object), "metric_name": pd.Series([], dtype=object),
                             "ts": pd.Series([], dtype="datetime64[us]"), "raw": pd.Series([], dtype=float)})
    x = np.asfortranarray(feats[FEATURES].to_numpy(dtype=np.float64))
    total = np.zeros(len(x))
    for t in trees.itertuples(index=False):
        total += path_lengths(x, t.feature, t.split, t.left, t.right, t.size)
    psi = int(trees["sample_size"].iloc[0])
    mean = total / len(trees)
    raw = np.power(2.0, -mean / max(float(_c(np.array([psi]))[0]), 1e-12))
    return pd.DataFrame({"server_id": feats["server_id"].to_numpy(), "metric_name": feats["metric_name"].to_numpy(),
                         "ts": feats["ts"].to_numpy(), "raw": raw})


def eligible(features: DataFrame, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Per-series row counts of the series that may be trained."""
    return (features.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= min_samples))


def train(features: DataFrame, min_samples: int = MIN_SAMPLES, n_trees: int = N_TREES,
          sample_size: int = SAMPLE_SIZE, seed: int = SEED, version: str = "v1") -> DataFrame:
    """M2: one row per (series, tree)."""
    counts = eligible(features, min_samples)
    x = features.join(counts, KEY, "inner")
    steps = 1 << 40
    # a share of rows per tree that holds its sample with room to spare; each
    # tree then keeps exactly its lowest hashes
    share = F.least(F.lit(1.0), F.lit(float(OVERDRAW * sample_size)) / F.col("n"))
    draws = F.transform(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: F.struct(
        t.alias("tree_id"), F.pmod(F.xxhash64(F.lit(seed), t, "ts", *FEATURES), F.lit(steps)).alias("h")))
    drawn = F.explode(F.filter(draws, lambda d: d["h"] < share * steps)).alias("d")
    trees = (x.select(*KEY, "n", *FEATURES, drawn)
             .select(*KEY, "n", *FEATURES, "d.tree_id", "d.h")
             .groupBy(*KEY, F.floor(F.col("tree_id") / TREES_PER_TASK).alias("block"))
             .applyInPandas(_train_group(sample_size, seed), TREE_SCHEMA))
    return trees.withColumn("version", F.lit(version))


def raw_scores(features: DataFrame, trees: DataFrame, rows_per_task: int = 200_000) -> DataFrame:
    """M3 (raw): path-length score of every feature row under its series'
    forest; higher = more anomalous."""
    counts = features.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    salts = counts.withColumn("_salts", F.greatest(F.lit(1), F.ceil(F.col("_n") / rows_per_task).cast("int")))
    f = (features.join(salts.select(*KEY, "_salts"), KEY, "inner")
         .withColumn("_salt", F.pmod(F.xxhash64("ts"), F.col("_salts")).cast("int"))
         .select(*KEY, "_salt", "ts", *FEATURES))
    t = (trees.join(salts.select(*KEY, "_salts"), KEY, "inner")
         .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
         .select(*KEY, "_salt", *TREE_COLUMNS))
    return (f.groupBy(*KEY, "_salt").cogroup(t.groupBy(*KEY, "_salt"))
            .applyInPandas(_score_group, SCORE_SCHEMA))


def bounds(raw: DataFrame) -> DataFrame:
    """Normalisation bounds and training metadata per series."""
    return raw.groupBy(*KEY).agg(F.min("raw").alias("score_min"), F.max("raw").alias("score_max"),
                                 F.count(F.lit(1)).alias("n_samples"),
                                 F.min("ts").alias("data_range_start"), F.max("ts").alias("data_range_end"))


def normalise(raw: DataFrame, b: DataFrame) -> DataFrame:
    """(raw - min) / (max - min) clipped to [0, 1]; a zero range -> 0.5.
    (The reference's (max - decision) / range on the negated score is the
    same number.)"""
    x = raw.join(b.select(*KEY, "score_min", "score_max"), KEY, "inner")
    rng = F.col("score_max") - F.col("score_min")
    s = F.when(rng == 0, F.lit(0.5)).otherwise((F.col("raw") - F.col("score_min")) / rng)
    return x.select(*KEY, "ts", F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)).alias("score"))


def fit_and_score(features: DataFrame, min_samples: int = MIN_SAMPLES, n_trees: int = N_TREES,
                  sample_size: int = SAMPLE_SIZE, seed: int = SEED, version: str = "v1") -> DataFrame:
    """M2 + M3 + A22 + F22: normalised scores of the training rows.

    The feature rows and the raw scores are each used by several branches
    (gate, sample, scoring; bounds and normalisation), so both are written
    once to the shared checkpoint folder instead of being recomputed."""
    from fleetscope.session import cut_lineage
    features = cut_lineage(features)
    trees = train(features, min_samples, n_trees, sample_size, seed, version)   # read once
    raw = raw_scores(features.join(eligible(features, min_samples).select(*KEY), KEY, "left_semi"), trees)
    raw = cut_lineage(raw)
    return normalise(raw, bounds(raw)).withColumn("model_version", F.lit(version))


def with_metadata(models: DataFrame, b: DataFrame, trained_at, contamination: float | None = None) -> DataFrame:
    """M4: what a stored model needs to score new rows: its trees, the bounds
    and training range of its series (A22), and when it was trained."""
    return (models.join(b, KEY).withColumn("trained_at", F.lit(trained_at).cast("timestamp"))
            .withColumn("contamination", F.lit(contamination).cast("double")).select(*MODEL_COLUMNS))


def publish(models: DataFrame, path: str) -> None:
    """M4 write side: a model version is published by appending its rows to
    the model table, partitioned by ``version``; a failed write leaves no
    partial version behind (the job commit is atomic per version folder).
    Models without all of ``MODEL_COLUMNS`` are refused."""
    missing = [c for c in MODEL_COLUMNS if c not in models.columns]
    if missing:
        raise ValueError(f"model rows lack {', '.join(missing)}")
    models.select(*MODEL_COLUMNS).write.mode("append").partitionBy("version").parquet(path)


def read_published(spark, path: str) -> DataFrame:
    """M4 read side over the model table: newest version per series."""
    return latest_models(spark.read.parquet(path))


def latest_models(models: DataFrame) -> DataFrame:
    """M4 read side: newest published version per series."""
    newest = latest_version(models.select(*KEY, "version").distinct(), KEY, "version")
    return models.join(newest, [*KEY, "version"], "left_semi")


def score_published(features: DataFrame, models: DataFrame) -> DataFrame:
    """M3 + F22 for rows a model has not seen: raw scores under the stored
    trees, normalised with the stored bounds and clamped to [0, 1].  Series
    without a model give no rows."""
    raw = raw_scores(features.join(models.select(*KEY).distinct(), KEY, "left_semi"), models)
    return normalise(raw, models.select(*KEY, "score_min", "score_max").distinct())
