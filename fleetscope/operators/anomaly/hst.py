"""Online half-space-tree scoring (R5) as a set-based replay.

Half-space trees (Tan, Ting & Liu 2011) score a point from the *reference
mass* of the nodes it falls into, and the reference masses of window k are
the point counts of window k-1 (windows of ``window`` consecutive points per
series).  So "score, then learn" over a stream equals:

1. number the points of each series (exact chunked row index);
2. deal them out by (series, run of consecutive windows), the points of a
   run's last window also to the next run as its reference;
3. in each run, find every point's leaf in every tree, count the points per
   (window, tree, node), and score each point against the counts of the window
   before: down each tree, masses times 2^depth are added up to and including
   the first node whose mass is below ``LIMIT`` of a window, and
   score = 1 - sum / (n_trees * window * (2^(height + 1) - 1)).

Points of the first window score 0 (no reference masses yet).  A run is
bounded, so a long series is many tasks; nothing is collected per series.
Trees: each node halves the current range of a random feature; the workspace
is randomly perturbed per tree, as in the paper.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import timefeat
from fleetscope.operators.chunked import row_index, running_extremes

# ---- fixed values: model inputs and defaults -------------------------------
FEATURES = ["value", "hour_sin", "hour_cos", "day_of_week", "is_weekend"]
N_TREES = 10
HEIGHT = 8
WINDOW = 250
SEED = 42
LIMIT = 0.1                  # of a window: a node of less mass ends the walk
# -----------------------------------------------------------------------------

#: How values are scaled for the trees.
SCALES = ("none", "running_minmax")
KEY = ["server_id", "metric_name"]
WINDOWS_PER_TASK = 64


def max_score(n_trees: int, height: int, window: int) -> float:
    return float(n_trees * window * (2 ** (height + 1) - 1))


def make_trees(n_features: int, n_trees: int = N_TREES, height: int = HEIGHT, seed: int = SEED,
               limits: tuple[float, float] = (0.0, 1.0)):
    """(feature, split) arrays in 1-based heap order for every tree."""
    rng = np.random.default_rng(seed)
    n_int = 2 ** height
    feat = np.zeros((n_trees, n_int), dtype=np.int64)
    split = np.zeros((n_trees, n_int), dtype=np.float64)
    lo0, hi0 = limits
    for t in range(n_trees):
        s = rng.uniform(lo0, hi0, n_features)
        r = 2 * np.maximum(s - lo0, hi0 - s)
        lo, hi = s - r, s + r
        stack = [(1, lo.copy(), hi.copy())]
        while stack:
            node, a, b = stack.pop()
            if node >= n_int:
                continue
            q = int(rng.integers(n_features))
            mid = (a[q] + b[q]) / 2.0
            feat[t, node], split[t, node] = q, mid
            la, lb = a.copy(), b.copy()
            lb[q] = mid
            ra, rb = a.copy(), b.copy()
            ra[q] = mid
            stack.append((2 * node, la, lb))
            stack.append((2 * node + 1, ra, rb))
    return feat, split


def leaves(x: np.ndarray, feat: np.ndarray, split: np.ndarray, height: int) -> np.ndarray:
    """Leaf index (0 .. 2^height - 1) of every row in every tree."""
    n_trees = feat.shape[0]
    out = np.zeros((len(x), n_trees), dtype=np.int64)
    rows = np.arange(len(x))
    for t in range(n_trees):
        node = np.ones(len(x), dtype=np.int64)
        for _ in range(height):
            q = feat[t, node]
            right = x[rows, q] >= split[t, node]
            node = 2 * node + right
        out[:, t] = node - 2 ** height
    return out


def node_paths(leaf: np.ndarray, height: int) -> np.ndarray:
    """(point, tree, depth): the nodes from root to leaf, in 1-based heap order."""
    return (leaf[:, :, None] + 2 ** height) >> (height - np.arange(height + 1))


def node_masses(paths: np.ndarray, window_of: np.ndarray, windows: int, height: int) -> np.ndarray:
    """(window, tree, node): how many points went through each node."""
    n_trees, width = paths.shape[1], 2 ** (height + 1)
    cell = (window_of[:, None, None] * n_trees + np.arange(n_trees)[None, :, None]) * width + paths
    return np.bincount(cell.ravel(), minlength=windows * n_trees * width).reshape(windows, n_trees, width)


def point_scores(paths: np.ndarray, reference: np.ndarray, window: int) -> np.ndarray:
    """Scores against ``reference`` masses, (tree, node) or one such per point."""
    n_trees, height = paths.shape[1], paths.shape[2] - 1
    trees = np.arange(n_trees)[None, :, None]
    mass = (reference[trees, paths] if reference.ndim == 2
            else reference[np.arange(len(paths))[:, None, None], trees, paths])
    small = mass < LIMIT * window
    stop = np.where(small.any(axis=2), small.argmax(axis=2), height)
    depth = np.arange(height + 1)
    total = (mass * 2.0 ** depth * (depth <= stop[:, :, None])).sum(axis=(1, 2))
    return np.clip(1.0 - total / max_score(n_trees, height, window), 0.0, 1.0)


def _score_run(feat: np.ndarray, split: np.ndarray, height: int, window: int):
    """Score the points of a run of windows; rows of the window before it only
    count as reference."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["run"].iloc[0]) * WINDOWS_PER_TASK - 1      # the reference window of the run
        win = (pdf["idx"].to_numpy() // window - first).astype(np.int64)
        paths = node_paths(leaves(pdf[FEATURES].to_numpy(dtype=np.float64), feat, split, height), height)
        masses = node_masses(paths, win, WINDOWS_PER_TASK + 1, height)
        scores = np.zeros(len(pdf))
        for w in range(1, WINDOWS_PER_TASK + 1):
            own = win == w
            if first + w > 0 and own.any():
                scores[own] = point_scores(paths[own], masses[w - 1], window)
        own = win > 0
        return pd.DataFrame({"server_id": pdf["server_id"][own], "metric_name": pdf["metric_name"][own],
                             "ts": pdf["ts"][own], "score": scores[own]})
    return fn


def with_time_features(metrics: DataFrame) -> DataFrame:
    return (metrics.withColumn("hour_sin", timefeat.hour_sin("ts"))
            .withColumn("hour_cos", timefeat.hour_cos("ts"))
            .withColumn("day_of_week", timefeat.day_of_week("ts").cast("double"))
            .withColumn("is_weekend", timefeat.is_weekend("ts").cast("double")))


def running_minmax(metrics: DataFrame, chunk_us: int | None = None) -> DataFrame:
    """(server_id, metric_name, ts, value): each value placed between the
    smallest and the largest value of its series so far, itself included, so
    nothing looks into the future; 0.5 while they are the same.  The trees
    expect numbers from 0 to 1."""
    x = running_extremes(metrics.select(*KEY, "ts", "value"), KEY, "ts", "value", ["value"], chunk_us)
    scaled = F.when(F.col("high") > F.col("low"), (F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.5)
    return x.withColumn("_raw", F.col("value")).withColumn("value", scaled).drop("low", "high")


def online_scores(metrics: DataFrame, n_trees: int = N_TREES, height: int = HEIGHT, window: int = WINDOW,
                  seed: int = SEED, chunk_us: int | None = None, scale: str = "none") -> DataFrame:
    """R5 replay: (server_id, metric_name, ts, score) for every sample.  With
    ``scale`` ``none`` values are fed as they are, with the default (0, 1)
    workspace, as the reference does; with ``running_minmax`` they are scaled
    by the bounds of the series so far (bounds of a whole series would look
    into the future)."""
    if scale not in SCALES:
        raise ValueError(f"scale is one of {SCALES}")
    x = metrics.select(*KEY, "ts", "value")
    order = ["value"]
    if scale == "running_minmax":
        x, order = running_minmax(x, chunk_us), ["_raw"]
    x = with_time_features(x)
    feat, split = make_trees(len(FEATURES), n_trees, height, seed)
    x = row_index(x, KEY, "ts", order, out="idx", chunk_us=chunk_us)
    win = F.floor(F.col("idx") / window)
    run = F.floor(win / WINDOWS_PER_TASK)
    last = win % WINDOWS_PER_TASK == WINDOWS_PER_TASK - 1
    x = x.withColumn("run", F.explode(F.when(last, F.array(run, run + 1)).otherwise(F.array(run))))
    return x.groupBy(*KEY, "run").applyInPandas(_score_run(feat, split, height, window), HST_OUT_SCHEMA)


# --- streaming twin ------------------------------------------------------------

HST_STATE_SCHEMA = "idx long, l array<long>, r array<long>"
HST_OUT_SCHEMA = "server_id string, metric_name string, ts timestamp, score double"


def _stream_fn(feat: np.ndarray, split: np.ndarray, height: int, window: int):
    n_trees = feat.shape[0]
    width = 2 ** (height + 1)

    def fn(key, batches, state):
        if state.exists:
            idx, l_, r_ = state.get
            learned = np.asarray(l_, dtype=np.int64).reshape(n_trees, width)
            reference = np.asarray(r_, dtype=np.int64).reshape(n_trees, width)
        else:
            idx, learned, reference = 0, np.zeros((n_trees, width), np.int64), np.zeros((n_trees, width), np.int64)
        rows = pd.concat(list(batches)).sort_values(["ts", "value"], kind="mergesort")
        paths = node_paths(leaves(rows[FEATURES].to_numpy(dtype=np.float64), feat, split, height), height)
        scores, a = np.zeros(len(rows)), 0
        while a < len(rows):                       # slices that end with a window
            b = min(len(rows), a + window - idx % window)
            if idx >= window:
                scores[a:b] = point_scores(paths[a:b], reference, window)
            learned = learned + node_masses(paths[a:b], np.zeros(b - a, np.int64), 1, height)[0]
            idx, a = idx + b - a, b
            if idx % window == 0:
                reference, learned = learned, np.zeros_like(learned)
        state.update((int(idx), learned.ravel().tolist(), reference.ravel().tolist()))
        yield pd.DataFrame({"server_id": rows["server_id"].to_numpy(), "metric_name": rows["metric_name"].to_numpy(),
                            "ts": rows["ts"].to_numpy(), "score": scores})
    return fn


def stream_scores(metrics: DataFrame, n_trees: int = N_TREES, height: int = HEIGHT, window: int = WINDOW,
                  seed: int = SEED) -> DataFrame:
    """R5 stream: score-then-learn per (server, metric) with the tree masses
    and the point count in the state store (``applyInPandasWithState``).
    Fed in time order it yields exactly ``online_scores``."""
    from pyspark.sql.streaming.state import GroupStateTimeout
    feat, split = make_trees(len(FEATURES), n_trees, height, seed)
    x = with_time_features(metrics.select(*KEY, "ts", "value"))
    return (x.groupBy(*KEY).applyInPandasWithState(_stream_fn(feat, split, height, window), HST_OUT_SCHEMA,
                                                   HST_STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout))
