"""The online score writer.  Every series keeps its half-space trees, its
bounds and its own watermark in keyed state (RocksDB); a sample is scored
against the window before, then learned, and its score is appended to the
score table with the model version of the online model.

A stored model (``stored_models`` of a stopped query, kept as a table) seeds a
new query: series that are in it go on from their watermark, others start at
``start_at``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetscope.operators.anomaly import hst
from fleetscope.sources.sinks import append_layout
from fleetscope.streaming.alert_processor import use_rocksdb

# ---- fixed values: name of the online model, first look back, poll ----------
MODEL_VERSION = "river"
LOOK_BACK_S = 3600
EVERY_S = 60
# -----------------------------------------------------------------------------

POSITION = "idx long, low double, high double, since_us long"
MASSES = "learned binary, reference binary"
MODEL = f"server_id string, metric_name string, {POSITION}, {MASSES}, scale string, model_version string"
SCORED = "server_id string, metric_name string, ts timestamp, score double, model_version string"


class OnlineScorer(StatefulProcessor):
    """Score, then learn, one series."""

    def __init__(self, feat: np.ndarray, split: np.ndarray, height: int, window: int, scale: str, start_us: int):
        self.feat, self.split, self.height, self.window = feat, split, height, window
        self.scale, self.start_us = scale, start_us
        self.shape = (feat.shape[0], 2 ** (height + 1))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.position = handle.getValueState("position", POSITION)
        self.masses = handle.getValueState("masses", MASSES)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        # the stored watermark itself has been learned
        bound = lambda x: None if pd.isna(x) else float(x)
        self.position.update((int(r.idx), bound(r.low), bound(r.high), int(r.since_us) + 1))
        self.masses.update((bytes(r.learned), bytes(r.reference)))

    def _scaled(self, value: np.ndarray, low: float | None, high: float | None):
        lows = np.minimum.accumulate(value if low is None else np.append(low, value))[-len(value):]
        highs = np.maximum.accumulate(value if high is None else np.append(high, value))[-len(value):]
        width = highs - lows
        fed = np.where(width > 0, (value - lows) / np.where(width > 0, width, 1.0), 0.5)
        return (fed if self.scale == "running_minmax" else value), float(lows[-1]), float(highs[-1])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        idx, low, high, since = self.position.get() if self.position.exists() else (0, None, None, self.start_us)
        x = pd.concat(list(rows))
        us = x["ts"].astype("datetime64[us]").astype("int64")
        x = x[(us >= since).to_numpy()].sort_values(["ts", "value"], kind="mergesort")
        if x.empty:
            return
        zeros = np.zeros(self.shape, np.int64)
        learned, reference = ((np.frombuffer(b, np.int64).reshape(self.shape) for b in self.masses.get())
                              if self.masses.exists() else (zeros, zeros))
        fed, low, high = self._scaled(x["value"].to_numpy(np.float64), low, high)
        points = np.column_stack([fed, *[x[f].to_numpy(np.float64) for f in hst.FEATURES[1:]]])
        paths = hst.node_paths(hst.leaves(points, self.feat, self.split, self.height), self.height)
        scores, a = np.zeros(len(x)), 0
        while a < len(x):                          # slices that end with a window
            b = min(len(x), a + self.window - idx % self.window)
            if idx >= self.window:
                scores[a:b] = hst.point_scores(paths[a:b], reference, self.window)
            learned = learned + hst.node_masses(paths[a:b], np.zeros(b - a, np.int64), 1, self.height)[0]
            idx, a = idx + b - a, b
            if idx % self.window == 0:
                reference, learned = learned, zeros
        newest = int(x["ts"].astype("datetime64[us]").astype("int64").iloc[-1])
        self.position.update((int(idx), low, high, newest))
        self.masses.update((learned.astype(np.int64).tobytes(), reference.astype(np.int64).tobytes()))
        yield pd.DataFrame({"server_id": x["server_id"].to_numpy(), "metric_name": x["metric_name"].to_numpy(),
                            "ts": x["ts"].to_numpy(), "score": scores, "model_version": MODEL_VERSION})

    def close(self) -> None:
        pass


def online_scores(metrics: DataFrame, start_at=None, models: DataFrame | None = None, scale: str = "none",
                  n_trees: int = hst.N_TREES, height: int = hst.HEIGHT, window: int = hst.WINDOW, seed: int = hst.SEED) -> DataFrame:
    """Scores of a stream of samples (server_id, metric_name, ts, value), each
    scored once.  A series' watermark is its newest learned instant: an older
    sample that arrives in a later batch is late and is left out; one of the
    same instant is new.  Series without a model start at ``start_at`` (None:
    with their first sample).  ``models`` as ``stored_models`` gives them must
    be of the same scale and trees.  Samples without a number, a series or an
    instant are left out.  In time order the scores are those of
    ``hst.online_scores``, in any split into batches."""
    if scale not in hst.SCALES:
        raise ValueError(f"scale is one of {hst.SCALES}")
    use_rocksdb(metrics.sparkSession)
    feat, split = hst.make_trees(len(hst.FEATURES), n_trees, height, seed)
    start_us = -(1 << 62) if start_at is None else int(pd.Timestamp(start_at).value // 1000)
    x = metrics.select(*hst.KEY, F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    x = hst.with_time_features(x.dropna().where(~F.isnan("value")))
    seeds = None
    if models is not None:
        seeds = models.where((F.col("scale") == scale) & (F.length("learned") == 8 * n_trees * 2 ** (height + 1))).groupBy(*hst.KEY)
    return x.groupBy(*hst.KEY).transformWithStateInPandas(
        OnlineScorer(feat, split, height, window, scale, start_us), SCORED, "append", "none", seeds)


def scores_to_table(metrics: DataFrame, path: str, checkpoint: str, every_s: int | None = EVERY_S, **kw):
    """Start the writer (``every_s`` None: until the input is used up).  The
    table is laid out by month and batch, with ``ingest_seq`` for reading it
    through ``latest_version``; a batch that runs again replaces its rows."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("ingest_seq", F.lit(batch_id).cast("long")).withColumn("batch", F.lit(batch_id).cast("long"))
        (append_layout(rows, "ts", hst.KEY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("month", "batch").parquet(path))

    w = (online_scores(metrics, **kw).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .outputMode("append"))
    return (w.trigger(availableNow=True) if every_s is None else w.trigger(processingTime=f"{every_s} seconds")).start()


def stored_models(spark: SparkSession, checkpoint: str, scale: str = "none") -> DataFrame:
    """The models of a writer's checkpoint as a table: write it somewhere and
    hand it to a new query as ``models``."""
    use_rocksdb(spark)
    read = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint).select("key.*", "value.*")
    x = read("position").join(read("masses"), hst.KEY)
    return x.withColumns({"scale": F.lit(scale), "model_version": F.lit(MODEL_VERSION)}).select(
        *[c.split()[0] for c in MODEL.split(", ")])
