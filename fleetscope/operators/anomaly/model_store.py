"""M4: publishing of forests in two phases.

1. The version is written to a folder of its own, where no reader looks.
2. What was written is read back and every series' model is validated: its
   columns, its trees (each one is walked), its scores of probe points, its
   bounds.  The series that pass are added to ``model_versions`` by one commit;
   the others are reported with their reason and keep the model they had.

Readers join the table of versions, so they see whole published models only,
whatever a failed or running publish has left on disk.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.operators.anomaly import iforest
from fleetscope.sources.manifest import ManifestTable

KEY = iforest.KEY
PROBES = 16
PUBLISHED = "server_id string, metric_name string, version string, folder string, seq int"
MODELS = (f"{iforest.TREE_SCHEMA}, version string, score_min double, score_max double, n_samples long, "
          "data_range_start timestamp, data_range_end timestamp, trained_at timestamp, contamination double")
CHECKED = "server_id string, metric_name string, reason string"


def tree_fault(feature, split, left, right, size) -> str | None:
    """What is wrong with a tree, if anything: every node is reached once from
    the root, inner nodes split a known feature at a number, leaves have a
    size."""
    arrays = [feature, split, left, right, size]
    if any(a is None for a in arrays) or len({len(a) for a in arrays}) != 1 or not len(feature):
        return "tree arrays differ in length"
    f, s, lo, hi, n = (np.asarray(a) for a in arrays)
    inner = f >= 0
    children = np.sort(np.concatenate([lo[inner], hi[inner]]))
    if not np.array_equal(children, np.arange(1, len(f))):
        return "tree nodes are not reached once each"
    at = np.flatnonzero(inner)
    if (lo[at] <= at).any() or (hi[at] <= at).any():
        return "tree has a child before its parent"       # or a cycle
    if (f >= len(iforest.FEATURES)).any() or not np.isfinite(s[inner].astype(float)).all():
        return "tree splits no known feature"
    return "tree leaf without size" if (n[~inner] < 0).any() else None


def _probes(trees: pd.DataFrame) -> np.ndarray:
    """The origin and points around the splits that the trees use."""
    rng = np.random.default_rng(0)
    cuts: dict[int, list[float]] = {}
    for t in trees.itertuples(index=False):
        for f, s in zip(t.feature, t.split):
            if f >= 0:
                cuts.setdefault(int(f), []).append(float(s))
    out = np.zeros((PROBES, len(iforest.FEATURES)))
    for f, own in cuts.items():
        out[1:, f] = rng.choice(own, PROBES - 1) + rng.choice([-1.0, 0.0, 1.0], PROBES - 1)
    return out


def model_fault(model: pd.DataFrame, n_trees: int | None) -> str | None:
    """What is wrong with the model of one series, if anything."""
    ids = sorted(model["tree_id"].tolist())
    if ids != list(range(len(ids))) or (n_trees is not None and len(ids) != n_trees):
        return "trees are missing or repeated"
    for t in model.itertuples(index=False):
        fault = tree_fault(t.feature, t.split, t.left, t.right, t.size)
        if fault:
            return fault
    if model["sample_size"].nunique() != 1 or not model["sample_size"].iloc[0] > 0:
        return "sample size is not one positive number"
    x = _probes(model)
    mean = sum(iforest.path_lengths(x, t.feature, t.split, t.left, t.right, t.size) for t in model.itertuples(index=False)) / len(model)
    raw = np.power(2.0, -mean / max(float(iforest._c(np.array([model["sample_size"].iloc[0]]))[0]), 1e-12))
    if not (np.isfinite(raw).all() and (raw >= 0).all() and (raw <= 1).all()):
        return "probe scores are not between 0 and 1"
    b = model[["score_min", "score_max", "n_samples", "data_range_start", "data_range_end"]].drop_duplicates()
    if len(b) != 1 or b.isna().any(axis=None):
        return "bounds are missing or differ within the model"
    low, high, n, start, end = b.iloc[0]
    if not (np.isfinite(low) and np.isfinite(high) and low <= high and n > 0 and start <= end):
        return "bounds are not in order"
    return None


def validate(models: DataFrame, n_trees: int | None = None) -> DataFrame:
    """(server_id, metric_name, reason) for every series of ``models``; the
    reason is null if the model may be served."""
    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"server_id": pdf["server_id"].iloc[:1], "metric_name": pdf["metric_name"].iloc[:1],
                             "reason": [model_fault(pdf, n_trees)]})
    return models.groupBy(*KEY).applyInPandas(check, CHECKED)


class ModelStore:
    """Models at ``path``: folders of written versions, ``model_versions`` (the
    published ones, in a versioned table) and ``rejected``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = ManifestTable(spark, f"{self.path}/model_versions", "seq")

    def publish(self, models: DataFrame, version: str, n_trees: int | None = None) -> DataFrame:
        """Publish ``models`` (``iforest.MODEL_COLUMNS`` but the version) and
        return the refused series (server_id, metric_name, reason).  Models
        without all columns are refused as a whole.  A publish that breaks off
        before its commit has published nothing."""
        models = models.withColumn("version", F.lit(version))
        missing = [c for c in iforest.MODEL_COLUMNS if c not in models.columns]
        if missing:
            raise ValueError(f"model rows lack {', '.join(missing)}")
        folder = f"{version}-{uuid.uuid4().hex}"
        models.select(*iforest.MODEL_COLUMNS).write.parquet(f"{self.path}/written/{folder}")
        written = self.spark.read.parquet(f"{self.path}/written/{folder}")
        validate(written, n_trees).withColumn("version", F.lit(version)).write.parquet(f"{self.path}/checked/{folder}")
        checked = self.spark.read.parquet(f"{self.path}/checked/{folder}")
        good = checked.where("reason is null").select(*KEY, "version", F.lit(folder).alias("folder"))
        seq = self.versions.snapshot().version + 1
        if good.limit(1).count():
            self.versions.append(good.withColumn("seq", F.lit(seq)).coalesce(1))
        return checked.where("reason is not null").select(*KEY, "reason")

    def published(self) -> DataFrame:
        """(server_id, metric_name, version, folder, seq): the newest published
        model of each series."""
        if not self.versions.snapshot().files:
            return self.spark.createDataFrame([], PUBLISHED)
        return self.versions.read().groupBy(*KEY).agg(
            F.max_by(F.struct("version", "folder", "seq"), F.struct("seq", "folder")).alias("m")).select(*KEY, "m.*")

    def models(self, series: DataFrame | None = None) -> DataFrame:
        """The model rows that readers serve; with ``series`` (server_id,
        metric_name) of those only.  Only folders with a served model are read:
        one a publish that some series still uses."""
        now = self.published()
        if series is not None:
            now = now.join(series.select(*KEY).distinct(), KEY, "left_semi")
        now = now.persist()
        folders = [r.folder for r in now.select("folder").distinct().collect()]
        if not folders:
            return self.spark.createDataFrame([], MODELS)
        rows = self.spark.read.parquet(*[f"{self.path}/written/{f}" for f in sorted(folders)])
        rows = rows.withColumn("folder", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
        return rows.join(now.select(*KEY, "folder"), [*KEY, "folder"], "left_semi").drop("folder")

    def score(self, features: DataFrame) -> DataFrame:
        """F22 for rows of series with a published model."""
        return iforest.score_published(features, self.models(features))
