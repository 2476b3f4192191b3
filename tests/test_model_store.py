"""Two-phase publish: a broken model is never served."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetscope.operators.anomaly import iforest
from fleetscope.operators.anomaly.model_store import ModelStore, tree_fault

KEY = iforest.KEY


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(3)
    rows = [(s, "cpu", 1_700_000_000 + 15 * i, *map(float, rng.normal(50, 5, len(iforest.FEATURES)))) for s in "abc" for i in range(120)]
    columns = ", ".join(f"{c} double" for c in iforest.FEATURES)
    return spark.createDataFrame(rows, f"server_id string, metric_name string, t long, {columns}").withColumn(
        "ts", F.timestamp_seconds("t")).drop("t").persist()


def trained(f, seed, n_trees=5):
    trees = iforest.train(f, 100, n_trees, 64, seed)
    return iforest.with_metadata(trees, iforest.bounds(iforest.raw_scores(f, trees)), "2024-01-01 00:00:00")


@pytest.fixture(scope="module")
def models(spark, features, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("models"))
    for seed in (1, 2):
        trained(features, seed).write.parquet(f"{path}/{seed}")
    return [spark.read.parquet(f"{path}/{seed}") for seed in (1, 2)]


def versions(store):
    return {r.server_id: r.version for r in store.models().select("server_id", "version").distinct().collect()}


CHANGES = {
    "trees are missing or repeated": lambda m: m.where("tree_id <> 3"),
    "tree arrays differ in length": lambda m: m.withColumn("size", F.slice("size", 1, 1)),
    "tree nodes are not reached once each": lambda m: m.withColumn("left", F.transform("left", lambda x: F.when(x >= 0, F.lit(1)).otherwise(x))),
    "tree splits no known feature": lambda m: m.withColumn("split", F.transform("split", lambda x: F.lit(float("nan")))),
    "sample size is not one positive number": lambda m: m.withColumn("sample_size", F.lit(0)),
    "bounds are missing or differ within the model": lambda m: m.withColumn("score_min", F.lit(None).cast("double")),
    "bounds are not in order": lambda m: m.withColumn("score_min", F.col("score_max") + 1),
}


@pytest.mark.parametrize("reason", list(CHANGES))
def test_a_broken_version_is_never_served(spark, models, tmp_path, reason):
    store = ModelStore(spark, str(tmp_path))
    assert store.publish(models[0], "v1", 5).count() == 0
    broken = models[1].where("server_id = 'a'")
    mixed = CHANGES[reason](broken).select(*broken.columns).unionByName(models[1].where("server_id <> 'a'"))
    refused = {(r.server_id, r.reason) for r in store.publish(mixed, "v2", 5).collect()}
    assert refused == {("a", reason)}
    assert versions(store) == {"a": "v1", "b": "v2", "c": "v2"}


def test_tree_faults():
    good = ([0, -1, -1], [0.5, 0.0, 0.0], [1, -1, -1], [2, -1, -1], [3, 2, 1])
    assert tree_fault(*good) is None and tree_fault([-1], [0.0], [-1], [-1], [7]) is None
    loop = ([-1, 0, 0], [0.0, 0.5, 0.5], [-1, 2, 1], [-1, 0, 0], [1, 1, 1])
    assert tree_fault(*loop) is not None
    cycle = ([0, 0, 0, -1, -1, -1, -1], [0.5] * 7, [1, 4, 2, -1, -1, -1, -1], [3, 5, 6, -1, -1, -1, -1], [1] * 7)
    assert tree_fault(*cycle) == "tree has a child before its parent"
    assert tree_fault([9, -1, -1], *good[1:]) == "tree splits no known feature"
    assert tree_fault(*good[:4], [3, -2, 1]) == "tree leaf without size"
    assert tree_fault(None, *good[1:]) is not None and tree_fault([], [], [], [], []) is not None


def test_a_publish_that_breaks_off_shows_nothing(spark, models, features, tmp_path, monkeypatch):
    store = ModelStore(spark, str(tmp_path))
    with pytest.raises(ValueError):
        store.publish(models[0].drop("score_min"), "v0")
    store.publish(models[0], "v1", 5)

    def stop(*_, **__):
        raise RuntimeError("driver lost")
    monkeypatch.setattr(store.versions, "append", stop)
    with pytest.raises(RuntimeError):
        store.publish(models[1], "v2", 5)
    monkeypatch.undo()
    assert set(versions(store).values()) == {"v1"}              # written and validated, but not published
    scored = store.score(features.where("server_id = 'b'"))
    assert scored.count() == 120 and scored.where("score < 0 or score > 1").count() == 0
    store.publish(models[1].where("server_id = 'b'"), "v3", 5)
    assert versions(store) == {"a": "v1", "b": "v3", "c": "v1"}
    again = store.score(features.where("server_id = 'b'"))
    assert again.exceptAll(scored).count() > 0                  # another forest
