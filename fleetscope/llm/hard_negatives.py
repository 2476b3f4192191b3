"""Hard negatives by slots: the positives' scores cut the score axis of an
anchor into disjoint slots, and one top-k per slot answers every window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.llm.common import prepare, stored

#: Vectors of one block of candidates or anchors; rows of scores held at once.
CANDIDATES, ANCHORS, SLICE = 1 << 16, 1024, 64
EXACT = 1 << 53


def labelled_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v array<long>), v = floor(scale * x).  Rows without a
    vec_id, a label or a vector, or with a null or non-finite component, are
    left out; exact repeats of a row count once."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    whole = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()
                       & F.coalesce(finite, F.lit(False)))
    return whole.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).alias("v")).distinct()


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows, short ones filled with zeros, in the smallest type."""
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), int(n.max()) if len(n) else 0), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = column.flatten().to_numpy(zero_copy_only=False)
    top = max(int(out.max()), -int(out.min())) if out.size else 0
    return out.astype(next(t for t in (np.int16, np.int32, np.int64) if top <= np.iinfo(t).max))


BLOCK = "block long, ids binary, labels binary, limits binary, width long, kind string, flat binary"


def _block(t: pa.Table) -> pa.Table:
    """One row for all vectors of a block; ``limits`` are the slot limits of
    its anchors, a fixed number each."""
    m = _matrix(t.column("v").combine_chunks())
    limits = t.column("limits").combine_chunks().flatten() if "limits" in t.column_names else pa.array([], pa.int64())
    cells = {"ids": t.column("vec_id").to_numpy().tobytes(), "labels": t.column("label").to_numpy().tobytes(),
             "limits": limits.to_numpy(zero_copy_only=False).astype(np.int64).tobytes()}
    return pa.table({"block": t.column("block")[:1].cast(pa.int64()), **{k: pa.array([b], pa.binary()) for k, b in cells.items()},
                     "width": pa.array([m.shape[1]], pa.int64()), "kind": [m.dtype.str], "flat": pa.array([m.tobytes()], pa.binary())})


def inner_products(a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
    """For each row of ``a`` its integer inner products with the rows of ``b``;
    zeros past a shorter vector's end."""
    d = min(a.shape[1], b.shape[1])
    top = lambda m: max(abs(int(m.max())), abs(int(m.min()))) if m.size else 0
    a, b = a[:, :d], b[:, :d]
    bound = top(a) * top(b) * d
    if bound >= 1 << 62:
        raise ValueError("an inner product may leave the 64-bit integers")
    kind = np.float64 if bound < EXACT else np.int64        # whole numbers under 2 ** 53 are exact in either
    a, b = a.astype(kind), b.astype(kind)
    for i in range(0, len(a), SLICE):
        yield from (a[i:i + SLICE] @ b.T).astype(np.int64)


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(score) > k:
        floor = score[np.argpartition(-score, k - 1)[k - 1]]
        at = np.flatnonzero(score >= floor)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:k]


def slots(score: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Slot of each score under descending upper limits: slot j holds the scores
    over limit j + 1 and up to limit j; -1 is over the first limit."""
    return len(limits) - 1 - np.searchsorted(limits[::-1], score, side="left")


def _positives(score, ids, labels, anchor, label, limits, k, low):
    at = np.flatnonzero((labels == label) & (ids != anchor))
    best = at[_first(score[at], ids[at], k)]
    return best, np.zeros(len(best), np.int32)


def _negatives(score, ids, labels, anchor, label, limits, k, low):
    """Top k of each slot, among the rows that some window may hold."""
    limits = limits[limits >= 0]        # a negative limit has an empty window
    if not len(limits):
        return np.empty(0, np.int64), np.empty(0, np.int32)
    at = np.flatnonzero((labels != label) & (ids != anchor) & (score <= limits[0]) & (100 * score >= low * limits[-1]))
    slot = slots(score[at], limits)
    picked = [at[own[_first(score[at[own]], ids[at[own]], k)]]
              for own in (np.flatnonzero(slot == j) for j in range(len(limits)))]
    return np.concatenate(picked), np.repeat(np.arange(len(limits), dtype=np.int32), [len(p) for p in picked])


FOUND = "anchor_id long, slot int, vec_id long, label long, score long"


def _scan(pick, k: int, low: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                cell = {c: batch.column(i)[r].as_py() for i, c in enumerate(batch.schema.names)}
                own = {c: np.frombuffer(cell[c], np.int64) for c in ("ids", "labels", "a_ids", "a_labels", "a_limits")}
                block = np.frombuffer(cell["flat"], cell["kind"]).reshape(len(own["ids"]), cell["width"])
                anchors = np.frombuffer(cell["a_flat"], cell["a_kind"]).reshape(len(own["a_ids"]), cell["a_width"])
                limits = own["a_limits"].reshape(len(anchors), -1)
                out = []
                for i, score in enumerate(inner_products(anchors, block)):
                    at, slot = pick(score, own["ids"], own["labels"], own["a_ids"][i], own["a_labels"][i], limits[i], k, low)
                    out.append((np.full(len(at), own["a_ids"][i]), slot, own["ids"][at], own["labels"][at], score[at]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)],
                                                 ["anchor_id", "slot", "vec_id", "label", "score"])
    return run


def _search(anchors: DataFrame, blocks: DataFrame, n_blocks: int, n_anchors: int, pick, k: int, low: int = 0) -> DataFrame:
    """Partial lists (anchor_id, slot, vec_id, label, score), k a slot and block:
    every anchor block meets every candidate block once, in a merge join that
    holds the candidate block.  A broadcast would have the driver hold a copy of
    all anchors for every candidate block, of which Spark's estimate knows
    nothing."""
    deal = F.pmod(F.xxhash64("vec_id"), F.lit(-(-n_anchors // ANCHORS))).alias("block")
    packed = anchors.select(deal, "*").groupBy("block").applyInArrow(_block, BLOCK)
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block")
    sent = packed.select(each, *[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "limits", "width", "kind", "flat")])
    return sent.hint("merge").join(blocks.drop("limits"), "block").drop("block").mapInArrow(_scan(pick, k, low), FOUND)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, k: int = 5, low: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score, negative_label): for each anchor and each of its first
    ``positives`` rows of the same label, the first ``k`` rows of other labels
    whose score is at most the positive's and at least ``low`` per cent of it.

    Both tables are of ``labelled_vectors``.  Rows are packed into blocks dealt
    by a hash of the row, anchors into blocks sent to every block of rows.  One
    pass finds the positives.  Their scores, the upper limits of the windows,
    cut an anchor's score axis into disjoint slots; a second pass keeps the top
    k of each slot and block, and a grouped top k merges the blocks.  The window
    of positive j is the k first rows of slots j, j + 1, ... in falling order,
    up to the first one under its lower limit: at most ``positives`` times k
    rows an anchor, however many windows hold a row.

    Scores are 64-bit integers (components that might leave them raise an
    error); higher ones come first, ties by smaller vec_id.  Zeros follow a
    shorter vector.  A negative positive score has an empty window, one of zero
    holds zeros only.  A row never meets its own vec_id; of anchors that share
    an id the one with the smallest (label, vector) asks.  Anchors without
    positives, and empty tables, give no rows."""
    spark = prepare(rows.sparkSession)
    rows = stored(rows, "rows")
    anchors = stored(anchors.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("m"))
                     .select("vec_id", "m.label", "m.v"), "anchors")
    n, m = rows.count(), anchors.count()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, negative_label long"
    if not n or not m:
        return spark.createDataFrame([], result)
    # enough blocks for the cluster, as far as the anchors sent to them stay near twice the rows
    spread = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, 2 * n // m))
    n_blocks = max(-(-n // CANDIDATES), min(n // 64 + 1, spread))
    deal = F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(n_blocks)).alias("block")
    blocks = stored(rows.select(deal, "*").groupBy("block").applyInArrow(_block, BLOCK), "blocks")

    best = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    top = lambda found, most: found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= most)
    pairs = stored(top(_search(anchors, blocks, n_blocks, m, _positives, positives), positives)
                   .select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # distinct limits in falling order, filled up to a fixed number with -1
    limits = F.reverse(F.array_sort(F.collect_set("positive_score")))
    asked = pairs.groupBy("anchor_id").agg(limits.alias("own")).select(
        F.col("anchor_id").alias("vec_id"), "own",
        F.slice(F.concat("own", F.array_repeat(F.lit(-1).cast("long"), positives)), 1, positives).alias("limits"))
    asking = anchors.hint("merge").join(asked.drop("own"), "vec_id")     # vectors are packed on disk, wide in the driver
    kept = top(_search(asking, blocks, n_blocks, m, _negatives, k, low), k)
    lists = kept.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct(
        "slot", (-F.col("score")).alias("down"), "vec_id", "label"))).alias("merged"))
    windows = pairs.join(asked.withColumnRenamed("vec_id", "anchor_id").drop("limits"), "anchor_id").join(lists, "anchor_id")
    suffix = F.slice(F.filter("merged", lambda x: x.slot >= F.col("first")), 1, k)
    inside = F.filter(suffix, lambda x: -x.down * 100 >= F.col("positive_score") * low)
    return (windows.withColumn("first", F.array_position("own", F.col("positive_score")) - 1)
            .select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("at", "x"))
            .select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("negative_id"),
                    "positive_score", (-F.col("x.down")).alias("negative_score"), F.col("x.label").alias("negative_label")))
