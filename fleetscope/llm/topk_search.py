"""Exact top-k by integer inner product, term at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.llm.common import prepare, stored

#: Most rows of a block, and about so many components.
CANDIDATES, QUERIES, CELLS, QUERY_CELLS = 1 << 16, 1 << 10, 1 << 22, 1 << 18
#: Queries whose scores are held at once; a term in a HEAVY-th of the rows goes by matrix.
SLICE, HEAVY = 64, 2
EXACT = 1 << 53


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>) with v = floor(scale * x); vectors that are null
    or hold a null or non-finite component are left out, and exact repeats of a
    row (same id, same components) count once."""
    x = F.col("embedding").cast("array<double>")
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull()
        & F.coalesce(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)))
    return whole.select("vec_id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).alias("v")).distinct()


def _top(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if len(x) else 0


def _block(t: pa.Table) -> pa.Table:
    """One row for all vectors of a block: ids, components in the smallest type
    and row offsets."""
    v = t.column("v").combine_chunks()
    flat = v.flatten().to_numpy(zero_copy_only=False)
    flat = flat.astype(next(k for k in (np.int16, np.int32, np.int64) if k is np.int64 or _top(flat) <= np.iinfo(k).max))
    offs = np.concatenate(([0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    cells = {"ids": t.column("vec_id").to_numpy().astype(np.int64), "flat": flat, "offs": offs}
    return pa.table({"block": t.column("block")[:1].cast(pa.int64()), "kind": [flat.dtype.str],
                     **{n: pa.array([x.tobytes()], pa.binary()) for n, x in cells.items()}})


BLOCK = "block long, kind string, ids binary, flat binary, offs binary"


def postings(flat: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """Per term: the rows that hold it and their weights (None: every row)."""
    n = len(offs) - 1
    row = np.repeat(np.arange(n), np.diff(offs))
    term = np.arange(len(flat)) - offs[row]
    held = np.flatnonzero(flat)
    order = held[np.argsort(term[held], kind="stable")]
    cuts = np.searchsorted(term[order], np.arange((int(term.max()) + 1 if len(term) else 0) + 1))
    return [(None if b - a == n else row[order[a:b]], flat[order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    at = np.arange(len(scores))
    if len(scores) >= 256 * k:          # k scores at least reach the k-th highest of the runs' tops
        tops = scores[:len(scores) // 256 * 256].reshape(-1, 256).max(axis=1)
        at = np.flatnonzero(scores >= np.partition(tops, len(tops) - k)[len(tops) - k])
    if len(at) > k:
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


class Scorer:
    """Integer inner products with the rows of a block: terms that many rows
    hold by a matrix product, the postings of the others scattered."""

    def __init__(self, flat: np.ndarray, offs: np.ndarray):
        flat = flat.astype(np.int64)
        self.n, self.top, self.terms = len(offs) - 1, _top(flat), postings(flat, offs)
        self.heavy = np.array([t for t, (_, w) in enumerate(self.terms) if len(w) * HEAVY >= self.n], np.int64)
        self.light = np.setdiff1d(np.arange(len(self.terms)), self.heavy)
        self.dense = np.zeros((len(self.heavy), self.n), np.int64)
        for i, t in enumerate(self.heavy):
            rows, w = self.terms[t]
            self.dense[i, slice(None) if rows is None else rows] = w
        self.kind = np.dtype(np.int64)

    def scores(self, flat: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
        """For each query its scores, as floats where these are exact."""
        kind = np.dtype(np.float64 if self.top * max(_top(flat), 1) * max(len(self.terms), 1) < EXACT else np.int64)
        if kind != self.kind:
            self.dense, self.kind = self.dense.astype(kind), kind
        for a in range(0, len(offs) - 1, SLICE):
            own = offs[a:a + SLICE + 1]
            row = np.repeat(np.arange(len(own) - 1), np.diff(own))
            term = np.arange(own[0], own[-1]) - own[row]
            asked = np.zeros((len(own) - 1, len(self.terms)), kind)
            asked[row[term < len(self.terms)], term[term < len(self.terms)]] = flat[own[0]:own[-1]][term < len(self.terms)]
            out = asked[:, self.heavy] @ self.dense
            for q, t in np.argwhere(asked[:, self.light]):
                rows, w = self.terms[self.light[t]]
                out[q, rows] += asked[q, self.light[t]] * w
            yield from out


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = scorer = ids = None
        for batch in batches:
            for r in range(batch.num_rows):
                cell = lambda c: batch.column(c)[r].as_py()
                get = lambda c, kind=np.int64: np.frombuffer(cell(c), kind)
                if cell("block") != last:           # a block's rows come one after the other
                    last, ids = cell("block"), get("ids")
                    scorer, in_order = Scorer(get("flat", cell("kind")), get("offs")), np.sort(ids)
                q_ids = get("q_ids")
                own = np.searchsorted(in_order, q_ids, "right") - np.searchsorted(in_order, q_ids)
                out = []
                for q, scores in enumerate(scorer.scores(get("q_flat", cell("q_kind")).astype(np.int64), get("q_offs"))):
                    at = best(scores, ids, k + own[q])
                    at = at[ids[at] != q_ids[q]][:k]
                    out.append((np.full(len(at), q_ids[q]), ids[at], scores[at].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)],
                                                 ["query_id", "vec_id", "score"])
    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k best candidates
    (all, if fewer) by integer inner product, ties to the smaller vec_id; a
    query never meets a row with its own vec_id.

    Both inputs are tables of ``integer_vectors``.  Candidates and queries are
    packed into blocks dealt by a hash of the row; every query block is sent to
    every candidate block, where the weighted postings of a query's terms add
    up in a dense score array and a partition selection keeps k.  The partial
    lists, k a block, are then merged.  The blocks meet in a merge join, never
    by a broadcast: Spark's estimate of the query blocks knows neither their
    width nor their copies, and the driver would hold all of them.  Components
    past the end of a shorter vector count as zero; scores are 64-bit integers,
    which components under 2 ** 27 cannot leave; of rows that share a query id
    with different vectors the smallest vector asks.  Empty tables give no rows."""
    spark = prepare(candidates.sparkSession)
    candidates = stored(candidates.select("vec_id", "v"), "candidates")
    queries = stored(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    held = F.coalesce(F.sum(F.size("v")), F.lit(0)).cast("long")
    (n, cells), (m, q_cells) = (x.agg(F.count("*"), held).first() for x in (candidates, queries))
    if not n or not m:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # enough blocks for the cluster, as far as the queries sent to them stay near twice the candidates
    spread = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, 2 * n // m))
    blocks = max(-(-n // CANDIDATES), -(-cells // CELLS), min(n // 64 + 1, spread))
    q_blocks = max(-(-m // QUERIES), min(m, -(-q_cells // QUERY_CELLS)))
    deal = lambda parts: F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)).alias("block")
    c = candidates.select(deal(blocks), "vec_id", "v").groupBy("block").applyInArrow(_block, BLOCK)
    q = (queries.select(deal(q_blocks), "vec_id", "v").groupBy("block").applyInArrow(_block, BLOCK)
         .select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
                 *[F.col(x).alias(f"q_{x}") for x in ("kind", "ids", "flat", "offs")]))
    # the candidate block, one row a key, is the side that a merge join holds
    found = q.hint("merge").join(c, "block").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")
            .where(F.col("rank") <= k))
