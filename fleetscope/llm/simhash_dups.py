"""Near duplicates by SimHash over an inverted index of fingerprint bytes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import row_key, byte_texts, prepare, stored
from fleetscope.llm.components import connected_components

HASH_SEED = 42
#: A posting list longer than this is replaced by finer ones (see ``_finer``).
LONG_LIST = 2048
BYTES = 8


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash: a bit is 1 if more than half the shingle hashes set it."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    stops = ends[min(shingle, len(words)) - 1:].tolist()
    ones, n, h = np.zeros(64, np.int64), len(stops), xxhash.xxh64_intdigest
    for a in range(0, n, 1 << 15):
        block = np.array([h(joined[i:j], HASH_SEED) for i, j in zip(starts[a:a + (1 << 15)], stops[a:a + (1 << 15)])],
                         np.uint64)
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long); one row per row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in byte_texts(b.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _byte_mask(positions: tuple[int, ...]) -> int:
    return sum(0xFF << (8 * p) for p in positions)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _coarse(max_bits: int) -> list[tuple[int, ...]]:
    """Byte positions to index together.  Two fingerprints within ``max_bits``
    share at least 8 - max_bits positional bytes, so at least half of those,
    rounded up, lie in one half of the fingerprint."""
    share = (BYTES - max_bits + 1) // 2
    return [c for half in (range(4), range(4, 8)) for c in combinations(half, share)]


def _finer(positions: tuple[int, ...], max_bits: int) -> list[int]:
    """Masks that split the list of ``positions`` without losing a pair: the
    rest of the guaranteed 8 - max_bits bytes, then half the nibbles of the
    bytes left (each differing bit spoils one nibble).  A list of distinct
    fingerprints under such a mask holds at most 2 ** (4 * max_bits) of them
    however skewed the data are."""
    rest = [p for p in range(BYTES) if p not in positions]
    masks = set()
    for more in combinations(rest, BYTES - max_bits - len(positions)):
        base = _byte_mask(positions) | _byte_mask(more)
        nibbles = [n for p in rest if p not in more for n in (2 * p, 2 * p + 1)]
        masks |= {base | sum(0xF << (4 * n) for n in c) for c in combinations(nibbles, max(0, len(nibbles) - max_bits))}
    return sorted(masks)


def _list_links(max_bits: int):
    """Within each posting list: tally the positional bytes a pair shares,
    keep pairs that reach 8 - max_bits, verify the bit distance; a spanning
    star of each verified group is returned, so output is linear."""
    need = BYTES - max_bits

    def links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right, d = [], [], 1
        at = np.arange(len(key) - 1)
        while len(at):
            at = at[at + d < len(key)]
            at = at[key[at] == key[at + d]]
            x = fp[at] ^ fp[at + d]
            shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            near = shared >= need
            near[near] = np.bitwise_count(x[near]) <= max_bits
            left.append(at[near])
            right.append(at[near] + d)
            d += 1
        if not left:
            return fp[:0], fp[:0]
        a, b = np.concatenate(left), np.concatenate(right)
        lab = np.arange(len(fp))
        while True:
            low = np.minimum(lab[a], lab[b])
            new = lab.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == lab).all():
                break
            lab = new
        moved = np.flatnonzero(lab != np.arange(len(lab)))
        return fp[moved], fp[lab[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_k, keep_f = np.empty(0, np.int64), np.empty(0, np.uint64)
        for b in batches:
            keep_k = np.concatenate((keep_k, b.column("key").to_numpy()))
            keep_f = np.concatenate((keep_f, b.column("fp").to_numpy().view(np.uint64)))
            if not len(keep_k):
                continue
            cut = int(np.searchsorted(keep_k, keep_k[-1]))  # the last list may go on
            a, c = links(keep_k[:cut], keep_f[:cut])
            keep_k, keep_f = keep_k[cut:], keep_f[cut:]
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64))], ["a", "b"])
        a, c = links(keep_k, keep_f)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64))], ["a", "b"])
    return run


def near_links(fps: DataFrame, max_bits: int = 3, long_list: int = LONG_LIST) -> DataFrame:
    """``fps`` (fp, distinct) -> links (a, b) whose components are those of the
    graph that joins every two fingerprints within ``max_bits`` bits."""
    if not 0 <= max_bits <= 4:
        raise ValueError("max_bits must be 0 to 4")
    coarse = _coarse(max_bits)
    masks = F.array(*[F.struct(F.lit(i).alias("list"), F.lit(_signed(_byte_mask(p))).alias("mask"))
                      for i, p in enumerate(coarse)])
    postings = (fps.select("fp", F.explode(masks).alias("m"))
                .select("fp", F.col("m.list").alias("list"),
                        F.xxhash64("m.list", F.col("fp").bitwiseAND(F.col("m.mask"))).alias("key")))
    long_lists = postings.groupBy("key").count().where(F.col("count") > long_list).select("key")
    short = postings.join(long_lists, "key", "left_anti").select("key", "fp")
    finer = F.array(*[F.array(*[F.lit(_signed(m)) for m in _finer(p, max_bits)]) for p in coarse])
    split = (postings.join(long_lists, "key", "left_semi")
             .select("fp", F.explode(finer[F.col("list")]).alias("mask")).distinct()
             .select(F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp"))
    return (short.union(split).repartition("key").sortWithinPartitions("key")
            .mapInArrow(_list_links(max_bits), "a long, b long").distinct())


def simhash_components(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Equal fingerprints are one node, so a group of copies of any size costs one
    posting.  Nodes are indexed by positional bytes; pairs that share enough of
    them are verified by bit distance.  Texts that are null or hold no word
    have fingerprint zero and link like any other.  Rows that repeat a doc_id
    each give a row; a null doc_id never names a component (``component_id`` is
    null if nothing else is reachable).  An empty table gives no rows; other
    columns are ignored."""
    prepare(docs.sparkSession)
    fp = stored(fingerprints(docs, shingle), "fingerprints")
    nodes = fp.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = connected_components(near_links(nodes.select("fp"), max_bits))
    placed = (nodes.join(roots, nodes.fp == roots.node, "left")
              .select("fp", "low", F.coalesce("root", "fp").alias("root")))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = placed.join(lowest, "root").select("fp", "component_id")
    return fp.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                       "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, judge_unnamed: bool = False) -> DataFrame:
    """One document of each group stays: the one of the smallest doc_id (of
    several texts under it, of the smallest hash).  Rows without a doc_id stay;
    with ``judge_unnamed`` they are judged and stand behind all others.  A document is its doc_id and text: two texts under one
    doc_id are judged apart, and rows that repeat the kept one stay too.  Other
    columns are not looked at."""
    key = row_key(F.col("doc_id"), F.col("text")).alias("doc_id")
    rows = docs.select(key, F.col("text"), F.col("doc_id").cast("long").alias("own"))
    found = simhash_components(rows.select("doc_id", "text"), shingle, max_bits).select("doc_id", "component_id").distinct()
    ids = rows.select("doc_id", "own").distinct()
    first = F.min(F.struct(F.col("own").isNull(), "own", "doc_id")).alias("m")
    kept = found.join(ids, "doc_id").groupBy("component_id").agg(first).select(F.col("m.doc_id").alias("_key"))
    if not judge_unnamed:
        kept = kept.union(ids.where("own is null").select("doc_id"))
    return (docs.withColumn("_key", row_key(F.col("doc_id"), F.col("text"))).join(kept, "_key", "left_semi")
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
