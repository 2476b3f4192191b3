"""Benchmark items in documents: SimHash of item-sized windows, then a check."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import byte_texts, grouped, prepare, stored
from fleetscope.llm.words import SLICE, Words, parts, shingles

SHINGLE, SIMILARITY = 5, 0.8
#: Bit radius.  At weighted-shingle similarity 0.8 the cosine is 0.89 or so and
#: 10 of 64 bits differ on average, with a deviation of 3.
RADIUS, BLOCKS = 18, 6
#: Items, and bytes of their texts, that one pass holds in each worker; more take more passes.
ITEMS, ITEM_BYTES = 20_000, 16 << 20


def simhash(rows: np.ndarray) -> np.ndarray:
    """Fingerprint of each row of shingle hashes (repeats weigh)."""
    n, m = rows.shape
    out = np.empty(n, np.uint64)
    step = max(1, (4 << 20) // (64 * m))
    for a in range(0, n, step):
        part = np.ascontiguousarray(rows[a:a + step])
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), m, 8), axis=2, bitorder="little")
        ones = bits.sum(axis=1, dtype=np.int32)
        out[a:a + step] = np.packbits(2 * ones > m, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    both = sum(min(n, b[x]) for x, n in a.items())
    return both / (sum(a.values()) + sum(b.values()) - both)


class HammingBlocks:
    """Multi-index over fingerprints.  Of BLOCKS bit blocks at least one differs
    in RADIUS // BLOCKS bits at most if all differ in RADIUS; each block lists
    the fingerprints under every value within that distance."""

    def __init__(self, prints: np.ndarray):
        self.prints, self.blocks = prints, []
        edges = np.linspace(0, 64, BLOCKS + 1).astype(int)
        for low, high in zip(edges[:-1], edges[1:]):
            bits = int(high - low)
            flips = np.array([sum(1 << b for b in c) for r in range(RADIUS // BLOCKS + 1)
                              for c in combinations(range(bits), r)], np.uint64)
            value = (prints >> np.uint64(low)) & np.uint64((1 << bits) - 1)
            near = (value[:, None] ^ flips).ravel().astype(np.int64)
            owner = np.repeat(np.arange(len(prints)), len(flips))
            order = np.argsort(near, kind="stable")
            offsets = np.searchsorted(near[order], np.arange((1 << bits) + 1))
            self.blocks.append((np.uint64(low), np.uint64((1 << bits) - 1), offsets, owner[order].astype(np.int32)))

    def within(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, fingerprint, bits) of all pairs within RADIUS bits."""
        pairs = []
        for low, mask, offsets, owner in self.blocks:
            value = ((query >> low) & mask).astype(np.int64)
            count = offsets[value + 1] - offsets[value]
            q = np.repeat(np.arange(len(query)), count)
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            item = owner[np.repeat(offsets[value], count) + nth]
            near = np.bitwise_count(query[q] ^ self.prints[item]) <= RADIUS
            pairs.append(q[near] * len(self.prints) + item[near])
        q, item = np.divmod(np.unique(np.concatenate(pairs)), len(self.prints))
        return q, item, np.bitwise_count(query[q] ^ self.prints[item])


class Items:
    """The benchmark items by length in words, with their index."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.classes: dict[int, tuple[list[int], list[Counter], HammingBlocks]] = {}
        by: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, text in rows:
            h = Words([text]).hash
            if len(h):
                by.setdefault(len(h), []).append((item, shingles(h, min(SHINGLE, len(h)))))
        known: dict[int, set[tuple[int, int]]] = {}
        for length, own in by.items():
            prints = simhash(np.stack([s for _, s in own]))
            self.classes[length] = ([i for i, _ in own], [Counter(s.tolist()) for _, s in own], HammingBlocks(prints))
            for _, s in own:
                for x in s.tolist():
                    known.setdefault(min(SHINGLE, length), set()).add((x, length))
        #: by shingle length: sorted shingles of items, each with the item lengths that have it
        self.known = {k: (np.array([x for x, _ in sorted(v)], np.uint64), np.array([n for _, n in sorted(v)]))
                      for k, v in known.items()}
        self.sieve = {k: np.bincount((x & np.uint64(0xFFFFF)).astype(np.int64), minlength=1 << 20) > 0
                      for k, (x, _) in self.known.items()}
        self.longest = max(by, default=0)

    def matches(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int, float]]:
        """(text, item, first word, words, bits, similarity) of every window
        that an item matches."""
        words = Words(texts)
        if not len(words):
            return
        ends = np.searchsorted(words.text, np.arange(len(texts)), side="right")
        begins = np.concatenate(([0], ends[:-1]))
        for k, (known, lengths) in self.known.items():
            all_shingles = words.shingles(k)
            at = np.flatnonzero(self.sieve[k][(all_shingles & np.uint64(0xFFFFF)).astype(np.int64)])
            at = at[words.text[at] == words.text[at + k - 1]]
            low = np.searchsorted(known, all_shingles[at], side="left")
            count = np.searchsorted(known, all_shingles[at], side="right") - low
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            length = lengths[np.repeat(low, count) + nth]
            at = np.repeat(at, count)
            for n in np.unique(length).tolist():
                yield from self._windows(words, all_shingles, at[length == n], n, k, begins, ends)

    def _windows(self, words, all_shingles, at, n, k, begins, ends):
        """Fingerprint every window of n words that holds one of the shingles
        ``at`` (one without any has similarity zero), in a text of fewer words
        the whole text, and look the fingerprints up."""
        text = words.text[at]
        begin, size = begins[text], np.minimum(n, ends[text] - begins[text])
        change = np.zeros(len(words) + 1, np.int32)
        np.add.at(change, np.maximum(begin, at - n + k), 1)
        np.add.at(change, np.minimum(at, begin + np.maximum(ends[text] - begin - n, 0)) + 1, -1)
        start = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        size = np.minimum(n, ends[words.text[start]] - begins[words.text[start]])
        items, bags, index = self.classes[n]
        for m in np.unique(size).tolist():
            own = start[size == m]
            rows = all_shingles[own[:, None] + np.arange(m - k + 1)]
            for q, i, bits in zip(*(x.tolist() for x in index.within(simhash(rows)))):
                s = similarity(Counter(rows[q].tolist()), bags[i])
                if s >= SIMILARITY:
                    t = int(words.text[own[q]])
                    yield t, items[i], int(own[q] - begins[t]), m, bits, s


FOUND = "doc_id long, item_id long, start_word long, n_words int, bit_distance int, similarity double"


def _find(rows: list[tuple[int, bytes]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(rows)
        if not items.longest:
            return
        for b in batches:
            ids, best = b.column("doc_id").to_pylist(), {}
            pieces = [(i, part, first) for i, t in enumerate(byte_texts(b.column("text")))
                      for part, first in ([(t, 0)] if len(t) <= SLICE else parts(t, items.longest))]
            for lo, hi in grouped([len(p) for _, p, _ in pieces], SLICE):
                for t, item, start, n, bits, s in items.matches([p for _, p, _ in pieces[lo:hi]]):
                    row, _, first = pieces[lo + t]
                    found = (-s, first + start, n, bits)
                    best[row, item] = min(best.get((row, item), found), found)
            cells = [(ids[row], item, start, n, bits, -s) for (row, item), (s, start, n, bits) in sorted(best.items())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c[i] for c in cells], k) for i, k in enumerate(
                    (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()))],
                ["doc_id", "item_id", "start_word", "n_words", "bit_distance", "similarity"])
    return run


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, bit_distance, similarity): for
    every document and item the best window (the first, if several tie) of the
    item's length in words whose weighted similarity over five-word shingles
    is 0.8 or more.

    Documents are read once per ITEMS items (or ITEM_BYTES of their texts);
    the driver and each worker hold the items of one such pass only, whose
    results are stored before the next one.  Windows are fingerprinted where
    they share a shingle with an item of their length: any other window has
    similarity zero.  The
    multi-index returns all fingerprints within RADIUS bits, and each is then
    verified exactly.  Texts and items that are null or hold no word match
    nothing; an item of fewer than five words is one shingle; a text shorter
    than the item is one window.  Repeated rows each give rows, repeated items
    (same id and text) count once; empty tables give none; other columns are
    ignored."""
    spark = prepare(docs.sparkSession)
    items = (benchmark.where("text is not null and item_id is not null")
             .select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct())
    n, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    passes = max(1, -(-n // ITEMS), -(-(size or 0) // ITEM_BYTES))
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"),
                                                  F.col("text").cast("string").alias("text"))
    found = None
    for i in range(passes):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i)  # about its share
        rows = [(r.item_id, r.text.encode()) for r in own.orderBy("item_id", "text").collect()]
        part = texts.mapInArrow(_find(rows), FOUND)
        if passes > 1:
            part = stored(part, "found")                # lets go of the items before the next pass
        found = part if found is None else found.union(part)
    return found
