"""Quality by an interpolated modified Kneser-Ney model of byte n-grams."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.llm.common import NULL_ID, byte_texts, discard, grouped, id_key, prepare, release, stored

ORDER = 5
#: Order of the registered query and the pipeline: their tables grow with the input for longer (7 bytes fit a long).
LONG_ORDER = 7
#: Text of a block of documents, and of the part of it that is held as numbers at once.
BLOCK_BYTES, SLICE = 64 << 20, 2 << 20
#: Text whose n-grams a shard gets; the number of shards follows the data, up to a bound.
SHARD_BYTES, MOST_SHARDS = 32 << 20, 4096
#: Packed text that a task holds before it writes its parts of the blocks.
PACK_BYTES = 16 << 20
#: One in so many trusted documents is held out: the model does not see it, and thresholds come from these.
HELD_OUT = 5
#: A language's threshold: this quantile of its held-out documents, times the slack (1: none).
QUANTILE, SLACK = 0.99, 1.0
#: log-perplexities are compared in steps of 1 / STEP, so that quantiles are exact counts.
STEP = 10_000


# --- blocks of documents ---------------------------------------------------

def _pack(rows: list[tuple[int, str, bytes]]) -> bytes:
    langs = [r[1].encode() for r in rows]
    head = struct.pack("<q", len(rows)) + b"".join(np.array(x, np.int64).tobytes() for x in (
        [r[0] for r in rows], [len(x) for x in langs], [len(r[2]) for r in rows]))
    return zstandard.compress(head + b"".join(langs) + b"".join(r[2] for r in rows), 3)


def _unpack(data: bytes) -> list[tuple[int, str, bytes]]:
    data = zstandard.decompress(data)
    n = struct.unpack_from("<q", data)[0]
    ids, langs, sizes = np.frombuffer(data, np.int64, 3 * n, 8).reshape(3, n).tolist()
    at, out = 8 + 24 * n, []
    lang = []
    for k in langs:
        lang.append(data[at:at + k].decode())
        at += k
    for i, name, k in zip(ids, lang, sizes):
        out.append((i, name, data[at:at + k]))
        at += k
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()),
                                           pa.array([_pack(v) for v in held.values()], pa.binary())], ["block", "payload"])
    held, size = {}, 0
    for b in batches:
        for block, did, lang, text in zip(b.column("block").to_pylist(), b.column("did").to_pylist(),
                                          b.column("lang").to_pylist(), byte_texts(b.column("text"))):
            held.setdefault(block, []).append((did, lang, text))
            size += len(text)
            if size > PACK_BYTES:
                yield flush()
                held, size = {}, 0
    yield flush()


def _segments(texts: list[bytes], order: int) -> Iterator[tuple[int, bytes]]:
    """(text, bytes): order - 1 bytes of context (zeros before the start) and
    then the bytes to count, of which a segment holds SLICE at most."""
    for i, t in enumerate(texts):
        for a in range(0, len(t), SLICE):
            yield i, t[max(0, a - order + 1):a].rjust(order - 1, b"\0") + t[a:a + SLICE]


def _grams(segments: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte, packed in a long, and the sizes."""
    data = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    n = len(data) - order + 1
    g = data[:n].astype(np.int64)
    for i in range(1, order):
        g <<= 8
        g |= data[i:n + i]
    ends = np.cumsum(sizes)
    real = np.ones(n, bool)
    for i in range(order - 1):                       # grams that start in one segment and end in the next
        real[(ends[:-1] - order + 1 + i)] = False
    return g[real], sizes - order + 1


def _slices(texts: list[bytes], order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(grams, texts of its segments, their sizes), SLICE bytes or so at a time."""
    segments = list(_segments(texts, order))
    for a, b in grouped([len(s) for _, s in segments], SLICE):
        grams, sizes = _grams([s for _, s in segments[a:b]], order)
        yield grams, np.array([i for i, _ in segments[a:b]]), sizes


def _counted(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of some texts, in order, and their counts."""
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for grams, _, _ in _slices(texts, order):
        grams.sort()
        heads = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
        keys, counts = _merged(np.concatenate((keys, grams[heads])),
                               np.concatenate((counts, np.diff(heads, append=len(grams)))))
    return keys, counts


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[heads], np.add.reduceat(counts[order], heads)


def _either(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct numbers of two arrays, in order."""
    both = np.sort(np.concatenate((a, b)))
    return both[np.flatnonzero(np.diff(both, prepend=-1))]


# --- dealing n-grams ---------------------------------------------------------
#
# The two bytes before the last one decide the shard of an n-gram.  Its ends of
# three bytes and more, the contexts of those (all but their last byte) and
# everything that is counted over them then lie in one shard; only pairs and
# single bytes, 65 792 numbers at most, are shared by all.

def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    pair = ((keys >> 8) & 0xFFFF).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((pair >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def _turned(keys: np.ndarray, order: int) -> np.ndarray:
    """Numbers that sort n-grams by the two bytes before the last, the last one
    and then the others from the end: neighbours share their first bytes."""
    out = (((keys >> 8) & 0xFFFF) << 8) | (keys & 0xFF)
    for i in range(3, order):
        out = (out << 8) | ((keys >> (8 * i)) & 0xFF)
    return out


def _turned_back(codes: np.ndarray, order: int) -> np.ndarray:
    head = codes >> (8 * (order - 3))
    out = ((head >> 8) << 8) | (head & 0xFF)
    for i in range(3, order):
        out |= ((codes >> (8 * (order - 1 - i))) & 0xFF) << (8 * i)
    return out


def _planes(x: np.ndarray) -> bytes:
    """An array as its bytes, all first ones, then all second ones, packed."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 3)


def _from_planes(data: bytes, kind) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(flat.T).reshape(-1).view(kind)


def _put_grams(keys: np.ndarray, order: int) -> bytes:
    """Distinct n-grams, in the order of ``_turned``."""
    return _planes(np.sort(_turned(keys, order)))


def _got_grams(data: bytes, order: int) -> np.ndarray:
    return _turned_back(_from_planes(data, np.int64), order)


# --- counts and requests -----------------------------------------------------

ASKED = "trained boolean, shard long, block long, grams binary, counts binary"


def _pieces(table: pa.Table) -> Iterator[list[tuple[int, str, bytes]]]:
    """The rows of a block, PACK_BYTES or a little more at a time."""
    held, size = [], 0
    for chunk in table.column("payload").chunks:
        for p in chunk:
            rows = _unpack(p.as_py())
            held += rows
            size += sum(len(t) for _, _, t in rows)
            if size > PACK_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _gather(shards: int, order: int):
    """Per block and shard: the counts of the n-grams of its trusted documents,
    and the distinct n-grams of all its documents, whose scores it asks for."""
    def run(pieces: pa.Table, trusted: pa.Table) -> pa.Table:
        out = []
        if pieces.num_rows:
            good = set(trusted.column("did").to_pylist())
            none = np.empty(0, np.int64)
            keys, counts, rest = none, none, none
            for rows in _pieces(pieces):
                k, c = _counted([t for i, _, t in rows if i in good], order)
                keys, counts = _merged(np.concatenate((keys, k)), np.concatenate((counts, c)))
                rest = _either(rest, _counted([t for i, _, t in rows if i not in good], order)[0])
            block = pieces.column("block")[0].as_py()
            for trained, k in ((True, keys), (False, _either(keys, rest))):
                turned = np.argsort(_turned(k, order))
                k = k[turned]
                to = _shard(k, shards)
                of = np.argsort(to, kind="stable")
                cuts = np.flatnonzero(np.diff(to[of], prepend=-1, append=-1))
                for a, b in zip(cuts[:-1], cuts[1:]):
                    own = of[a:b]
                    out.append((trained, int(to[own[0]]), block, _put_grams(k[own], order),
                                _planes(counts[turned][own]) if trained else None))
        kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)],
                        ["trained", "shard", "block", "grams", "counts"])
    return run


# --- the model ---------------------------------------------------------------

def _ends(keys: np.ndarray, counts: np.ndarray, order: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By order from ``order`` down to 3: (n-grams, c), at the top the counts,
    below it in how many distinct n-grams of the next order each is the end."""
    by = {order: (keys, counts)}
    for k in range(order - 1, 2, -1):
        by[k] = np.unique(by[k + 1][0] & ((1 << (8 * k)) - 1), return_counts=True)
    return by


MODEL = "kind string, shard long, k long, c long, n long, grams binary, counts binary"


def _model_rows(shard: int, keys: np.ndarray, counts: np.ndarray, order: int) -> pa.RecordBatch:
    """A shard's counts, and what it adds to the shared numbers: counts of
    counts of its orders, and of how many trigrams each pair is the end."""
    by = _ends(keys, counts, order)
    rows = []
    for k, (_, c) in by.items():
        rows += [("seen", shard, k, i, int((c == i).sum()), None, None) for i in (1, 2, 3, 4)]
    pairs, n = np.unique(by[3][0] & 0xFFFF, return_counts=True)
    rows += [("pair", shard, 2, int(g), int(x), None, None) for g, x in zip(pairs, n)]
    turned = np.argsort(_turned(keys, order))
    rows.append(("counts", shard, None, None, None, _put_grams(keys, order), _planes(counts[turned])))
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                      [c.split()[0] for c in MODEL.split(", ")])


def _sum_counts(order: int):
    """Rows come sorted by shard, any number a shard: what is held is the
    distinct n-grams of one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, counts = None, None, None
        for b in batches:
            for s, g, c in zip(b.column("shard").to_pylist(), b.column("grams").to_pylist(), b.column("counts").to_pylist()):
                if s != shard:
                    if shard is not None:
                        yield _model_rows(shard, keys, counts, order)
                    shard, keys, counts = s, np.empty(0, np.int64), np.empty(0, np.int64)
                keys, counts = _merged(np.concatenate((keys, _got_grams(g, order))),
                                       np.concatenate((counts, _from_planes(c, np.int64))))
        if shard is not None:
            yield _model_rows(shard, keys, counts, order)
    return run


def _three(n: dict[int, int]) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from the counts of counts; 0.5, 1 and
    1.5 where those they need are missing (tiny corpora)."""
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    if not min(n1, n2, n3, n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.01), float(i)) for i, x in enumerate(d, 1))


def discounts(model: DataFrame, pairs: np.ndarray) -> dict[int, tuple[float, float, float]]:
    """The discounts of each order; ``pairs`` as ``pair_counts`` gives them."""
    sums = model.where("kind = 'seen'").groupBy("k", "c").agg(F.sum("n").alias("n")).collect()     # 4 rows an order
    n: dict[int, dict[int, int]] = {}
    for r in sums:
        n.setdefault(r.k, {})[r.c] = r.n
    for k, c in ((2, pairs), (1, (pairs.reshape(256, 256) > 0).sum(axis=0))):
        n[k] = {i: int((c == i).sum()) for i in (1, 2, 3, 4)}
    return {k: _three(v) for k, v in n.items()}


def pair_counts(model: DataFrame) -> np.ndarray:
    """Of how many distinct trigrams each pair of bytes is the end: 65 536
    numbers, whatever the corpus."""
    out = np.zeros(1 << 16, np.int64)
    for r in model.where("kind = 'pair'").groupBy("c").agg(F.sum("n").alias("n")).collect():
        out[r.c] = r.n
    return out


def _off(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(c == 1, d[0], np.where(c == 2, d[1], d[2]))


def pair_scores(pairs: np.ndarray, d: dict[int, tuple[float, float, float]]) -> np.ndarray:
    """Probability of the last byte of each pair after its first one."""
    c2 = pairs.reshape(256, 256)
    c1 = (c2 > 0).sum(axis=0)
    used = lambda c, k: np.where(c > 0, _off(c, d[k]), 0.0)
    total = c1.sum()
    p1 = np.full(256, 1 / 256)
    if total:
        p1 = np.maximum(c1 - used(c1, 1), 0) / total + used(c1, 1).sum() / total * p1
    total, free = c2.sum(axis=1, keepdims=True), used(c2, 2).sum(axis=1, keepdims=True)
    some = np.maximum(total, 1)
    return np.where(total > 0, np.maximum(c2 - used(c2, 2), 0) / some + free / some * p1, p1).reshape(-1)


class ShardModel:
    """Counts, contexts and discounts of one shard, as sorted arrays."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, d: dict, p2: np.ndarray):
        self.order, self.d, self.p2, self.by = order, d, p2, {}
        for k, (grams, c) in _ends(keys, counts, order).items():
            of = grams >> 8                                     # grams are sorted, so contexts are too
            heads = np.flatnonzero(np.diff(of, prepend=-1)) if len(of) else np.empty(0, np.int64)
            add = lambda x, at=heads: np.add.reduceat(x, at) if len(at) else x[:0]
            self.by[k] = (grams, c, of[heads], add(c), add(_off(c, d[k])))

    def scores(self, asked: np.ndarray) -> np.ndarray:
        """Probabilities of n-grams, order by order; each order's are found once
        for the ends that the asked n-grams share."""
        ends, back = {self.order: asked}, {}
        for k in range(self.order - 1, 2, -1):
            ends[k], back[k + 1] = np.unique(ends[k + 1] & ((1 << (8 * k)) - 1), return_inverse=True)
        p = None
        for k in range(3, self.order + 1):
            a = ends[k]
            low = self.p2[a & 0xFFFF] if k == 3 else p[back[k]]
            grams, c, contexts, totals, free = self.by[k]
            if not len(grams):
                p = low
                continue
            i = np.minimum(np.searchsorted(grams, a), len(grams) - 1)
            c = np.where(grams[i] == a, c[i], 0)
            j = np.minimum(np.searchsorted(contexts, a >> 8), len(contexts) - 1)
            known = contexts[j] == a >> 8
            own = np.where(c > 0, np.maximum(c - _off(c, self.d[k]), 0.0), 0.0)
            p = np.where(known, own / totals[j] + free[j] / totals[j] * low, low)
        return p


def _answer(order: int, d: dict, p2: np.ndarray):
    """Rows come sorted by shard, its model before the requests; each request
    is answered as it passes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        shard, model = None, None
        for b in batches:
            out = []
            for s, block, g, c in zip(*(b.column(x).to_pylist() for x in ("shard", "block", "grams", "counts"))):
                if s != shard:
                    shard, model = s, None
                keys = _got_grams(g, order)
                if c is not None:
                    counts, rank = _from_planes(c, np.int64), np.argsort(keys)
                    model = ShardModel(keys[rank], counts[rank], order, d, p2)
                    continue
                model = model or ShardModel(none, none, order, d, p2)
                out.append((block, g, _planes(np.log(model.scores(keys)).astype(np.float32))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.binary()))],
                                             ["block", "grams", "logp"])
    return run


# --- scores of documents -----------------------------------------------------

#: A slice has fewer n-grams than this many bits tell apart.
PLACE_BITS = 21


class Lookup:
    """Values of n-grams that are all known.  Each gets a short number of its
    own, to which the place in the slice is appended: one plain sort then brings
    the same n-grams together and still tells where each one was."""

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        factor = 0x9E3779B97F4A7C15
        while True:
            self.factor = np.uint64(factor)
            short = self._short(grams)
            rank = np.argsort(short)
            self.short, self.values = short[rank], values[rank]
            if not (self.short[1:] == self.short[:-1]).any():
                break
            factor = (factor * 0xD1342543DE82EF95 + 2) % (1 << 64) | 1       # two n-grams met: another factor

    def _short(self, grams: np.ndarray) -> np.ndarray:
        return (grams.astype(np.uint64) * self.factor) >> np.uint64(PLACE_BITS)

    def get(self, grams: np.ndarray) -> np.ndarray:
        out = np.empty(len(grams), self.values.dtype)
        for a in range(0, len(grams), 1 << PLACE_BITS):
            part = grams[a:a + (1 << PLACE_BITS)]
            both = np.sort((self._short(part) << np.uint64(PLACE_BITS)) | np.arange(len(part), dtype=np.uint64))
            at = (both & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
            out[a + at] = self.values[np.searchsorted(self.short, both >> np.uint64(PLACE_BITS))]
        return out


def _perplexities(order: int):
    def run(pieces: pa.Table, replies: pa.Table) -> pa.Table:
        gram = np.concatenate([np.empty(0, np.int64), *(_got_grams(x, order) for x in replies.column("grams").to_pylist())])
        logp = np.concatenate([np.empty(0, np.float32), *(_from_planes(x, np.float32) for x in replies.column("logp").to_pylist())])
        known, out = Lookup(gram, logp.astype(float)), []
        for rows in _pieces(pieces):
            totals = np.zeros(len(rows))
            for grams, of, sizes in _slices([t for _, _, t in rows], order):
                np.add.at(totals, of, np.add.reduceat(known.get(grams), np.cumsum(sizes) - sizes))
            n = np.array([len(t) for _, _, t in rows], np.int64)
            mean = np.divide(-totals, n, out=np.zeros(len(rows)), where=n > 0)
            out.append(pa.table({"did": pa.array([r[0] for r in rows], pa.int64()), "lang": pa.array([r[1] for r in rows], pa.string()),
                                 "text_hash": pa.array(np.array([xxhash.xxh64_intdigest(t, 42) for _, _, t in rows], np.uint64).view(np.int64)),
                                 "n_bytes": pa.array(n), "steps": pa.array(np.rint(mean * STEP).astype(np.int64), mask=n == 0)}))
        names = ("did", "lang", "text_hash", "n_bytes", "steps")
        none = pa.schema(list(zip(names, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))))
        return pa.concat_tables(out) if out else none.empty_table()
    return run


def exact_quantile(rows: DataFrame, key: str, value: str, q: float) -> DataFrame:
    """(key, threshold): the least value that q of a key's rows do not exceed,
    from counts per distinct value (an integer), summed on the map side."""
    seen = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key)
    return (seen.withColumn("up", F.sum("n").over(w.orderBy(value))).withColumn("all", F.sum("n").over(w))
            .where(F.col("up") >= F.col("all") * q).groupBy(key).agg(F.min(value).alias("threshold")))


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(key, F.lit(blocks)).cast("long").alias("block")


def quality(docs: DataFrame, labels: DataFrame, q: float = QUANTILE, slack: float = SLACK,
            order: int = ORDER) -> DataFrame:
    """(doc_id, lang, n_bytes, text_hash, perplexity, threshold, keep) for every
    row; ``text_hash`` is Spark's ``xxhash64`` of the text, so that doc_id,
    text_hash and lang tell the rows apart that are judged apart.

    Trusted are the documents that all their rows of ``labels`` (doc_id,
    quality, toxic) call good and not toxic; the model is trained on them but
    for one in HELD_OUT, on which the thresholds rest.  Blocks of documents send
    the counts of their trusted n-grams and ask for the scores of the distinct
    n-grams of all their documents; both are dealt out by the two bytes before
    an n-gram's last one, where counts are summed and joined, order by order, to
    probabilities, which go back to the blocks.  A document's perplexity is per
    byte; it is kept unless that exceeds its language's ``q`` quantile over
    held-out documents by the factor ``slack``.  ``order`` is the length of the
    n-grams, from 3 to 7.

    Empty or null texts have no perplexity and stay; so do documents of a
    language (null is one, apart from the empty name) without held-out
    documents.  Repeated rows each give a row and train as often; rows without a
    doc_id are scored but never trusted; an empty table gives no rows, empty
    labels keep everything; other columns are ignored."""
    if not 3 <= order <= 7:
        raise ValueError("an order from 3 to 7")
    spark = prepare(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    shards = min(MOST_SHARDS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES)))
    block = block_of(F.xxhash64("did"), blocks)
    lang = F.col("lang").cast("string")
    # a null language is the empty key, others have a sign before them
    pieces = (docs.select(id_key().alias("did"), F.coalesce(F.concat(F.lit("="), lang), F.lit("")).alias("lang"), text.alias("text"))
              .select(block_of(F.when(F.col("did") == NULL_ID, F.xxhash64("text")).otherwise(F.xxhash64("did")), blocks),
                      "did", "lang", "text").mapInArrow(_packed, "block long, payload binary"))
    trusted = (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("did"))
               .agg((F.min(F.coalesce("quality", F.lit(0))) == 1).alias("good"),
                    (F.max(F.coalesce("toxic", F.lit(1))) == 0).alias("clean"))
               .where("good and clean")
               .select("did", (F.pmod(F.xxhash64("did"), F.lit(1 << 40)) % HELD_OUT == 0).alias("held")))
    by_block = pieces.groupBy("block")
    asked = stored(by_block.cogroup(trusted.where("not held").select(block, "did").groupBy("block"))
                   .applyInArrow(_gather(shards, order), ASKED), "ngrams")
    release(spark)
    sums = asked.where("trained").select("shard", "grams", "counts").repartition("shard").sortWithinPartitions("shard")
    model = stored(sums.mapInArrow(_sum_counts(order), MODEL), "model")
    pairs = pair_counts(model)
    d = discounts(model, pairs)
    d = {k: d.get(k, _three({})) for k in range(1, order + 1)}
    none = F.lit(None)
    requests = asked.where("not trained").select("shard", F.lit(1).alias("nth"), "block", "grams", none.cast("binary").alias("counts"))
    counts = model.where("kind = 'counts'").select("shard", F.lit(0).alias("nth"), none.cast("long").alias("block"), "grams", "counts")
    replies = (counts.unionByName(requests).repartition("shard").sortWithinPartitions("shard", "nth")
               .mapInArrow(_answer(order, d, pair_scores(pairs, d)), "block long, grams binary, logp binary"))
    found = stored(by_block.cogroup(replies.groupBy("block"))
                   .applyInArrow(_perplexities(order), "did long, lang string, text_hash long, n_bytes long, steps long"), "perplexities")
    discard(asked, model)
    limits = exact_quantile(found.join(trusted.where("held"), "did", "left_semi"), "lang", "steps", q)
    perplexity = lambda c: F.exp(F.col(c) / float(STEP))
    return (found.join(limits, "lang", "left")
            .select(F.when(F.col("did") != F.lit(NULL_ID), F.col("did")).alias("doc_id"),
                    F.when(F.col("lang") != "", F.substring("lang", 2, 1 << 30)).alias("lang"), "n_bytes", "text_hash",
                    perplexity("steps").alias("perplexity"), (perplexity("threshold") * slack).alias("threshold"))
            .withColumn("keep", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))))
