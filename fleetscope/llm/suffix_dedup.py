"""Removal of repeated byte strings by a collection Burrows-Wheeler transform."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetscope.llm.collection_bwt import columns
from fleetscope.llm.common import byte_texts, id_key, prepare

GRAM = 32
BLOCK = 1 << 17
#: Text of a block of documents, handled in one step of a task.
BLOCK_BYTES = 4 << 20
#: A key with more strings than this is split into single windows.
LONG_KEY = 50_000
#: Place of the key gram in a string that is keyed by all of it.
SINGLE = 255
#: Place in a row of strings that their block holds earlier, which go without their bytes.
COPY = 254
#: Strings of one transform, about.
STRINGS = 1 << 16
#: Text of a bucket, about, and bytes of cells that a task takes at a time.
BUCKET_BYTES, STEP_BYTES = 8 << 20, 24 << 20
_M = [np.uint64(pow(0x9E3779B97F4A7C15, 1 << i, 1 << 64)) for i in range(8)]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hash of the GRAM bytes from each place (GRAM is 2 ** 5)."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(GRAM.bit_length() - 1):
        h = h[:-(1 << i)] * _M[i] + h[1 << i:]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def window_keys(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the string of ``length`` bytes from each place: its key, the least
    hash of the grams in it, and where in it the first such gram starts.  Equal
    strings have equal keys and places."""
    keys, places = [], []
    wide = length - GRAM + 1
    for a in range(0, max(0, len(data) - length + 1), BLOCK):
        low, have = _gram_hashes(data[a:a + BLOCK + length - 1]), 1
        place = np.zeros(len(low), np.uint8)
        while have < wide:
            step = min(have, wide - have)
            later = low[step:] < low[:-step]
            place = np.where(later, place[step:] + np.uint8(step), place[:-step])
            low = np.minimum(low[:-step], low[step:])
            have += step
        keys.append(low)
        places.append(place)
    return (np.concatenate(keys), np.concatenate(places)) if keys else (np.empty(0, np.uint64), np.empty(0, np.uint8))


class Runs:
    """Consecutive windows of a text with one key gram: ``key``, ``text``,
    ``start`` in it, ``windows``, and ``place`` of the gram in the first of
    them.  Every window is in exactly one run."""

    def __init__(self, texts: list[bytes], length: int):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.length, self.bases = length, np.cumsum(sizes) - sizes
        self.data = b"".join(texts)
        keys, places = window_keys(np.frombuffer(self.data, np.uint8), length)
        heads = np.ones(len(keys), bool)
        gram = np.arange(len(keys)) + places
        heads[1:] = gram[1:] != gram[:-1]
        whole = sizes >= length
        heads[self.bases[whole]] = True
        ends = (self.bases + sizes - length + 1)[whole]      # first window that leaves its text
        heads[ends[ends < len(keys)]] = True
        start = np.flatnonzero(heads)
        windows = np.diff(start, append=len(keys))
        text = np.searchsorted(self.bases, start, side="right") - 1  # of texts with one base, the last has the bytes
        inside = start + length <= (self.bases + sizes)[text] if len(start) else np.empty(0, bool)
        self.at, self.windows, self.text = start[inside], windows[inside], text[inside]
        self.key, self.place = keys[self.at], places[self.at].astype(np.int64)
        self.start = self.at - self.bases[self.text]

    def strings(self) -> list[bytes]:
        return [self.data[a:b] for a, b in zip(self.at.tolist(), (self.at + self.windows + self.length - 1).tolist())]

    def copies(self) -> np.ndarray:
        """A mark for each string that one of the texts holds earlier."""
        again = np.zeros(len(self.key), bool)
        _, of, n = np.unique(self.key, return_inverse=True, return_counts=True)
        rows = np.flatnonzero(n[of] > 1)
        rows = rows[np.argsort(self.at[rows])]
        seen: set[bytes] = set()
        for i, a, n in zip(rows.tolist(), self.at[rows].tolist(), self.windows[rows].tolist()):
            string = self.data[a:a + n + self.length - 1]
            again[i] = string in seen
            seen.add(string)
        return again

    def collapse(self) -> np.ndarray:
        """Keep the earliest of equal strings; (text, start, windows) of the others."""
        again = self.copies()
        gone = np.array([self.text[again], self.start[again], self.windows[again]], np.int64)
        self.take(~again)
        return gone

    def take(self, rows: np.ndarray) -> None:
        for name in ("at", "windows", "text", "key", "place", "start"):
            setattr(self, name, getattr(self, name)[rows])

    def single(self, rows: np.ndarray) -> None:
        """Replace the runs ``rows`` by runs of one window, keyed by all of it."""
        n = self.windows[rows]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        of = np.repeat(np.flatnonzero(rows), n)
        key = [int.from_bytes(hashlib.blake2b(self.data[a:a + self.length], digest_size=8).digest(), "little")
               for a in (self.at[of] + nth).tolist()]
        grow = lambda x, more: np.concatenate((x[~rows], more))
        self.key = grow(self.key, np.array(key, np.uint64))
        self.place = grow(self.place, np.full(len(of), SINGLE))
        self.text, self.start = grow(self.text, self.text[of]), grow(self.start, self.start[of] + nth)
        self.at, self.windows = grow(self.at, self.at[of] + nth), grow(self.windows, np.ones(len(of), np.int64))


def _documents(block: pa.Table) -> tuple[pa.Table, list[bytes]]:
    """The distinct documents of a block in order; equal rows count once."""
    docs = block.select(["did", "tk"]).append_column("at", pa.array(np.arange(block.num_rows)))
    docs = docs.group_by(["did", "tk"], use_threads=False).aggregate([("at", "min")]).sort_by(
        [("did", "ascending"), ("tk", "ascending")])
    texts = block.column("text").take(docs.column("at_min"))
    return docs, byte_texts(texts.combine_chunks())


def _first(table: pa.Table, name: str):
    return table.column(name)[0].as_py()


def _bytes(x: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _requests(length: int, buckets: int):
    """Per block and bucket: its distinct keys and in how many distinct strings each is."""
    def run(block: pa.Table) -> pa.Table:
        _, texts = _documents(block)
        runs = Runs(texts, length)
        runs.collapse()
        key, n = np.unique(runs.key, return_counts=True)
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        cells = [(b, _bytes(key[bucket == b], np.uint64), _bytes(np.minimum(n[bucket == b], 2 ** 31), np.uint32))
                 for b in np.unique(bucket).tolist()]
        return pa.table({"block": pa.array([_first(block, "block")] * len(cells), pa.int64()),
                         "bucket": pa.array([c[0] for c in cells], pa.int64()),
                         "keys": pa.array([c[1] for c in cells], pa.binary()),
                         "counts": pa.array([c[2] for c in cells], pa.binary())})
    return run


def _buckets(batches: Iterator[pa.RecordBatch], names: list[str], step: int) -> Iterator[list[tuple]]:
    """The rows of whole buckets, about ``step`` bytes of cells at a time, from
    batches sorted by bucket; the first of ``names`` is the bucket."""
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names)):
            if size > step and row[0] != rows[-1][0]:
                yield rows
                rows, size = [], 0
            rows.append(row)
            size += sum(len(c) for c in row if isinstance(c, bytes))
    if rows:
        yield rows


def _count(long_key: int, step: int = STEP_BYTES):
    """Answer the requests of some buckets: 0 one string in all, 1 several,
    2 more than ``long_key``."""
    def answers(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys = np.frombuffer(b"".join(r[2] for r in rows), np.uint64)
        counts = np.frombuffer(b"".join(r[3] for r in rows), np.uint32)
        order = np.argsort(keys, kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], np.diff(keys[order]) != 0)))
        total = np.repeat(np.add.reduceat(counts[order].astype(np.int64), heads), np.diff(heads, append=len(keys)))
        answer = np.empty(len(keys), np.uint8)
        answer[order] = (total > 1).astype(np.uint8) + (total > long_key)
        at = 0
        for bucket, block, own, _ in rows:
            n = len(own) // 8
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int64()),
                                              pa.array([answer[at:at + n].tobytes()], pa.binary())],
                                             ["block", "bucket", "answer"])
            at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(batches, ["bucket", "block", "keys", "counts"], step):
            yield from answers(rows)
    return run


STRINGS_SCHEMA = ("bucket long, block long, texts binary, sizes binary, place binary, did binary, tk binary, "
                  "doc binary, start binary")
_KINDS = {"sizes": np.uint16, "place": np.uint8, "did": np.int64, "tk": np.int64, "doc": np.int32, "start": np.int64}


def _strings(length: int, buckets: int):
    """Per block and bucket: the distinct strings whose key several have, each
    with its earliest place in the block; and, dealt out by block, the places
    of the others, whose windows all start earlier too."""
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.table({c: pa.array([], pa.int64() if c in ("bucket", "block") else pa.binary())
                             for c in ["bucket", "block", "texts", *_KINDS]})
        docs, texts = _documents(block)
        runs = Runs(texts, length)
        again = [runs.collapse()]
        keys = np.unique(runs.key)
        bucket = (keys % np.uint64(buckets)).astype(np.int64)
        level = np.zeros(len(keys), np.uint8)
        for b, answer in zip(answers.column("bucket").to_pylist(), answers.column("answer").to_pylist()):
            level[bucket == b] = np.frombuffer(answer, np.uint8)
        own = level[np.searchsorted(keys, runs.key)]
        runs.take(own > 0)
        if (own > 1).any():
            runs.single(own[own > 0] > 1)
            again.append(runs.collapse())
        did, tk = (docs.column(c).to_numpy() for c in ("did", "tk"))
        strings = runs.strings()
        cells = {"sizes": runs.windows + length - 1, "place": runs.place, "did": did[runs.text], "tk": tk[runs.text],
                 "doc": runs.text, "start": runs.start}
        to = (runs.key % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((runs.key, to))
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(to[order])) + 1, [len(order)])) if len(order) else [0]
        parts = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        number = _first(block, "block")
        out = [(int(to[p[0]]), number, b"".join([strings[i] for i in p.tolist()]),
                *(_bytes(cells[c][p], k) for c, k in _KINDS.items())) for p in parts]
        text, start, windows = np.concatenate(again, axis=1)
        if len(text):
            own = {"sizes": windows + length - 1, "place": np.full(1, COPY), "doc": text, "start": start}
            out.append((number % buckets, number, b"", *(_bytes(own[c], k) if c in own else b"" for c, k in _KINDS.items())))
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * (len(_KINDS) + 1)]
        return pa.table({c: pa.array([r[i] for r in out], k)
                         for i, (c, k) in enumerate(zip(["bucket", "block", "texts", *_KINDS], kinds))})
    return run


def _later(strings: list[bytes], place: np.ndarray, rank: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """For distinct strings, a mark for each window (row, window) that also
    starts earlier: smaller rank, or same rank and smaller start."""
    wide = length - GRAM + 1
    first = wide - 1 - place
    windows = np.fromiter(map(len, strings), np.int64, len(strings)) - length + 1
    marks = np.zeros((len(strings), wide), bool)
    for column, order, lcp in columns(strings, first, wide - 1 + length):
        nth = column - first[order]
        if column > wide - 1:                               # no window starts there
            continue
        group = np.cumsum(lcp < length)                     # equal strings of ``length`` bytes are neighbours
        real = np.flatnonzero((nth >= 0) & (nth < windows[order]))
        if not len(real):
            continue
        row, of = order[real], group[real]
        when = start[row] + nth[real]
        by = np.lexsort((when, rank[row], of))
        again = np.concatenate(([False], of[by][1:] == of[by][:-1]))
        marks[row[by][again], nth[real][by][again]] = True
    return marks


def _transform(length: int, most: int, step: int = STEP_BYTES):
    """Build the transform of some buckets' strings, a bounded part at a time,
    and send each block the windows of its strings that also start earlier."""
    def answers(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        cells = {c: np.concatenate([np.frombuffer(r[3 + i], k) for r in rows]).astype(np.int64)
                 for i, (c, k) in enumerate(_KINDS.items())}
        block = np.repeat([r[1] for r in rows], [len(r[3]) // 2 for r in rows])
        ends = np.cumsum(cells["sizes"])
        data = b"".join(r[2] for r in rows)
        seen: dict[bytes, int] = {}
        of = np.fromiter((seen.setdefault(data[a:b], len(seen)) for a, b in zip((ends - cells["sizes"]).tolist(), ends.tolist())),
                         np.int64, len(ends))
        by = np.lexsort((cells["start"], cells["tk"], cells["did"]))
        rank = np.empty(len(by), np.int64)
        new = np.concatenate(([0], np.cumsum((np.diff(cells["did"][by]) != 0) | (np.diff(cells["tk"][by]) != 0))))
        rank[by] = new
        _, lead = np.unique(of[by], return_index=True)
        lead = by[lead]                                     # the earliest place of each distinct string
        strings = list(seen)
        marks = np.zeros((len(strings), length - GRAM + 1), bool)
        single = cells["place"][lead] == SINGLE
        place = np.where(single, 0, cells["place"][lead])
        # a sort by what they are keyed by keeps what may match together
        key = [s if one else s[p:p + GRAM] for s, p, one in zip(strings, place.tolist(), single.tolist())]
        for part in _parts(key, most):
            marks[part] = _later([strings[i] for i in part.tolist()], place[part], rank[lead][part],
                                 cells["start"][lead][part], length)
        windows = cells["sizes"] - length + 1
        own = marks[of]
        copy = np.ones(len(of), bool)
        copy[lead] = False
        own[copy] = np.arange(own.shape[1]) < windows[copy][:, None]
        hit = np.flatnonzero(own.any(axis=1))
        hit = hit[np.argsort(block[hit], kind="stable")]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(block[hit])) + 1, [len(hit)])) if len(hit) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            at = hit[a:b]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(block[at[0]])], pa.int64()), pa.array([_bytes(cells["doc"][at], np.int32)], pa.binary()),
                 pa.array([_bytes(cells["start"][at], np.int64)], pa.binary()),
                 pa.array([np.packbits(own[at], axis=1).tobytes()], pa.binary())], ["block", "doc", "start", "marks"])

    def copies(row: tuple) -> pa.RecordBatch:
        own = dict(zip(_KINDS, row[3:]))
        windows = np.frombuffer(own["sizes"], _KINDS["sizes"]).astype(np.int64) - length + 1
        marks = np.packbits(np.arange(length - GRAM + 1) < windows[:, None], axis=1).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([row[1]], pa.int64()), *(pa.array([x], pa.binary()) for x in (
            own["doc"], own["start"], marks))], ["block", "doc", "start", "marks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(batches, ["bucket", "block", "texts", *_KINDS], step):
            yield from (copies(r) for r in rows if not r[2])
            rows = [r for r in rows if r[2]]
            if rows:
                yield from answers(rows)
    return run


def _parts(key: list[bytes], most: int) -> Iterator[np.ndarray]:
    """Cut the strings into parts of about ``most``; those of a key stay together."""
    if len(key) <= most:
        yield np.arange(len(key))
        return
    order = sorted(range(len(key)), key=key.__getitem__)
    a = 0
    while a < len(order):
        b = min(a + most, len(order))
        while b < len(order) and key[order[b]] == key[order[b - 1]]:
            b += 1
        yield np.array(order[a:b])
        a = b


def _finish(length: int, with_text: bool):
    """Per row of a block: what is removed and what is left."""
    def run(block: pa.Table, hits: pa.Table) -> pa.Table:
        docs, texts = _documents(block)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        bases = np.cumsum(sizes) - sizes
        change = np.zeros(int(sizes.sum()) + 1, np.int32)
        touched = np.zeros(len(texts), bool)
        for doc, start, marks in zip(*(hits.column(c).to_pylist() for c in ("doc", "start", "marks"))):
            doc, start = np.frombuffer(doc, np.int32), np.frombuffer(start, np.int64)
            row, window = np.nonzero(np.unpackbits(np.frombuffer(marks, np.uint8).reshape(len(doc), -1), axis=1))
            at = bases[doc[row]] + start[row] + window
            np.add.at(change, at, 1)
            np.add.at(change, at + length, -1)
            touched[doc] = True
        gone = np.cumsum(change[:-1]) > 0
        found = []
        for text, base, hit in zip(texts, bases.tolist(), touched.tolist()):
            n_removed = n_spans = 0
            if hit:
                cut = gone[base:base + len(text)]
                n_removed, n_spans = int(cut.sum()), int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum())
                text = np.frombuffer(text, np.uint8)[~cut].tobytes()
            found.append((n_removed, n_spans, hashlib.sha256(text).hexdigest(),
                          text.decode("utf-8", "ignore") if with_text else None))
        number = {k: i for i, k in enumerate(zip(docs.column("did").to_pylist(), docs.column("tk").to_pylist()))}
        rows = [number[k] for k in zip(block.column("did").to_pylist(), block.column("tk").to_pylist())]
        out = {"row": block.column("row"), "n_bytes": pa.array(sizes[rows], pa.int64())}
        for i, (name, kind) in enumerate((("n_removed", pa.int64()), ("n_spans", pa.int64()),
                                          ("kept_sha256", pa.string()), ("text", pa.string()))):
            out[name] = pa.array([found[r][i] for r in rows], kind)
        return pa.table(out)
    return run


def remove_repeats(docs: DataFrame, length: int = 100, with_text: bool = True, long_key: int = LONG_KEY,
                   strings_at_once: int = STRINGS) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept_sha256, text) for every row of
    ``docs``; ``row`` holds its columns but ``text``, ``kept_sha256`` is of the
    remaining bytes, and ``text`` (null unless ``with_text``) is what they
    spell, without characters that lost a byte.

    Each byte covered by a string of ``length`` bytes that also starts earlier
    goes (smaller doc_id, then same document and earlier start); overlaps
    count, all judged on the input.  Matches never cross documents.

    1. Blocks of documents find runs of windows with one key, the least gram
       hash of the window, and ask whether other strings have that key; a block
       asks once a key, so copies and common passages are reduced before the
       shuffle.
    2. Strings of shared keys are dealt out by key, each distinct one once a
       block with its earliest place there; the others of the block start
       later, so only their places are sent, spread by block.  A key that more
       than ``long_key`` strings share is split into its single windows, of
       which a block again sends each distinct one once.
    3. Each task builds the column-wise transform of its strings, about
       ``strings_at_once`` of them, aligned by their key grams: equal windows have equal keys and places, so they stand
       in one column, where a common prefix of ``length`` marks them.
    4. The marks return to the blocks, which cut the bytes.

    Null texts are empty; texts shorter than ``length`` stay whole.  Rows equal
    in doc_id and text are one document and give equal rows; rows that share
    only the doc_id are ordered by a hash of the text; a null doc_id comes
    first.  An empty table gives none; further columns may have any name."""
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} at least")
    spark = prepare(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    texts = (docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"),
                         id_key().alias("did"), F.xxhash64(text).alias("tk"), text.alias("text"))
             .withColumn("block", F.pmod(F.xxhash64("did", "tk"), F.lit(blocks)).cast("long")))
    by_block = texts.groupBy("block")
    answers = (by_block.applyInArrow(_requests(length, buckets), "block long, bucket long, keys binary, counts binary")
               .repartition("bucket").sortWithinPartitions("bucket")
               .mapInArrow(_count(long_key, STEP_BYTES), "block long, bucket long, answer binary"))
    strings = by_block.cogroup(answers.groupBy("block")).applyInArrow(_strings(length, buckets), STRINGS_SCHEMA)
    marks = strings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _transform(length, strings_at_once, STEP_BYTES), "block long, doc binary, start binary, marks binary")
    schema = T.StructType([texts.schema["row"], *T._parse_datatype_string(
        "n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string").fields])
    return by_block.cogroup(marks.groupBy("block")).applyInArrow(_finish(length, with_text), schema)
