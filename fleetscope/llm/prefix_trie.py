"""The trie of conversation prefixes from a sorted order.

Conversations are sorted by their turns; the members of a prefix are then
neighbours.  The longest common prefixes (LCPs) of neighbours go into a sparse
table of range minima, and every prefix finds its first and its last member by
two independent binary searches in it: no stack, no pointer, no pass that
depends on another prefix's result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.llm.common import prepare, stored

#: Bytes of a turn's digest inside a conversation's key.
DIGEST = 16
#: Turns of one block of the sorted order; the number of blocks follows the data.
BLOCK_TURNS = 1 << 18
WORD = r"[^\x20\x09-\x0D]+"

NODE = ("conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string")
#: Parts of a node that several blocks hold; ``path`` is the digest of its turns.
PART = "path binary, n long, low long, children long, leaves long, tokens long, fresh long, base long, depth int"
BLOCK = (f"kind string, block long, side string, parent_depth int, piece binary, "
         f"{NODE}, {PART.rsplit(',', 1)[0]}")


# ---- the sparse table -------------------------------------------------------

class SparseTable:
    """Minimum of any range of an array in two look-ups."""

    def __init__(self, values: np.ndarray):
        self.levels, step = [np.asarray(values)], 1
        while 2 * step <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:len(last) - step], last[step:]))
            step *= 2

    def minimum(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minima of [a, b), none of them empty."""
        k = np.frexp(b - a)[1] - 1
        out = np.empty(len(a), self.levels[0].dtype)
        for level in np.unique(k):
            own = k == level
            table = self.levels[level]
            out[own] = np.minimum(table[a[own]], table[b[own] - (1 << int(level))])
        return out


def extents(lcp: np.ndarray, row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row (inclusive) that share ``depth`` turns with ``row``.
    ``lcp[i]`` is the common prefix of rows i - 1 and i; ``lcp[0]`` is unused.
    Each end is searched on its own, over widths of falling powers of two."""
    table = SparseTable(lcp)
    left, right = row.copy(), row.copy()
    for level in range(len(table.levels) - 1, -1, -1):
        width = 1 << level
        values = table.levels[level]
        go = left - width >= 0                      # rows left-width .. left share it
        go[go] = values[left[go] - width + 1] >= depth[go]
        left[go] -= width
        go = right + width < len(lcp)
        go[go] = values[right[go] + 1] >= depth[go]
        right[go] += width
    return left, right


# ---- conversations as keys --------------------------------------------------

def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text, words): turns in the order of turn, null
    first, ties by role and text; null role or text is empty.  Rows without a
    conv_id belong to no conversation and are left out."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", empty("role").alias("role"), empty("text").alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.select("conv_id", F.row_number().over(order).alias("pos"), "role", "text",
                       F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))


def turn_digest() -> Column:
    framed = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return F.md5(framed.cast("binary"))


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, seq array<struct<pos, digest, words>>) in order."""
    item = F.struct("pos", turn_digest().alias("digest"), "words")
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("seq"))


def rebuilt(sequences: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """Each conversation c with its first h turns replaced by the first h turns
    of c - c % family, h = crc32(decimal c) % heads: conversations of a family
    come to share openings.  A missing or shorter donor gives what it has."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    donors = sequences.select(F.col("conv_id").alias("donor"), F.slice("seq", 1, max(1, heads - 1)).alias("head"))
    donors = donors.where(F.col("donor") % family == 0)
    c = sequences.withColumn("donor", F.col("conv_id") - F.col("conv_id") % family).withColumn("h", h)
    none = F.slice("seq", 1, 0)
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", none), F.lit(1), F.greatest(F.col("h"), F.lit(1)))).otherwise(none)
    tail = F.slice("seq", F.col("h") + 1, F.size("seq"))
    return c.join(donors, "donor", "left").select("conv_id", F.concat(head, tail).alias("seq"))


def keys(sequences: DataFrame) -> DataFrame:
    """(conv_id, key binary, words array<long>): digests of the turns end to
    end, so byte order of keys is an order of sequences, prefixes first."""
    hexes = F.array_join(F.transform("seq", lambda t: t.digest), "")
    return sequences.select("conv_id", F.unhex(hexes).alias("key"), F.transform("seq", lambda t: t.words).alias("words"))


# ---- one block of the order -------------------------------------------------

def common(a: bytes, b: bytes) -> int:
    """Turns that two keys share at their start."""
    n = min(len(a), len(b)) // DIGEST
    if a[:n * DIGEST] == b[:n * DIGEST]:
        return n
    x, y = (np.frombuffer(k, np.uint8, n * DIGEST) for k in (a, b))
    return int(np.argmax(x != y)) // DIGEST


def path(key: bytes, depth: int) -> bytes:
    return depth.to_bytes(4, "big") + hashlib.md5(key[:depth * DIGEST]).digest()


class Block:
    """Sorted rows of one block with the LCPs to the rows around it."""

    def __init__(self, ids: np.ndarray, keys: list[bytes], words: pa.Array, before: bytes | None, after: bytes | None):
        self.keys, self.ids = keys, ids
        self.size = np.fromiter((len(k) // DIGEST for k in keys), np.int64, len(keys))
        self.lcp = np.array([-1 if before is None else common(before, keys[0]),
                             *[common(a, b) for a, b in zip(keys[:-1], keys[1:])]], np.int64)
        self.next = -1 if after is None else common(keys[-1], after)
        self.at = np.concatenate(([0], np.cumsum(self.size)))          # of a row's turns
        self.sum = np.concatenate(([0], np.cumsum(words.flatten().to_numpy(zero_copy_only=False).astype(np.int64))))
        leaf = np.append(self.lcp[1:], self.next) < self.size          # no longer row goes on
        total = lambda x: np.concatenate(([0], np.cumsum(x)))
        self.leaves, self.tokens = total(leaf), self.sum[self.at]
        start = np.minimum(np.maximum(self.lcp, 0), self.size)
        self.fresh = total(self.sum[self.at[1:]] - self.sum[self.at[:-1] + start])     # words of turns new at this row
        forks = np.flatnonzero((self.lcp >= 0) & (self.size > self.lcp))
        self.forks = np.sort(self.lcp[forks] * (len(keys) + 1) + forks)
        self.lowest = SparseTable(ids)

    def parts(self, row: np.ndarray, depth: np.ndarray) -> dict[str, np.ndarray]:
        """What this block holds of the prefixes (row, depth).  ``tokens`` are
        the words of all members, ``fresh`` those of the nodes that later rows
        than the first add, ``base`` the words above the node."""
        left, right = extents(self.lcp, row, depth)
        n, wide = right - left + 1, len(self.keys) + 1
        cut = lambda i: np.searchsorted(self.forks, depth * wide + i)
        base = self.sum[self.at[left] + np.maximum(depth - 1, 0)] - self.sum[self.at[left]]
        return {"left": left, "right": right, "n": n, "low": self.lowest.minimum(left, right + 1),
                "children": cut(right + 1) - cut(left + 1), "leaves": self.leaves[right + 1] - self.leaves[left],
                "tokens": self.tokens[right + 1] - self.tokens[left], "fresh": self.fresh[right + 1] - self.fresh[left + 1],
                "own": self.sum[self.at[left + 1]] - self.sum[self.at[left]], "base": base,
                "first_fresh": self.fresh[left + 1] - self.fresh[left], "longer": self.size[left] > depth}

    def ends(self, left: np.ndarray, right: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """End of the run of members that have exactly ``depth`` turns."""
        # rows left .. stop - 1 are equal: stop is the next change after left
        changes = np.flatnonzero((self.size[1:] != self.size[:-1]) | (self.lcp[1:] != self.size[1:])) + 1
        stop = np.append(changes, len(self.keys))[np.searchsorted(changes, left, side="right")]
        return np.where(self.size[left] == depth, np.minimum(stop, right + 1), left)


def _ids_text(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


def _nodes(t: pa.Table, around: pa.Table) -> pa.Table:
    """Nodes of a block: whole ones, and the parts of those that cross its
    borders.  Only prefixes of its first and of its last row can cross."""
    t = t.sort_by([("key", "ascending"), ("conv_id", "ascending")])
    before, after = (around.column(c)[0].as_py() for c in ("before", "after"))
    ids = t.column("conv_id").to_numpy()
    b = Block(ids, t.column("key").to_pylist(), t.column("words").combine_chunks(), before, after)
    n = len(b.keys)
    # a row is the first of its node for the depths over its LCP; the prefixes
    # that it shares with the block before belong to an earlier row
    new = np.maximum(b.size - b.lcp, 0)
    row = np.repeat(np.arange(n), new)
    depth = np.arange(len(row)) - np.repeat(np.cumsum(new) - new, new) + b.lcp[row] + 1
    p = b.parts(row, depth)
    assert (p["left"] == row).all()
    is_open = (p["right"] == n - 1) & (depth <= b.next)
    stop = b.ends(row, p["right"], depth)
    # the row above: the same row one turn up, or the node that holds the LCP
    up = np.maximum(depth - 1, 0)
    u = b.parts(row, up)
    above_open = (depth > 0) & (((u["left"] == 0) & (up <= b.lcp[0])) | ((u["right"] == n - 1) & (up <= b.next)))
    side = np.where((u["left"] == 0) & (up <= b.lcp[0]), "head", "tail")

    saved = p["tokens"] - p["n"] * p["base"] - (p["own"] - p["base"]) - p["fresh"]
    whole = np.flatnonzero(~is_open)
    sha = [hashlib.sha256(_ids_text(ids[row[i]:stop[i]])).hexdigest() for i in whole]
    none = np.zeros(len(whole), bool)
    block = t.column("block")[0].as_py()
    out = [pa.table({
        "kind": pa.array(["node"] * len(whole), pa.string()), "block": pa.array(np.full(len(whole), block), pa.int64()),
        "side": pa.array(side[whole].tolist(), pa.string(), mask=~above_open[whole]),
        "parent_depth": pa.array(up[whole].astype(np.int32)), "piece": pa.nulls(len(whole), pa.binary()),
        "conv_id": pa.array(p["low"][whole]), "depth": pa.array(depth[whole].astype(np.int32)),
        "parent_conv_id": pa.array(u["low"][whole], mask=above_open[whole] | (depth[whole] == 0)),
        "n_convs": pa.array(p["n"][whole]), "n_children": pa.array((p["children"] + p["longer"])[whole]),
        "n_leaves": pa.array(p["leaves"][whole]), "saved_tokens": pa.array(saved[whole]), "ends_sha256": pa.array(sha, pa.string()),
        **{c: pa.nulls(len(whole), k) for c, k in PART_TYPES.items()}})]

    # parts: nodes that start here and go on, and nodes that came from before
    went = np.flatnonzero(is_open)
    came = np.arange(0, b.lcp[0] + 1)
    rows = np.concatenate((row[went], np.zeros(len(came), np.int64)))
    deep = np.concatenate((depth[went], came))
    starts = np.arange(len(rows)) < len(went)
    q = b.parts(rows, deep)
    stops = b.ends(q["left"], q["right"], deep)
    paths = [path(b.keys[r], int(d)) for r, d in zip(rows.tolist(), deep.tolist())]
    text = [_ids_text(ids[a:z]) for a, z in zip(q["left"].tolist(), stops.tolist())]
    # of a part that came, the first row may be new and fork too
    children = q["children"] + np.where(starts, q["longer"], (b.lcp[0] == deep) & (b.size[0] > b.lcp[0]))
    fresh = q["fresh"] + np.where(starts, q["own"] - q["base"], q["first_fresh"])
    parts = {"path": pa.array(paths, pa.binary()), "n": pa.array(q["n"]), "low": pa.array(q["low"]),
             "children": pa.array(children), "leaves": pa.array(q["leaves"]), "tokens": pa.array(q["tokens"]),
             "fresh": pa.array(fresh), "base": pa.array(q["base"])}
    count = len(rows)
    out.append(pa.table({"kind": pa.array(["part"] * count, pa.string()), "block": pa.array(np.full(count, block), pa.int64()),
                         "side": pa.nulls(count, pa.string()), "parent_depth": pa.array(np.maximum(deep - 1, 0).astype(np.int32)),
                         "piece": pa.array([x or None for x in text], pa.binary()),
                         **{c: pa.nulls(count, k) for c, k in NODE_TYPES.items() if c != "depth"},
                         "depth": pa.array(deep.astype(np.int32)), **parts}))

    # open nodes as seen from here: (side, depth) -> path, and the path above
    seen = [("head", b.keys[0], d) for d in range(0, int(b.lcp[0]) + 1)] + [("tail", b.keys[-1], d) for d in range(0, b.next + 1)]
    m = len(seen)
    out.append(pa.table({"kind": pa.array(["seen"] * m, pa.string()), "block": pa.array(np.full(m, block), pa.int64()),
                         "side": pa.array([s for s, _, _ in seen], pa.string()), "parent_depth": pa.array([d for _, _, d in seen], pa.int32()),
                         "piece": pa.array([path(k, d - 1) if d else None for _, k, d in seen], pa.binary()),
                         **{c: pa.nulls(m, k) for c, k in NODE_TYPES.items()},
                         **{c: pa.nulls(m, k) for c, k in PART_TYPES.items() if c != "path"},
                         "path": pa.array([path(k, d) for _, k, d in seen], pa.binary())}))
    names = [x.split()[0] for x in BLOCK.replace(", ", ",").split(",")]
    return pa.concat_tables([x.select(names) for x in out])


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
NODE_TYPES = {c.split()[0]: _KINDS[c.split()[1]] for c in NODE.split(", ")}
PART_TYPES = {c.split()[0]: _KINDS[c.split()[1]] for c in PART.split(", ") if c != "depth int"}


# ---- the whole trie ---------------------------------------------------------

def _hash_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, piece) rows in the order of path and block -> (path, ends): one
    running hash, so a long list of ends is never held."""
    now, digest, out = None, None, []
    for batch in batches:
        for key, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != now:
                if now is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(piece)
            else:
                digest.update(b"," + piece)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out])], ["path", "ends"])
            out = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], ["path", "ends"])


def prefix_trie(keyed: DataFrame) -> DataFrame:
    """The nodes of the trie of ``keys`` (conv_id, key, words): ``conv_id`` (the
    smallest member), ``depth``, ``parent_conv_id`` (null at the root),
    ``n_convs`` (members), ``n_children``, ``n_leaves``, ``saved_tokens`` (over
    the subtree, a node's members but one times the words of its last turn) and
    ``ends_sha256`` (of the members that end here).

    Conversations are dealt by range of (key, conv_id), a group of equal ones
    being cut like any other, and stored, which fixes the blocks.  Each block
    learns the last key before it and the first one after it, and finds its
    nodes alone.  Nodes that cross a border are prefixes of a block's first or
    last row, so a block adds at most the lengths of two conversations to the
    parts, which are summed by path.  The hash of a group of equal conversations
    that spans blocks has to take its ids one after the other: one task streams
    them, held neither there nor in the driver.  A task holds one block, and of
    a conversation 24 bytes a turn.  A conversation without turns is a member of
    the root; repeated (conv_id, key) rows would count as members each, so ids
    should be unique, as ``sequences`` makes them.  An empty table gives no rows."""
    spark = prepare(keyed.sparkSession)
    keyed = stored(keyed, "keys")
    total = keyed.agg(F.sum(F.size("words") + 1)).first()[0]
    if not total:
        return spark.createDataFrame([], NODE)
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK_TURNS))
    dealt = stored(keyed.repartitionByRange(blocks, "key", "conv_id").withColumn("block", F.spark_partition_id().cast("long")), "order")
    # one row a block: its smallest and largest key, then those of its neighbours
    ends = dealt.groupBy("block").agg(F.min("key").alias("head"), F.max("key").alias("tail"))
    along = Window.orderBy("block")
    around = ends.select("block", F.lag("tail").over(along).alias("before"), F.lead("head").over(along).alias("after"))
    found = stored(dealt.groupBy("block").cogroup(around.groupBy("block")).applyInArrow(_nodes, BLOCK), "nodes")

    parts, nodes, seen = (found.where(F.col("kind") == k) for k in ("part", "node", "seen"))
    total = lambda c: F.sum(c).alias(c)
    crossing = parts.groupBy("path").agg(F.first("depth").alias("depth"), total("n"), F.min("low").alias("low"), total("children"),
                                         total("leaves"), total("tokens"), total("fresh"), F.max("base").alias("base"))
    pieces = parts.where("piece is not null").select("path", "block", "piece")
    pieces = pieces.repartition("path").sortWithinPartitions("path", "block").select("path", "piece")
    crossing = crossing.join(pieces.mapInArrow(_hash_stream, "path binary, ends string"), "path", "left")
    none = hashlib.sha256(b"").hexdigest()
    crossing = stored(crossing.withColumn("ends", F.coalesce("ends", F.lit(none))), "crossing")
    above = seen.where("piece is not null").select("path", F.col("piece").alias("up")).distinct()
    parent = crossing.select(F.col("path").alias("up"), F.col("low").alias("parent_conv_id"))
    saved = F.col("tokens") - F.col("n") * F.col("base") - F.col("fresh")
    wide = (crossing.join(above, "path", "left").join(parent, "up", "left")
            .select(F.col("low").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"),
                    F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"),
                    F.col("ends").alias("ends_sha256")))
    # a whole node under a crossing one asks its own block for the parent
    local = seen.join(crossing.select("path", F.col("low").alias("above")), "path").select("block", "side", "parent_depth", "above")
    columns = [c.split()[0] for c in NODE.split(", ")]
    inner = nodes.where("side is null").select(*columns)
    under = (nodes.where("side is not null").join(local, ["block", "side", "parent_depth"])
             .withColumn("parent_conv_id", F.col("above")).select(*columns))
    return inner.unionByName(under).unionByName(wide.select(*columns))
