import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fleetscope.llm import hard_negatives, prefix_trie, sharding


# ---- sharding ---------------------------------------------------------------

def check_shards(rows, got, shards):
    sizes = lambda t: len((t or "").encode()) + 1
    expected = Counter((i, sizes(t), zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == expected
    by = defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        by[r.shard].append(r)
    line = []
    for k in sorted(by):
        own = sorted(by[k], key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        line += own
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r["size"])
    assert [key(r) for r in line] == sorted(map(key, line))         # shards are ranges of the order
    total, before = sum(r["size"] for r in line), 0
    for r in line:                                                  # equal targets, by the middle byte
        assert r.shard == min(shards - 1, (2 * before + r["size"]) * shards // (2 * total))
        before += r["size"]


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_of_odd_rows(make_docs, prose, shards):
    rows = [(i, prose(i, 5 + i % 40)) for i in range(120)]
    rows += [(None, "no id"), (None, None), (7, "again"), (7, "again"), (7, None), (8, ""), (9, "é" * 3000), (-4, prose(1, 4000))]
    rows += [(5, "same row")] * 90
    check_shards(rows, sharding.byte_shards(make_docs(rows), shards).collect(), shards)


def test_shard_sizes_differ_by_less_than_two_rows(make_docs, prose):
    rows = [(i, prose(i, 3 + i % 60)) for i in range(400)]
    got = sharding.byte_shards(make_docs(rows), 8).collect()
    sums = Counter()
    for r in got:
        sums[r.shard] += r["size"]
    assert len(sums) == 8 and max(sums.values()) - min(sums.values()) <= 2 * max(r["size"] for r in got)


def test_a_text_longer_than_a_share(make_docs):
    rows = [(1, "a"), (2, "x" * 10_000), (3, "b"), (4, "c")]
    check_shards(rows, sharding.byte_shards(make_docs(rows), 4).collect(), 4)
    assert sharding.byte_shards(make_docs([]), 4).count() == 0
    with pytest.raises(ValueError):
        sharding.byte_shards(make_docs(rows), 0)


def test_many_ranges_change_nothing(make_docs, prose, monkeypatch):
    rows = [(i % 30, prose(i % 50, 12)) for i in range(200)]
    monkeypatch.setattr(sharding, "RANGE_ROWS", 8)
    check_shards(rows, sharding.byte_shards(make_docs(rows), 8).collect(), 8)


def test_written_shards_hold_the_rows(spark, make_docs, prose, tmp_path):
    rows = [(i, prose(i, 5 + i % 20)) for i in range(100)] + [(None, None), (3, "twice"), (3, "twice")]
    docs = make_docs(rows)
    sharding.write_shards(docs, str(tmp_path / "out"), 4, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == set(docs.columns) | {"shard"}
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(rows)
    placed = {(r.doc_id, r.text_crc32): r.shard for r in sharding.byte_shards(docs, 4).collect()}
    for r in back.collect():
        assert placed[r.doc_id, zlib.crc32((r.text or "").encode())] == r.shard
    sharding.write_shards(make_docs([]), str(tmp_path / "none"), 4)


# ---- trie -------------------------------------------------------------------

def conversations(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    return df.selectExpr("*", "conv_id as key", "turn as block", "text as words", "role as path") if extra else df


def brute_sequences(rows, family=20, heads=4):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=lambda x: (x[0], x[1].encode(), x[2].encode()))] for c, v in own.items()}
    out = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        donor = c - int(np.fmod(c, family))
        out[c] = own.get(donor, [])[:h] + seq[h:]
    return out


def brute_trie(seqs):
    members = defaultdict(list)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    children = Counter(p[:-1] for p in members if p)
    out = set()
    for p, own in members.items():
        under = [q for q in members if q[:len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in own if len(seqs[c]) == len(p))))
        out.add((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), children[p],
                 sum(not children[q] for q in under), sum((len(members[q]) - 1) * words(q) for q in under),
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie(df):
    seqs = prefix_trie.rebuilt(prefix_trie.sequences(prefix_trie.turn_rows(df)))
    return prefix_trie.prefix_trie(prefix_trie.keys(seqs))


def talk(seed, n, turns=7, texts=3):
    pick = random.Random(seed)
    return [(c, t, pick.choice(["user", "assistant", None]), pick.choice(["hello there", "yes", "", None, " two  words\n", "no"][:texts + 1]))
            for c in range(n) for t in range(pick.randrange(1, turns))]


def both(spark, rows):
    got = [tuple(r) for r in trie(conversations(spark, rows)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_trie(brute_sequences(rows))


@pytest.mark.parametrize("seed", range(3))
def test_trie_is_the_brute_force_one(spark, seed):
    both(spark, talk(seed, 60, texts=seed + 1))


def test_trie_of_odd_rows(spark):
    rows = talk(5, 25) + [(None, 1, "user", "nobody"), (40, None, "user", "first"), (40, 1, None, None), (40, 1, None, None),
                          (-7, 2, "a", "x" * 5000), (-7, 1, "b", "y"), (61, 0, "user", "short"), (3, 0, "user", "tie"), (3, 0, "user", "other")]
    both(spark, rows)
    assert trie(conversations(spark, [])).count() == 0
    assert trie(conversations(spark, [(None, 1, "a", "b")])).count() == 0


def test_trie_of_conversations_without_turns(spark):
    # crc32("21") % 4 != 0 and conversation 20 is absent: only the root is left
    alone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    both(spark, [(alone, 0, "user", "gone")])
    both(spark, [(alone, 0, "user", "gone"), (100, 0, "user", "stays")])


@pytest.mark.parametrize("turns", [4, 16])
def test_hot_prefixes_that_span_blocks(spark, monkeypatch, turns):
    monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", turns)
    same = [(c, t, "user", f"turn {t}") for c in range(0, 900, 10) for t in range(3)]
    both(spark, same + [(c + 1, t, r, x) for c, t, r, x in talk(9, 40)] + [(1000, t, "user", f"turn {t}") for t in range(30)])


def test_extents_by_scan():
    pick = np.random.default_rng(1)
    lcp = pick.integers(0, 4, 200)
    row, depth = np.repeat(np.arange(200), 5), np.tile(np.arange(5), 200)
    left, right = prefix_trie.extents(lcp, row, depth)
    for i, d, a, z in zip(row, depth, left, right):
        x = i
        while x > 0 and lcp[x] >= d:
            x -= 1
        y = i
        while y + 1 < 200 and lcp[y + 1] >= d:
            y += 1
        assert (a, z) == (x, y)


# ---- hard negatives ---------------------------------------------------------

def brute_negatives(rows, anchors, positives, k, low):
    clean = {(i, l, tuple(int(np.floor(256 * float(x))) for x in v)) for i, l, v in rows
             if i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    asks = {}
    for i, l, v in sorted(clean):
        if i in anchors:
            asks.setdefault(i, (l, v))
    out = set()
    for a, (label, q) in asks.items():
        scored = sorted(((-sum(x * y for x, y in zip(q, v)), i, l) for i, l, v in clean if i != a))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            ok = [(n, i) for n, i, l in scored if l != label and low * -s <= 100 * -n <= 100 * -s]
            out |= {(a, p, r, i, -s, -n) for r, (n, i) in enumerate(ok[:k], 1)}
    return out


def negatives(spark, rows, anchors, **kw):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    df = df.selectExpr("*", "vec_id as block", "label as score", "vec_id as v")
    v = hard_negatives.labelled_vectors(df)
    got = hard_negatives.hard_negatives(v, v.where(v.vec_id.isin(list(anchors))), **kw).drop("negative_label").collect()
    return [tuple(r) for r in got]


@pytest.mark.parametrize("seed,width", [(0, 8), (1, 8), (2, 3)])
def test_negatives_are_the_brute_force_ones(spark, seed, width, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    pick = np.random.default_rng(seed)
    rows = [(i, int(pick.integers(0, 3)), [float(x) for x in pick.normal(0.3, 0.5, width).astype(np.float32)]) for i in range(300)]
    anchors = set(range(0, 300, 13))
    for kw in ({"positives": 5, "k": 5, "low": 80}, {"positives": 3, "k": 2, "low": 0}):
        got = negatives(spark, rows, anchors, **kw)
        assert len(got) == len(set(got)) and set(got) == brute_negatives(rows, anchors, **kw)


def test_negatives_of_odd_rows(spark):
    one = [1.0, 0.5]
    rows = ([(i, i % 2, one) for i in range(60)]                        # ties everywhere, one window for all
            + [(60, None, one), (61, 1, None), (62, 0, [1.0, None]), (63, 0, [float("nan"), 1.0]), (64, 1, [float("inf"), 1.0]),
               (None, 1, one), (65, 0, [1.0]), (66, 1, []), (67, 0, [0.0, 0.0]), (68, 1, [-1.0, -0.5]), (69, 7, one), (2, 0, one), (4, 1, [0.25, 0.5])])
    anchors = {0, 2, 4, 60, 62, 66, 67, 68, 69}
    kw = {"positives": 5, "k": 5, "low": 80}
    assert set(negatives(spark, rows, anchors, **kw)) == brute_negatives(rows, anchors, **kw)
    assert negatives(spark, [], {0}) == [] and negatives(spark, rows, {999}) == []


def test_anchor_blocks_are_not_broadcast(spark, monkeypatch):
    """The driver would hold a copy of all anchors for every candidate block."""
    plans, search = [], hard_negatives._search

    def seen(*args, **kw):
        plans.append(search(*args, **kw))
        return plans[-1]
    monkeypatch.setattr(hard_negatives, "_search", seen)
    pick = np.random.default_rng(6)
    rows = [(i, i % 3, [float(x) for x in pick.normal(0.3, 0.5, 8).astype(np.float32)]) for i in range(300)]
    kw = {"positives": 5, "k": 5, "low": 80}
    assert set(negatives(spark, rows, set(range(0, 300, 13)), **kw)) == brute_negatives(rows, set(range(0, 300, 13)), **kw)
    assert len(plans) == 2
    for found in plans:
        found.collect()
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_scores_past_the_integers_raise(spark):
    rows = [(i, i % 2, [3e38, 1.0]) for i in range(4)]
    with pytest.raises(Exception, match="64-bit"):
        negatives(spark, rows, {0})


def test_slots_are_disjoint():
    limits = np.array([9, 4, -2])
    assert hard_negatives.slots(np.array([10, 9, 5, 4, 0, -2, -3]), limits).tolist() == [-1, 0, 0, 1, 1, 2, 2]
