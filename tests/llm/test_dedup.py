import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from fleetscope.llm import components, sentence_dedup, simhash_dups, suffix_dedup
from fleetscope.llm.collection_bwt import columns


def brute_components(fp, bits):
    root = {i: i for i in fp}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(fp)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (fp[a] ^ fp[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def brute_print(text, k=3):
    import xxhash
    words = (text or "").encode().lower().split()
    sh = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components_against_brute_force(make_docs, prose):
    pick, rows = random.Random(1), [(None, "x y z w"), (0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "a b")]
    for i in range(40):
        text = prose(i, 120)
        rows.append((10 + 5 * i, text))
        for j in range(pick.randrange(4)):
            words = text.split()
            for _ in range(j):
                words[pick.randrange(len(words))] = "other"
            rows.append((11 + 5 * i + j, " ".join(words)))
    rows.append((7, prose(1, 60_000)))                                       # very long
    got = simhash_dups.simhash_components(make_docs(rows + rows[3:5])).collect()
    assert len(got) == len(rows) + 2
    prints = {i: brute_print(t) for i, t in rows if i is not None}
    assert {r.doc_id: r.fingerprint for r in got if r.doc_id is not None} == {i: f"{x:016x}" for i, x in prints.items()}
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == brute_components(prints, 3)
    assert [r.component_id for r in got if r.doc_id is None] == [None]


@pytest.mark.parametrize("bits,long_list", [(3, 2048), (3, 2), (0, 2048), (1, 3), (2, 3), (4, 3)])
def test_near_links_lose_no_pair(spark, make_docs, bits, long_list):
    """Dense families of fingerprints, with lists short enough to be split."""
    pick = random.Random(bits * 7 + long_list)
    prints = {0, (1 << 64) - 1}
    for _ in range(25):
        base = pick.getrandbits(64) & 0xFFFFFF | 0xABCDEF << 24
        for _ in range(12):
            x = base
            for _ in range(pick.randrange(6)):
                x ^= 1 << pick.randrange(64)
            prints.add(x)
    fps = spark.createDataFrame([(simhash_dups._signed(x),) for x in prints], "fp long")
    links = simhash_dups.near_links(fps, bits, long_list)
    got = {r.node: r.root for r in components.connected_components(links).collect()}
    expected = brute_components({simhash_dups._signed(x): x for x in prints}, bits)
    assert {i: got.get(i, i) for i in expected} == expected


def test_simhash_of_an_empty_table_and_the_filter(make_docs, prose):
    assert simhash_dups.simhash_components(make_docs([])).count() == 0
    docs = make_docs([(2, prose(1)), (1, prose(1)), (3, prose(2)), (None, prose(1)), (3, prose(2))])
    kept = simhash_dups.drop_near_duplicates(docs)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "3", "None"]
    assert set(kept.columns) == set(docs.columns)


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(30)] + [(7, 7), (5, 4), (5, 4)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(30)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_columns_give_sorted_suffixes_and_common_prefixes():
    pick = random.Random(3)
    for trial in range(60):
        pieces = [bytes(pick.choice(b"ab") for _ in range(pick.randrange(1, 9))) for _ in range(pick.randrange(1, 12))]
        first = np.array([pick.randrange(0, 4) for _ in pieces])
        for column, order, lcp in columns(pieces, first, 12):
            suffix = [pieces[i][column - first[i]:] if 0 <= column - first[i] else b"" for i in order.tolist()]
            assert suffix == sorted(suffix)
            for a, b, n in zip(suffix, suffix[1:], lcp[1:].tolist()):
                common = 0
                while common < min(len(a), len(b)) and a[common] == b[common]:
                    common += 1
                assert n == common


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for a in range(len(data) - length + 1):
            w = data[a:a + length]
            if w in seen:
                gone[a:a + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = sum(1 for a in np.flatnonzero(gone) if a == 0 or not gone[a - 1])
        out[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"))
    return out


@pytest.mark.parametrize("long_key,strings", [(50_000, 1 << 16), (3, 1 << 16), (50_000, 40)])
def test_repeated_bytes_against_brute_force(make_docs, prose, monkeypatch, long_key, strings):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 4000)
    if long_key == 3:                                           # many buckets, few at a time
        monkeypatch.setattr(suffix_dedup, "STEP_BYTES", 500)
        monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 1000)
    pick, line = random.Random(2), "This common line stands in many documents, and nothing is special about it.\n"
    rows = [(0, None), (1, ""), (2, "short"), (3, "é" * 300), (4, "ab" * 400), (5, "x" * 99), (6, "x" * 100), (7, "x" * 250)]
    for i in range(40):
        text = prose(i // 2 if i % 5 else i, 150)
        if i % 3 == 0:
            text = text[:200] + line + text[200:]
        if i % 4 == 0:
            a = pick.randrange(100)
            text += prose(99, 80)[a:a + 300]
        rows.append((10 + i, text))
    rows += [(60, prose(5, 400) + prose(5, 400)), (61, "\n".join([prose(6, 90), "ü" + prose(6, 90)]))]
    got = suffix_dedup.remove_repeats(make_docs(rows + rows[8:10]), 100, True, long_key, strings).collect()
    assert len(got) == len(rows) + 2
    assert {r.row.doc_id: tuple(r)[1:] for r in got} == brute_repeats(rows, 100)


def test_window_keys_in_small_blocks(prose, monkeypatch):
    data = np.frombuffer((prose(1, 500) + "a" * 300 + "ab" * 200).encode(), np.uint8)
    keys, places = suffix_dedup.window_keys(data, 100)
    grams = suffix_dedup._gram_hashes(data)
    for i in range(0, len(keys), 37):
        own = grams[i:i + 100 - suffix_dedup.GRAM + 1]
        assert keys[i] == own.min() and places[i] == own.argmin()
    monkeypatch.setattr(suffix_dedup, "BLOCK", 777)
    again = suffix_dedup.window_keys(data, 100)
    assert (again[0] == keys).all() and (again[1] == places).all()


def test_repeats_defined_cases(make_docs, prose):
    t = prose(1, 60)
    assert suffix_dedup.remove_repeats(make_docs([]), 100).count() == 0
    got = suffix_dedup.remove_repeats(make_docs([(None, t), (1, t), (1, t)]), 100, with_text=False).collect()
    assert sorted((str(r.row.doc_id), r.n_removed, r.text) for r in got) == [
        ("1", len(t), None), ("1", len(t), None), ("None", 0, None)]
    one = suffix_dedup.remove_repeats(make_docs([(1, t), (1, "Other. " + t)]), 100).collect()   # one doc_id, two texts
    assert sorted(r.n_removed > 0 for r in one) == [False, True]
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(make_docs([]), 10)


def brute_sentences(rows, length, words):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        pieces = sentence_dedup.sentences((t or "").encode())
        plain = [p.lower().split() for p in pieces]
        gone = set()
        for j in range(len(pieces)):
            ends = [e for e in range(j + length, len(pieces) + 1) if sum(map(len, plain[j:e])) >= words]
            run = tuple(b" ".join(p) for p in plain[j:ends[0]]) if ends else None
            if run in seen:
                gone |= set(range(j, ends[0]))
            if run:
                seen.add(run)
        out[i] = (len(pieces), len(gone), b"".join(p for j, p in enumerate(pieces) if j not in gone).decode())
    return out


def test_repeated_sentences_against_brute_force(make_docs, prose):
    passage = prose(500, 60)
    rows = [(0, None), (1, ""), (2, "One. Two."), (3, "No end"), (4, prose(4, 5000)), (5, "\n\n  \n")]
    rows += [(10 + i, prose(i, 60) + ("\n" if i % 2 else " ") + (passage if i % 3 == 0 else "") + " " + prose(1000 + i, 30))
             for i in range(30)]
    rows += [(50, prose(60, 50) + "\n" + prose(61, 30) + "\n" + prose(60, 50)), (51, prose(3, 60).upper())]
    got = sentence_dedup.remove_repeated_sentences(make_docs(rows + rows[7:8])).collect()
    assert len(got) == len(rows) + 1
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute_sentences(rows, sentence_dedup.SENTENCES, sentence_dedup.WORDS)
    assert sum(passage in (r.text or "") for r in got) == 1
    assert sentence_dedup.remove_repeated_sentences(make_docs([])).count() == 0
    null = sentence_dedup.remove_repeated_sentences(make_docs([(None, passage), (1, passage)])).collect()
    assert {r.doc_id: r.n_removed > 0 for r in null} == {None: False, 1: True}


def test_long_passages_of_short_sentences_go(make_docs, prose):
    menu = "".join(f"Menu entry {i}\n" for i in range(20))
    rows = [(i, prose(i, 40) + "\n" + menu + prose(100 + i, 40)) for i in range(4)]
    rows += [(10, "One of. of. Then other words here."), (11, "Some of. of. And so on it went.")]     # a chance pair
    by = {r.doc_id: r for r in sentence_dedup.remove_repeated_sentences(make_docs(rows)).collect()}
    assert [by[i].n_removed for i in (0, 1, 2, 3, 10, 11)] == [0, 20, 20, 20, 0, 0]
    assert ["Menu entry" in by[i].text for i in range(4)] == [True, False, False, False]


def test_rows_of_one_doc_id_keep_their_own_sentences(make_docs, prose):
    passage, other = prose(500, 60), prose(501, 60)
    got = sentence_dedup.remove_repeated_sentences(make_docs([(1, passage), (2, passage), (2, other)])).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(1, passage), (2, ""), (2, other)])


def test_sentences_join_to_the_text():
    for text in (b"", b"A. B", b"\n\nA.\n \nB! C?\tD", b"a.b. c", "É. Ü.\r\n".encode()):
        assert b"".join(sentence_dedup.sentences(text)) == text


@pytest.mark.parametrize("long_key", [50_000, 20])
def test_a_hot_passage_is_sent_once_a_block(prose, long_key):
    """Thousands of copies in one block: its distinct strings go to the
    buckets once, the other places without their bytes."""
    passage = prose(5, 60)[:140]
    texts = [prose(100 + i, 12) + passage + prose(5000 + i, 12) for i in range(3000)]
    block = pa.table({"block": pa.array([3] * 3000, pa.int64()), "did": pa.array(range(3000), pa.int64()),
                      "tk": pa.array(range(3000), pa.int64()), "text": texts})
    asked = suffix_dedup._requests(100, 8)(block).to_batches()
    asked = [b.take(pa.array(np.argsort(b.column("bucket").to_numpy(), kind="stable"))) for b in asked]
    answers = pa.Table.from_batches(list(suffix_dedup._count(long_key)(iter(asked))))
    sent = suffix_dedup._strings(100, 8)(block, answers)
    strings, places = {}, 0
    for row in sent.to_pylist():
        sizes, at = np.frombuffer(row["sizes"], np.uint16).tolist(), 0
        places += len(sizes) if not row["texts"] else 0
        for n in sizes if row["texts"] else []:
            string = row["texts"][at:at + n]
            strings[string] = strings.get(string, 0) + 1
            at += n
    assert max(strings.values()) == 1
    within = [s for s in strings if s in passage.encode()]
    assert len(within) <= 41 and places >= 2999                 # a window each, at most; the rest are places
    windows = {t.encode()[i:i + 100] for t in texts for i in range(len(t) - 99)}
    assert long_key == 50_000 or sum(map(len, strings)) <= 100 * len(windows)
