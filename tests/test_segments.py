"""The segment source: newest start, bounded batches, nothing lost or repeated."""

import os
from collections import Counter

import pytest

from fleetscope.sources import ingest, segments
from fleetscope.streaming import jobs


def append(d, segment, lines, tail=""):
    os.makedirs(d, exist_ok=True)
    with open(f"{d}/{segment}.log", "a", encoding="utf-8") as f:
        f.write("".join(line + "\n" for line in lines) + tail)


def sink(spark, seg, out, ck, **kw):
    """Run until all appended messages are read; (rows of each batch)."""
    sizes = []

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        sizes.append(spark.read.parquet(f"{out}/batch={batch_id}").count())
    q = segments.stream(spark, seg, **kw).writeStream.foreachBatch(write).option("checkpointLocation", ck).start()
    q.processAllAvailable()
    q.stop()
    return sizes


def found(spark, out):
    return Counter(r.data for r in spark.read.parquet(out).collect())


def test_starts_at_newest_and_resumes_after_a_restart(spark, tmp_path):
    seg, out, ck = (str(tmp_path / x) for x in ("seg", "out", "ck"))
    append(seg, "a", [f"old {i}" for i in range(5)], tail="half")
    assert sum(sink(spark, seg, out, ck)) == 0
    append(seg, "a", [" line ends here"] + [f"a{i}" for i in range(3)])
    append(seg, "b", [f"b{i}" for i in range(4)])                        # a new segment is read from its start
    sink(spark, seg, out, ck)
    expected = Counter(["half line ends here", *[f"a{i}" for i in range(3)], *[f"b{i}" for i in range(4)]])
    assert found(spark, out) == expected
    append(seg, "b", ["b4"])
    append(seg, "c", ["é one", "", "  blanks  "], tail="unfinished")
    sink(spark, seg, out, ck)
    sink(spark, seg, out, ck)                                            # nothing new: nothing again
    assert found(spark, out) == expected + Counter(["b4", "é one", "", "  blanks  "])


def test_a_batch_has_at_most_its_rows(spark, tmp_path):
    seg, out, ck = (str(tmp_path / x) for x in ("seg", "out", "ck"))
    for s, n in (("a", 900), ("b", 40), ("c", 300)):
        append(seg, s, [f"{s} {i}" for i in range(n)])
    sizes = sink(spark, seg, out, ck, start="oldest")
    assert max(sizes) == segments.BATCH_ROWS and sum(sizes) == 1240
    assert set(found(spark, out).values()) == {1} and len(found(spark, out)) == 1240


def test_a_batch_that_failed_is_read_again_as_it_was(spark, tmp_path):
    seg, out, ck = (str(tmp_path / x) for x in ("seg", "out", "ck"))
    append(seg, "a", [f"m{i}" for i in range(30)])

    def fail(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if batch_id == 1:
            raise RuntimeError("lost")
    q = segments.stream(spark, seg, start="oldest", rows=10).writeStream.foreachBatch(fail).option("checkpointLocation", ck).start()
    with pytest.raises(Exception):
        q.processAllAvailable()
    first = {r.data for r in spark.read.parquet(f"{out}/batch=1").collect()}
    append(seg, "a", ["later"])
    sink(spark, seg, out, ck, start="oldest", rows=10)
    assert {r.data for r in spark.read.parquet(f"{out}/batch=1").collect()} == first
    assert found(spark, out) == Counter([f"m{i}" for i in range(30)] + ["later"])


def test_long_lines_and_the_batch_reader(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "READ", 64)
    seg = str(tmp_path / "seg")
    rows = ["x" * n for n in (0, 1, 63, 64, 65, 500, 3000)] + ["y"]
    append(seg, "a", rows, tail="z" * 200)
    f = segments.Folder(seg)
    size = f.sizes()["a.log"]
    whole = size - 200
    assert f.last_line("a.log", size) == whole
    at, seen = 0, []
    while True:
        end, n = f.advance("a.log", at, size, 3)
        if not n:
            break
        seen += [r for b in segments.lines(segments.Piece(seg, "a.log", at, end)) for r in b.column(2).to_pylist()]
        at = end
    assert seen == rows and at == whole
    got = segments.table(spark, seg).collect()
    assert [r.data for r in sorted(got, key=lambda r: r.position)] == rows
    data = open(f"{seg}/a.log", "rb").read()
    assert all(data[r.position:].startswith(r.data.encode() + b"\n") for r in got)
    assert segments.table(spark, str(tmp_path / "none")).count() == 0


def test_segments_feed_the_metrics_table(spark, tmp_path):
    from fleetscope.plans.q_ingest import metric_payloads
    from tests.conftest import SMALL
    seg = str(tmp_path / "seg")
    payloads = metric_payloads(spark, SMALL)
    texts = [r.data for r in payloads.select("data").collect()]
    assert not any("\n" in t for t in texts)
    append(seg, "a", texts[: len(texts) // 2])
    append(seg, "b", texts[len(texts) // 2:])
    raw = segments.stream(spark, seg, start="oldest", rows=400).select("data")
    q = jobs.metrics_to_table(raw, *(str(tmp_path / x) for x in ("out", "dead", "ck")), trigger_s=0)
    q.processAllAvailable()
    q.stop()
    good, bad = ingest.parse_metrics(payloads)
    assert spark.read.parquet(str(tmp_path / "out")).count() == good.count()
    assert spark.read.parquet(str(tmp_path / "dead")).count() == bad.count()


def test_a_long_segment_is_dealt_to_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "READ", 16)
    monkeypatch.setattr(segments, "PIECE", 64)
    seg = str(tmp_path / "seg")
    rows = ["x" * n for n in (0, 62, 63, 64, 0, 1, 300, 5)] + [f"é {i}" for i in range(100)]
    append(seg, "a", rows, tail="unfinished")
    append(seg, "b", ["short"])
    append(seg, "c", [], tail="no whole line")
    reader = segments.SegmentStreamReader(seg, "oldest", 1000)
    for pieces in (reader.partitions({}, reader.latestOffset()), segments.SegmentReader(seg).partitions()):
        a = [p for p in pieces if p.segment == "a.log"]
        assert len(a) > 5 and [p.segment for p in pieces if p not in a] == ["b.log"]
        assert a[0].start == 0 and all(p.end == q.start for p, q in zip(a, a[1:]))
        assert all(p.end - p.start >= 64 for p in a[:-1])
        texts = [[t for b in segments.lines(p) for t in b.column(2).to_pylist()] for p in a]
        assert [t for piece in texts for t in piece] == rows
        assert all(sum(len(t.encode()) + 1 for t in piece[:-1]) < 64 for piece in texts)    # one line over the bound at most


def test_line_ends_are_those_of_the_lines_asked_for():
    data = b"a\n\nbc\nd"
    assert [segments.line_end(data, n) for n in range(5)] == [(0, 0), (2, 1), (3, 2), (6, 3), (6, 3)]
    assert segments.line_end(b"half", 2) == segments.line_end(b"", 2) == (0, 0)


def test_the_segment_query_takes_batches_by_the_cores(spark, tmp_path, monkeypatch):
    """A core takes 20 000 messages of a batch, so batches are as many as that needs."""
    from fleetscope.plans import q_ingest, q_stream
    n = 20_001
    rows = spark.range(n).selectExpr("id AS event_id", "timestamp_micros(1704067200000000 + id * 1000003) AS ts",
                                     "id % 7 AS user_id", "'view' AS event_type", "id / 8 AS value", "'{\"k\": \"v\"}' AS props")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    queries = []

    def kept(*a, **kw):
        queries.append(metrics_to_table(*a, **kw))
        return queries[-1]
    metrics_to_table = jobs.metrics_to_table
    monkeypatch.setattr(jobs, "metrics_to_table", kept)
    got = q_stream.s1_stream(spark, str(tmp_path))
    batches = [p.numInputRows for p in queries[0].recentProgress if p.numInputRows]
    most = 20_000 * spark.sparkContext.defaultParallelism
    assert sum(batches) == n and max(batches) <= most and len(batches) == -(-n // most)
    expected = q_ingest.s2(spark, str(tmp_path))
    assert got.exceptAll(expected).isEmpty() and expected.exceptAll(got).isEmpty() and got.count() > 0
