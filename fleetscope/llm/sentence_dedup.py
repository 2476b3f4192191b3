"""Removal of repeated runs of sentences."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import byte_texts, id_key, prepare

#: Two sentences of a few words repeat by chance; 20 words in one order do not.
SENTENCES, WORDS = 2, 20
#: A sentence ends after . ! or ? before a blank, and after a line end.
_END = re.compile(rb"(?<=[.!?])(?=[ \t\r\n])|(?<=\n)")


def sentences(text: bytes) -> list[bytes]:
    """The sentences, blanks around them included: joined they are the text.
    Blank pieces go with the sentence before them."""
    out: list[bytes] = []
    for piece in _END.split(text):
        if out and (not piece.strip() or not out[-1].strip()):
            out[-1] += piece
        elif piece:
            out.append(piece)
    return out


def run_ends(sizes: list[int], length: int, words: int) -> list[int | None]:
    """Where the run from each sentence on ends: after ``length`` sentences, or
    as many more as it takes to ``words`` words; none if the text ends before."""
    out, end, total = [], 0, 0
    for i, n in enumerate(sizes):
        while end < len(sizes) and (end - i < length or total < words):
            total += sizes[end]
            end += 1
        out.append(end if end - i >= length and total >= words else None)
        total -= n
    return out


def spans(pieces: list[bytes], length: int, words: int) -> list[tuple[int, int] | None]:
    """A 128-bit hash for the run from each sentence on (see ``run_ends``); A-Z
    and blanks are folded."""
    return [run and run[0] for run in _runs(pieces, length, words)]


def _runs(pieces: list[bytes], length: int, words: int) -> list[tuple[tuple[int, int], int] | None]:
    plain = [p.lower().split() for p in pieces]
    text = [b" ".join(p) for p in plain]
    return [None if end is None else
            (struct.unpack("<qq", hashlib.blake2b(b"\n".join(text[i:end]), digest_size=16).digest()), end)
            for i, end in enumerate(run_ends([len(p) for p in plain], length, words))]


def _emit(length: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for did, text in zip(b.column("did").to_pylist(), byte_texts(b.column("text"))):
                own = set(spans(sentences(text), length, words)) - {None}
                out += [(*h, did) for h in own]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)],
                                             ["h1", "h2", "did"])
    return run


def _cut(length: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, earlier in zip(byte_texts(b.column("text")), b.column("earlier").to_pylist()):
                pieces = sentences(text)
                runs = _runs(pieces, length, words)
                gone, seen = set(), {(h["h1"], h["h2"]) for h in earlier or ()}
                for i, run in enumerate(runs):
                    if run is None:
                        continue
                    h, end = run
                    if h in seen:
                        gone.update(range(i, end))
                    seen.add(h)
                out.append((len(pieces), len(gone), b"".join(p for i, p in enumerate(pieces) if i not in gone)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()),
                 pa.array([r[2] for r in out], pa.binary()).cast(pa.string())],
                ["doc_id", "n_sentences", "n_removed", "text"])
    return run


def remove_repeated_sentences(docs: DataFrame, length: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """(doc_id, n_sentences, n_removed, text) for every row of ``docs``, without
    the sentences covered by a run of consecutive sentences that also occurs
    earlier: in a document of smaller doc_id, or earlier in the same one.  From
    each sentence on there is one run: ``length`` sentences, or as many more as
    it takes to ``words`` words.

    Each document sends one row per distinct run; their smallest doc_id is a
    grouped minimum, combined on the map side, so a run that a third of all
    documents share is no hot group; only runs of several documents are joined
    back, by their hashes: rows that share a doc_id may hold different texts.
    Null texts are empty and give an empty text; documents of fewer
    sentences stay whole.  Rows that share a doc_id are one place in the order:
    none of them is earlier than another; a null doc_id comes first.  An empty
    table gives none; other columns are ignored."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), id_key().alias("did"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    runs = texts.select("did", "text").mapInArrow(_emit(length, words), "h1 long, h2 long, did long")
    shared = (runs.groupBy("h1", "h2").agg(F.min("did").alias("first"), F.max("did").alias("last"))
              .where("first < last").select("h1", "h2", "first"))
    later = (runs.join(shared, ["h1", "h2"]).where("did > first")
             .groupBy("did").agg(F.collect_set(F.struct("h1", "h2")).alias("earlier")))
    return (texts.join(later, "did", "left").select("doc_id", "text", "earlier")
            .mapInArrow(_cut(length, words), "doc_id long, n_sentences long, n_removed long, text string"))
