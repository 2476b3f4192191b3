"""Token counts through a digest cache."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm.common import grouped, prepare, shared_path

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
#: Texts are encoded in groups of about so many bytes; a longer text is cut.
GROUP_BYTES = 256 << 10
BLANK_RUN = re.compile(r"\s | \s")
CUT = re.compile(r"(?<=\S)(?= \S)")


def file_digest(path: str) -> str:
    """Version of a tokenizer: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def pieces(text: str, limit: int) -> list[str]:
    """Cut a long text before a blank between two non-blanks.  A byte-level
    tokenizer starts a word there whatever stands around it, so the counts of
    the pieces add up; a text without such a place stays whole."""
    out, a = [], 0
    while len(text) - a > limit:
        i = a + limit
        while i < len(text) - 1 and not (text[i] == " " and not text[i - 1].isspace() and not text[i + 1].isspace()):
            i += 1
        if i >= len(text) - 1:
            break
        out.append(text[a:i])
        a = i
    return [*out, text[a:]]


class Counter:
    """Counts tokens with the library that a vocabulary file belongs to; built
    once in each Python worker.

    For a byte-level vocabulary a blank between two non-blanks starts a word
    (see ``pieces``), so the count of a text is the sum over its blank-separated
    pieces, and the worker encodes a piece only when it meets it first."""

    _made: dict[str, Counter] = {}
    #: Pieces remembered in a worker before it starts afresh, and the longest one.
    MEMO, MEMO_CHARS = 1_000_000, 64

    def __init__(self, path: str):
        self.byte_level, self.memo = False, {}
        if path.endswith(".json"):
            from tokenizers import Tokenizer
            self.tok = Tokenizer.from_file(path)
            self.tok.no_truncation()
            self.tok.no_padding()
            self.byte_level = type(self.tok.pre_tokenizer).__name__ == "ByteLevel" and self.tok.normalizer is None
            encode = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
            self.encode = lambda texts: [len(e) for e in encode(texts, add_special_tokens=False)]
        else:
            import sentencepiece
            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(e) for e in sp.encode(texts, num_threads=1)]

    @classmethod
    def of(cls, path: str) -> Counter:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _by_piece(self, text: str) -> int:
        if BLANK_RUN.search(text):
            first, *rest = CUT.split(text)
            rest = [p[1:] for p in rest]
        else:
            first, *rest = text.split(" ")
        if not rest:
            return self.encode([first])[0]
        found = list(map(self.memo.get, rest))
        if None in found:
            new = list({p for p, n in zip(rest, found) if n is None})
            counts = dict(zip(new, self.encode([f" {p}" for p in new])))
            found = [counts[p] if n is None else n for p, n in zip(rest, found)]
            if len(self.memo) > self.MEMO:
                self.memo.clear()
            self.memo.update((p, n) for p, n in counts.items() if len(p) <= self.MEMO_CHARS)
        return sum(found) + self.encode([first])[0]

    def counts(self, texts: list[str]) -> np.ndarray:
        if self.byte_level:
            return np.array([sum(map(self._by_piece, pieces(t, GROUP_BYTES))) if t else 0 for t in texts], np.int64)
        out = np.zeros(len(texts), np.int64)
        for a, b in grouped([len(t) for t in texts], GROUP_BYTES):
            out[a:b] = self.encode(texts[a:b])
        return out


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for b in batches:
            n = Counter.of(path).counts(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n)], ["digest", "n_tokens"])
    return run


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts; a digest that two runs appended counts once."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, digest) for every row of ``docs``.

    Content is normalised by reading null as empty; nothing else may change, as
    counts are those of the raw text.  Its SHA-256 is joined to the counts
    stored for this tokenizer's digest; each distinct text without one is
    encoded once and appended to ``cache`` (a folder all executors reach; a new
    one in the shared folder by default).  A group of copies collapses on the
    map side before its text is shuffled.  Every row gives a row, repeated or
    null ids too; an empty table gives none; other columns are ignored."""
    spark = prepare(docs.sparkSession)
    cache = cache or shared_path(spark, "token_cache")
    version = file_digest(tokenizer)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    known = read_cache(spark, cache).where(F.col("tokenizer") == version).select("digest")
    misses = (texts.select(digest, "text").join(known, "digest", "left_anti")
              .groupBy("digest").agg(F.first("text").alias("text")))
    (misses.mapInArrow(_encode(tokenizer), "digest binary, n_tokens long")
     .select(F.lit(version).alias("tokenizer"), "digest", "n_tokens")
     .write.mode("append").parquet(cache))
    counts = (read_cache(spark, cache).where(F.col("tokenizer") == version)
              .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
    rows = texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest)
    return (rows.join(counts, "digest")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"),
                    F.lower(F.hex("digest")).alias("digest")))
