"""The corpus pipeline: documents in, a mixed training sample out.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir),
calls one operator of ``fleetscope.llm`` on all of ``docs`` and returns a
DataFrame, which is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm import decontaminate, lm_quality, mixing, simhash_dups, suffix_dedup
from fleetscope.llm.common import discard, prepare, row_key, stored, table

#: Shingle length and bit radius of the near-duplicate stage.
SHINGLE, MAX_BITS = 3, 3
#: Bytes of a repeated string.
REPEAT = 100


def without(docs: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows whose ``key`` is not among ``keys`` (_key)."""
    return (docs.withColumn("_key", key).join(keys.distinct(), "_key", "left_anti")
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A document is its doc_id, text and language: of rows that share a doc_id
    the good ones stay, and rows without one are judged too.  Null and empty
    texts stay; an empty table stays empty."""
    prepare(spark)
    scored = lm_quality.quality(docs, table(spark, sf_dir, "labels"), order=lm_quality.LONG_ORDER)
    rejected = scored.where("not keep").select(row_key(F.col("doc_id"), F.col("text_hash"), F.col("lang")).alias("_key"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return without(docs, row_key(F.col("doc_id").cast("long"), F.xxhash64(text), F.col("lang").cast("string")), rejected)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest
    doc_id; texts that are null or hold no word are copies of one another.  Two
    texts under one doc_id are judged apart; rows that repeat the kept one stay."""
    prepare(spark)
    return simhash_dups.drop_near_duplicates(docs, SHINGLE, MAX_BITS, judge_unnamed=True)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that repeat an earlier string go; a character that loses a byte
    goes whole.  Documents of which only blanks are left go.  A column
    ``n_chars``, if there is one, follows the text; null texts become empty."""
    prepare(spark)
    found = suffix_dedup.remove_repeats(docs, REPEAT).where("n_removed = 0 or trim(text) <> ''")
    own = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return found.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.  A document is its doc_id and
    text: another text under the same doc_id stays."""
    prepare(spark)
    key = row_key(F.col("doc_id"), F.col("text"))
    found = decontaminate.contaminated(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(docs, key, found.select(F.col("doc_id").alias("_key")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample at the target weights of source, language and topic.  The new
    columns topic, n_tokens and probability take the prefix ``mix_`` where the
    documents have columns of these names."""
    prepare(spark)
    mixed = mixing.mixture(docs).where("kept")
    new = [F.col(c).alias(c if c not in docs.columns else f"mix_{c}") for c in ("topic", "n_tokens", "probability")]
    return mixed.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], *new)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("suffix-array dedup", repeats_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: Model scores and the byte transform have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
        if before is not None:
            discard(before)             # its successor is written
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
