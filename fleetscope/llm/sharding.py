"""Contiguous balanced shards from global prefix sums of byte sizes.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.llm.common import prepare, stored

#: Rows of one range of the global order; the number of ranges follows the data.
RANGE_ROWS = 1 << 18
#: Rows with one place in the order (same id, same text) are interchangeable.
ORDER = ("doc_id", "text_crc32", "size")


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes of the text plus one; null has none)
    and ``text_crc32`` (unsigned; a null text counts as empty)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def _order() -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in ORDER]


def _before(totals: DataFrame, column: str) -> Column:
    """Sum of a column over all ranges before this one."""
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(earlier), F.lit(0)).cast("long")


def positions(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, size, text_crc32) with ``place`` (from 0 in the global
    order) and ``before`` (bytes of all rows before this one), and ``total``.

    The rows are dealt by range of the order and stored, which fixes the
    ranges; each range is summed, the sums of the earlier ranges (one small row
    a range) are added to running sums inside a range.  Rows equal in the whole
    order are told apart by their place in the input, so a run of equal ids or
    of repeated rows is cut into several ranges like any other."""
    spark = rows.sparkSession
    rows = stored(rows.withColumn("nth", F.monotonically_increasing_id()), "sized")
    n = rows.count()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS))
    dealt = stored(rows.repartitionByRange(ranges, *_order(), "nth").withColumn("range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    starts = totals.select("range", _before(totals, "n").alias("first"), _before(totals, "bytes").alias("offset"),
                           F.sum("bytes").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("range").orderBy(*_order(), "nth")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.select(*ORDER, "range", F.row_number().over(inside).alias("i"), F.sum("size").over(running).alias("upto"))
    # one row a range: at most rows / RANGE_ROWS + the shuffle partitions
    return placed.join(F.broadcast(starts), "range").select(
        *ORDER, (F.col("first") + F.col("i") - 1).alias("place"),
        (F.col("offset") + F.col("upto") - F.col("size")).alias("before"), "total")


def shard_of(shards: int) -> Column:
    """The shard whose share of the total holds the middle byte of the row.
    Sums past the 64-bit range raise an error."""
    return F.expr(f"least({shards - 1}, ((2 * before + size) * {shards}L) div (2 * total))").cast("int")


def byte_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Every row of ``docs`` with ``size``, ``text_crc32``, ``law`` (``bytes``),
    ``shard``, ``slot`` (from 0 without gaps within the shard) and
    ``grown_shard`` (null: a change of the shard count moves cuts, not keys).

    The rows in the order of doc_id, null first, then of the text's CRC and
    size, lie on one line of bytes, cut at equal targets: shards are ranges of
    this order, and no two differ by more than the two rows at their ends.  A
    row that is longer than a shard's share fills it alone, and a shard between
    two cuts within one row stays empty.  Rows that share an id are neighbours;
    repeated rows each count and may lie on both sides of a cut, so equal texts
    are not kept together, as no group held by a third of all rows could be.
    An empty table gives no rows.  Other columns of ``docs`` are not read."""
    prepare(docs.sparkSession)
    if shards < 1:
        raise ValueError("at least one shard")
    placed = stored(positions(sized(docs)).select(*ORDER, "place", shard_of(shards).alias("shard")), "placed")
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(        # one row a shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _cuts(placed: DataFrame) -> list[tuple]:
    """(doc_id, CRC, size) of the first row of every shard: one row a shard."""
    first = F.min_by(F.struct(*ORDER), "place")
    return [tuple(r["first"]) + (r["shard"],) for r in placed.groupBy("shard").agg(first.alias("first")).collect()]


def write_shards(docs: DataFrame, path: str, shards: int = 8, files: int = 1) -> None:
    """Write the whole rows of ``docs`` as Parquet under ``path/shard=N``, about
    ``files`` files a shard, sorted in the global order.

    Only the cuts (one row a shard) go to the rows: a row's shard is the last
    one whose first row is not after it.  Rows equal in id, CRC and size that a
    cut parts are all written to the shard in which the last of them starts."""
    placed = byte_shards(docs, shards).withColumn("place", F.struct("shard", "slot"))
    cuts = sorted(_cuts(placed), key=lambda c: c[-1])
    if not cuts:
        docs.withColumn("shard", F.lit(0)).write.mode("error").partitionBy("shard").parquet(path)
        return
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    low = F.lit(-1 << 63).cast("long")
    own = F.struct(F.col("doc_id").isNotNull(), F.coalesce(F.col("doc_id").cast("long"), low), F.crc32(text.cast("binary")),
                   F.octet_length(text).cast("long") + 1)
    shard = F.lit(cuts[0][-1])
    for doc_id, crc, size, k in cuts[1:]:
        cut = F.struct(F.lit(doc_id is not None), F.lit(doc_id).cast("long") if doc_id is not None else low,
                       F.lit(crc).cast("long"), F.lit(size).cast("long"))
        shard = F.when(own >= cut, F.lit(k)).otherwise(shard)
    columns = [F.col(f"`{c}`") for c in docs.columns if c != "shard"]
    rows = docs.select(*columns, shard.cast("int").alias("shard"))
    rows = rows.repartitionByRange(max(1, len(cuts) * files), "shard", F.col("doc_id").asc_nulls_first())
    rows.sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first()).write.partitionBy("shard").parquet(path)
