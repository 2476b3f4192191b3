"""Per-series window work that stays parallel when one series is huge.

A plain ``Window.partitionBy(series)`` puts a whole series into one task; if
one server/metric holds a third of the rows that task is a third of the job.
The helpers here partition by (series, time chunk) instead and repair the
chunk edges exactly:

* rolling frames: rows near the end of a chunk are copied into the next chunk
  as context rows (a frame never reaches back further than one chunk); a frame
  is put together of two running aggregates, not summed up row by row;
* "previous row" / "nearest row" / running totals: a per-(series, chunk)
  summary (a few rows per chunk, tiny next to the data) is windowed per
  series and joined back, so values carry across any number of empty chunks.

The chunk size changes the plan, not the result, but for the last digits of
running sums of doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.sources.bindings import idiv

DAY_US = 86_400_000_000
CHUNK_CONF = "fleetscope.chunk.seconds"


DEFAULT_S = 3600


def chunk_size(chunk_us: int | None = None, floor_us: int = 60_000_000) -> int:
    """Chunk length in microseconds: the argument, else the session setting
    ``fleetscope.chunk.seconds`` (an hour by default), never less than the
    operator's frame.  It is a setting and not measured from the data, so that
    building a plan starts no job."""
    if chunk_us:
        return int(chunk_us)
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    seconds = (spark.conf.get(CHUNK_CONF, None) if spark is not None else None) or DEFAULT_S
    return max(floor_us, int(float(seconds) * 1_000_000))


def _us(ts: str) -> Column:
    return F.unix_micros(F.col(ts))


def with_previous(df: DataFrame, keys: list[str], ts: str, cols: list[str],
                  chunk_us: int | None = None, prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<ts>`` and ``prev_<col>`` = the previous row of the series
    (by ``ts``), also when it lies in an earlier chunk."""
    chunk_us = chunk_size(chunk_us)
    us = _us(ts)
    x = df.withColumn("_us", us).withColumn("_chunk", idiv(us, chunk_us))
    w = Window.partitionBy(*keys, "_chunk").orderBy("_us")
    x = x.withColumn("_rn", F.row_number().over(w))
    x = x.withColumn(f"{prefix}{ts}", F.lag(ts).over(w))
    for c in cols:
        x = x.withColumn(f"{prefix}{c}", F.lag(c).over(w))
    # last row of every chunk, then the last row of the nearest earlier chunk
    last = (x.groupBy(*keys, "_chunk")
            .agg(F.max_by(F.struct(F.col(ts).alias("t"), *[F.col(c).alias(c) for c in cols]), "_us")
                 .alias("_last")))
    ws = Window.partitionBy(*keys).orderBy("_chunk")
    carry = (last.withColumn("_carry", F.lag("_last").over(ws))
             .select(*keys, "_chunk", "_carry"))
    x = x.join(carry, on=[*keys, "_chunk"], how="left")
    first = F.col("_rn") == 1
    x = x.withColumn(f"{prefix}{ts}", F.when(first, F.col("_carry.t")).otherwise(F.col(f"{prefix}{ts}")))
    for c in cols:
        x = x.withColumn(f"{prefix}{c}", F.when(first, F.col(f"_carry.{c}"))
                         .otherwise(F.col(f"{prefix}{c}")))
    return x.drop("_us", "_chunk", "_rn", "_carry")


def rolling_mean_std(df: DataFrame, part: list[str], us: str, value: str, width: int) -> DataFrame:
    """Add ``_mean`` and ``_std`` (sample deviation, 0.0 of fewer than two
    values) of ``value`` over the rows of ``part`` in (us - width, us].

    Time is cut into blocks of ``width``: a frame is the end of the block before
    and the beginning of its own.  Both are running aggregates, so that a row
    costs the same however many rows its frame holds.  Each row is there twice:
    in its own block, and in the next one as a row of the block before, ``width``
    later: of those, the frame holds the ones after its own row."""
    t = F.col(us)
    twice = F.when(t.isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    x = (df.withColumn("_ctx", F.explode(twice)).withColumn("_block", idiv(t, width) + F.col("_ctx"))
         .withColumn("_pos", t + F.col("_ctx") * width))
    w = Window.partitionBy(*part, "_block")
    begin = w.orderBy("_pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # at one position the row itself comes first: what is ``width`` back is outside the frame
    end = w.orderBy(F.col("_pos").desc(), "_ctx").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    for side, ctx, over in (("e", 1, end), ("b", 0, begin)):
        v = F.when(F.col("_ctx") == ctx, F.col(value))
        for name, agg in (("n", F.count), ("s", F.sum), ("var", F.var_pop), ("lo", F.min), ("hi", F.max)):
            x = x.withColumn(f"_{name}_{side}", agg(v).over(over))
    n_e, n_b = F.col("_n_e"), F.col("_n_b")
    n = n_e + n_b
    total = F.coalesce("_s_e", F.lit(0.0)) + F.coalesce("_s_b", F.lit(0.0))
    apart = F.col("_s_e") / n_e - F.col("_s_b") / n_b
    squares = (F.coalesce(F.col("_var_e") * n_e, F.lit(0.0)) + F.coalesce(F.col("_var_b") * n_b, F.lit(0.0))
               + F.when((n_e > 0) & (n_b > 0), apart * apart * n_e * n_b / n).otherwise(F.lit(0.0)))
    low, high = F.least("_lo_e", "_lo_b"), F.greatest("_hi_e", "_hi_b")
    flat = (low == high) & (F.abs(high) < float("inf"))     # equal values: no rounding error as a deviation
    std = F.when((n < 2) | flat, F.lit(0.0)).otherwise(F.sqrt(squares / (n - 1)))
    return (x.filter(F.col("_ctx") == 0).withColumn("_mean", F.when(n > 0, total / n)).withColumn("_std", std)
            .select(*df.columns, "_mean", "_std"))


def row_index(df: DataFrame, keys: list[str], ts: str, tiebreak: list[str] | None = None,
              out: str = "idx", chunk_us: int | None = None) -> DataFrame:
    """0-based position of every row in its series (``ts`` order, then
    ``tiebreak``): row number inside the chunk plus the row count of all
    earlier chunks."""
    chunk_us = chunk_size(chunk_us)
    us = _us(ts)
    x = df.withColumn("_us", us).withColumn("_chunk", idiv(us, chunk_us))
    w = Window.partitionBy(*keys, "_chunk").orderBy("_us", *(tiebreak or []))
    x = x.withColumn("_rn", F.row_number().over(w) - 1)
    cnt = x.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    ws = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    off = cnt.withColumn("_off", F.coalesce(F.sum("_n").over(ws), F.lit(0))).drop("_n")
    return (x.join(off, on=[*keys, "_chunk"], how="left")
            .withColumn(out, (F.col("_rn") + F.col("_off")).cast("long"))
            .drop("_us", "_chunk", "_rn", "_off"))


def running_sum(df: DataFrame, keys: list[str], ts: str, value: str, out: str,
                chunk_us: int | None = None) -> DataFrame:
    """Cumulative sum of ``value`` per series in ``ts`` order (ties summed
    together, as a RANGE frame does)."""
    chunk_us = chunk_size(chunk_us)
    us = _us(ts)
    x = df.withColumn("_us", us).withColumn("_chunk", idiv(us, chunk_us))
    w = (Window.partitionBy(*keys, "_chunk").orderBy("_us")
         .rangeBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_within", F.sum(value).over(w))
    tot = x.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_tot"))
    ws = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.withColumn("_off", F.coalesce(F.sum("_tot").over(ws), F.lit(0.0))).drop("_tot")
    return (x.join(off, on=[*keys, "_chunk"], how="left")
            .withColumn(out, F.col("_within") + F.col("_off"))
            .drop("_us", "_chunk", "_within", "_off"))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], ts: str, value: str,
            out: str = "nearest_value", chunk_us: int | None = None) -> DataFrame:
    """As-of join in both directions: every ``left`` row gets the ``value`` of
    the ``right`` row of the same series nearest in time; equal distance goes
    to the earlier point, distance is unbounded.  No range self-join: both
    sides are unioned and scanned once per (series, chunk)."""
    chunk_us = chunk_size(chunk_us)
    lcols = left.columns
    l_ = left.withColumn("_side", F.lit(1)).withColumn("_rv", F.lit(None).cast("double"))
    r_ = (right.select(*keys, ts, F.col(value).cast("double").alias("_rv"))
          .withColumn("_side", F.lit(0)))
    for c in lcols:
        if c not in keys and c != ts:
            r_ = r_.withColumn(c, F.lit(None).cast(left.schema[c].dataType))
    u = l_.unionByName(r_)
    us = _us(ts)
    u = u.withColumn("_us", us).withColumn("_chunk", idiv(us, chunk_us))
    pt = F.when(F.col("_side") == 0, F.struct(F.col("_us").alias("t"), F.col("_rv").alias("v")))
    # right rows sort before left rows at the same instant: an exact hit is "before"
    w = Window.partitionBy(*keys, "_chunk")
    # "after" runs from the end: a frame that ends with the partition is evaluated anew for each row
    so_far = (Window.unboundedPreceding, 0)
    u = (u.withColumn("_b", F.last(pt, ignorenulls=True).over(w.orderBy("_us", "_side").rowsBetween(*so_far)))
         .withColumn("_a", F.last(pt, ignorenulls=True).over(
             w.orderBy(F.col("_us").desc(), F.col("_side").desc()).rowsBetween(*so_far))))
    # chunk-level carry: one summary row per (series, chunk) holding any row
    # (its last / first right point, NULL when it has none), scanned per
    # series (#chunks rows) for the nearest right point strictly before /
    # after the chunk, and joined to every left row of the chunk.  The summary
    # is a map-side partial aggregate; the data itself is shuffled once.
    pt_of = F.when(F.col("_side") == 0, F.struct(F.col("_us").alias("t"), F.col("_rv").alias("v")))
    pre = l_.unionByName(r_).withColumn("_us", us).withColumn("_chunk", idiv(us, chunk_us))
    summ = pre.groupBy(*keys, "_chunk").agg(F.max(pt_of).alias("_last"), F.min(pt_of).alias("_first"))
    ws = Window.partitionBy(*keys)
    carry = (summ.withColumn("_cb", F.last("_last", ignorenulls=True)
                             .over(ws.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)))
             .withColumn("_ca", F.last("_first", ignorenulls=True)
                         .over(ws.orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)))
             .select(*keys, "_chunk", "_cb", "_ca"))
    res = (u.filter(F.col("_side") == 1).join(carry, [*keys, "_chunk"], "left")
           .withColumn("_b", F.coalesce("_b", "_cb"))
           .withColumn("_a", F.coalesce("_a", "_ca")))
    db = F.col("_us") - F.col("_b.t")
    da = F.col("_a.t") - F.col("_us")
    pick = (F.when(F.col("_b").isNull(), F.col("_a.v"))
            .when(F.col("_a").isNull(), F.col("_b.v"))
            .when(db <= da, F.col("_b.v"))
            .otherwise(F.col("_a.v")))
    return res.withColumn(out, pick).select(*lcols, out)


def first_at_or_after(left: DataFrame, right: DataFrame, keys: list[str], t: str, payload: str,
                      out: str, chunk_us: int | None = None) -> DataFrame:
    """For every ``left`` row: ``payload`` of the first ``right`` row of the
    same key whose ``t`` (long microseconds) is >= the left row's ``t``;
    NULL when there is none.  Scanned per (key, chunk) with a per-chunk
    summary carrying the answer across chunks without right rows."""
    chunk_us = chunk_size(chunk_us)
    lcols = left.columns
    l_ = left.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_v"),
                     F.struct(*[F.col(c) for c in lcols]).alias("_row"))
    r_ = right.select(*keys, F.col(t).alias("_t"), F.lit(0).alias("_side"), F.col(payload).cast("long").alias("_v"),
                      F.lit(None).cast(l_.schema["_row"].dataType).alias("_row"))
    u = l_.unionByName(r_).withColumn("_chunk", idiv(F.col("_t"), chunk_us))
    # from the end on; right rows come before left rows of the same instant: "at" counts as after
    w = (Window.partitionBy(*keys, "_chunk").orderBy(F.col("_t").desc(), "_side")
         .rowsBetween(Window.unboundedPreceding, 0))
    u = u.withColumn("_a", F.last("_v", ignorenulls=True).over(w))
    lhs = u.filter(F.col("_side") == 1)
    have = lhs.filter(F.col("_a").isNotNull())
    need = lhs.filter(F.col("_a").isNull())
    summ = (u.filter(F.col("_side") == 0).groupBy(*keys, "_chunk")
            .agg(F.min_by("_v", "_t").alias("_first")).withColumn("_mark", F.lit(False)))
    marks = need.select(*keys, "_chunk").distinct().select(
        *keys, "_chunk", F.lit(None).cast("long").alias("_first"), F.lit(True).alias("_mark"))
    ws = Window.partitionBy(*keys).orderBy(F.col("_chunk").desc()).rangeBetween(Window.unboundedPreceding, -1)
    carry = (summ.unionByName(marks).withColumn("_ca", F.last("_first", ignorenulls=True).over(ws))
             .filter("_mark").select(*keys, "_chunk", "_ca"))
    need = need.join(carry, [*keys, "_chunk"], "left").withColumn("_a", F.col("_ca")).drop("_ca")
    res = have.unionByName(need)
    return res.select(*[F.col(f"_row.{c}").alias(c) for c in lcols], F.col("_a").alias(out))


def running_extremes(df: DataFrame, keys: list[str], ts: str, value: str, tiebreak: list[str] | None = None,
                     chunk_us: int | None = None) -> DataFrame:
    """Add ``low`` and ``high``, the smallest and largest ``value`` of the series
    up to and including the row (``ts`` order, then ``tiebreak``): running
    extremes inside the chunk, combined with those of all earlier chunks, which
    are one row a chunk.  A null value counts for nothing."""
    chunk_us = chunk_size(chunk_us)
    x = df.withColumn("_us", _us(ts)).withColumn("_chunk", idiv(F.col("_us"), chunk_us))
    inside = (Window.partitionBy(*keys, "_chunk").orderBy("_us", *(tiebreak or []))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = x.groupBy(*keys, "_chunk").agg(F.min(value).alias("_a"), F.max(value).alias("_z"))
    before = ends.select(*keys, "_chunk", F.min("_a").over(earlier).alias("_low"), F.max("_z").over(earlier).alias("_high"))
    x = x.withColumn("_a", F.min(value).over(inside)).withColumn("_z", F.max(value).over(inside))
    # least and greatest skip nulls: the first chunk has nothing before it
    return (x.join(before, [*keys, "_chunk"], "left")
            .withColumn("low", F.least("_a", "_low")).withColumn("high", F.greatest("_z", "_high"))
            .drop("_us", "_chunk", "_a", "_z", "_low", "_high"))
