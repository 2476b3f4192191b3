"""Batch replay of the alert evaluator (R3 + R4): FIRING / RESOLVED events
of every rule over history, cooldown included, without a per-rule loop and
without collecting a rule's history into one task.

1. Tick values: at each evaluation tick t (every 30 s) a rule sees
   max(value) over [t - 5 min, t].  Samples are reduced to per-bucket
   partials first (bucket = the tick at or after the sample), and each
   partial is spread to the 10 (or 11, for a sample exactly on a tick) ticks
   whose window holds it; a second aggregation gives the tick value.  The
   latest score for ml rules is built the same way.
2. Breach per tick (P5 + modes); ticks with no value or an unknown operator
   are skipped, as in the reference.
3. Gaps and islands: consecutive ticks with the same breach flag form runs.
4. Chain: the first breached run fires at its first tick; a fire in run i
   resolves at the first non-breached tick e_i after it; the next fire is
   the first breached tick >= e_i + cooldown, in some later run j.  So
   next(i) = j is a pointer between runs, and the fired runs are the path
   from the first breached run, found by pointer doubling: log2(#runs) rounds
   of joins, each checkpointed, with every step distributed.

Only servers with a heartbeat are evaluated (J8).  Events carry what the event
table (S9), the outbox (F23) and the rule report (H4) read: an id made from
rule, state and instant, the threshold and the severity.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.operators import alerts as A
from fleetscope.operators.chunked import first_at_or_after, running_sum
from fleetscope.operators.series import ts_lit
from fleetscope.session import cut_lineage
from fleetscope.sources.bindings import idiv

SERIES = ["server_id", "metric_name"]
RULE = ["server_id", "rule_id"]


def _spread(df: DataFrame, keys: list[str], ts: str, agg_all, agg_edge, tick_us: int, window_us: int,
            until_us) -> DataFrame:
    """Per-bucket partials spread to the ticks whose trailing window holds
    them; returns (keys, tick_us, part) rows."""
    us = F.unix_micros(ts)
    b = idiv(us + (tick_us - 1), tick_us) * tick_us          # tick at or after the sample
    x = df.withColumn("_b", b).withColumn("_edge", us == b)
    parts = x.groupBy(*keys, "_b").agg(agg_all.alias("_all"), agg_edge.alias("_edge_part"))
    n_full = window_us // tick_us
    spread = parts.select(*keys, "_b", F.explode(F.sequence(F.lit(0), F.lit(n_full))).alias("_k"),
                          "_all", "_edge_part")
    part = F.when(F.col("_k") < n_full, F.col("_all")).otherwise(F.col("_edge_part"))
    return (spread.select(*keys, (F.col("_b") + F.col("_k") * tick_us).alias("tick_us"), part.alias("part"))
            .filter(F.col("part").isNotNull() & (F.col("tick_us") <= until_us)))


def tick_values(metrics: DataFrame, as_of, tick_s: int = 30, window_min: int = 5) -> DataFrame:
    """(server, metric, tick_us, value) = max over [tick - 5 min, tick]."""
    until = F.unix_micros(ts_lit(as_of))
    edge = F.max(F.when(F.col("_edge"), F.col("value")))
    s = _spread(metrics, SERIES, "ts", F.max("value"), edge, tick_s * 1_000_000, window_min * 60_000_000, until)
    return s.groupBy(*SERIES, "tick_us").agg(F.max("part").alias("value"))


def tick_scores(scores: DataFrame, as_of, tick_s: int = 30, window_min: int = 5) -> DataFrame:
    """(server, metric, tick_us, score) = newest score in [tick - 5 min, tick]."""
    until = F.unix_micros(ts_lit(as_of))
    pt = F.struct(F.unix_micros("ts").alias("t"), F.col("score").alias("s"))
    edge = F.max(F.when(F.col("_edge"), pt))
    s = _spread(scores, SERIES, "ts", F.max(pt), edge, tick_s * 1_000_000, window_min * 60_000_000, until)
    return s.groupBy(*SERIES, "tick_us").agg(F.max("part").alias("_p")).select(
        *SERIES, "tick_us", F.col("_p.s").alias("score"))


def breach_ticks(rules: DataFrame, metrics: DataFrame, scores: DataFrame | None, as_of,
                 tick_s: int = 30, heartbeats: DataFrame | None = None) -> DataFrame:
    """(server, rule, tick_us, value, breached, cooldown_us) for every tick
    the evaluator would act on: rules of servers in ``heartbeats`` (None: of
    all servers)."""
    r = A.enabled_rules(rules)
    if heartbeats is not None:
        r = r.join(heartbeats.select("server_id"), "server_id", "left_semi")
    tv = tick_values(metrics, as_of, tick_s)
    x = r.join(tv, SERIES, "inner")
    if scores is not None:
        x = x.join(tick_scores(scores, as_of, tick_s), [*SERIES, "tick_us"], "left")
    else:
        x = x.withColumn("score", F.lit(None).cast("double"))
    x = x.withColumn("breached", A.breach(F.col("value"), F.col("score"))).filter(F.col("breached").isNotNull())
    return x.select(*RULE, "metric_name", "threshold", "severity", "tick_us", "value", "breached",
                    (F.col("cooldown_minutes").cast("long") * 60_000_000).alias("cooldown_us"))


def replay(ticks: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """FIRING / RESOLVED events of the state machine over ``breach_ticks``."""
    # materialised once: the chunk sizing and both scans below read it
    t = cut_lineage(ticks.withColumn("_ts", F.timestamp_micros("tick_us")))
    # islands: a new run starts where the flag changes (lag per (rule, day) is
    # enough inside a chunk; the chunk edge uses the previous tick's flag)
    from fleetscope.operators.chunked import chunk_size, with_previous
    chunk = chunk_size()
    t = with_previous(t.withColumn("_b", F.col("breached").cast("int")), RULE, "_ts", ["_b"], prefix="_p",
                      chunk_us=chunk)
    t = t.withColumn("_new", F.when(F.col("_p_b").isNull() | (F.col("_p_b") != F.col("_b")), 1.0).otherwise(0.0))
    t = running_sum(t, RULE, "_ts", "_new", "_run", chunk_us=chunk).withColumn(
        "run", F.col("_run").cast("long")).drop("_run")
    t = cut_lineage(t.drop("_p_ts", "_p_b", "_new"))

    runs = t.groupBy(*RULE, "run").agg(F.first("breached").alias("breached"),
                                       F.min("tick_us").alias("start_us"), F.max("tick_us").alias("end_us"),
                                       F.first("cooldown_us").alias("cooldown_us"))
    # runs are numbered 1, 2, ... per rule: the tick that ends run r is the
    # start of run r + 1 (an equi-join, no per-rule window)
    succ = runs.select(*RULE, (F.col("run") - 1).alias("run"), F.col("start_us").alias("resolve_us"))
    runs = runs.join(succ, [*RULE, "run"], "left")
    b = runs.filter("breached").withColumn("target_us", F.col("resolve_us") + F.col("cooldown_us"))
    b = cut_lineage(b)

    # next(i): first breached run ending at or after target_i (run ends are
    # increasing, so this is an as-of lookup, chunked by time)
    tg = b.filter(F.col("target_us").isNotNull()).select(*RULE, F.col("run").alias("i"),
                                                          F.col("target_us").alias("_t"))
    ends = b.select(*RULE, F.col("end_us").alias("_t"), F.col("run").alias("_j"))
    nxt = (first_at_or_after(tg, ends, RULE, "_t", "_j", "j", chunk_us=chunk).filter(F.col("j").isNotNull())
           .select(*RULE, "i", "j"))
    nxt = cut_lineage(nxt)

    if max_rounds is None:
        n_max = b.groupBy(*RULE).count().agg(F.max("count")).first()[0] or 1
        max_rounds = max(1, math.ceil(math.log2(n_max + 1)))
    path = _path_by_doubling(b, nxt, max_rounds)

    # fire tick: first run -> its start; later runs -> first tick >= target of
    # the predecessor on the path
    pred = (nxt.join(path.withColumnRenamed("run", "i"), [*RULE, "i"], "left_semi")
            .join(b.select(*RULE, F.col("run").alias("i"), "target_us"), [*RULE, "i"])
            .select(*RULE, F.col("j").alias("run"), "target_us"))
    fired = (path.join(pred, [*RULE, "run"], "left")
             .withColumn("target_us", F.coalesce("target_us", F.lit(-(2 ** 62)))))
    fire_ticks = (t.filter("breached").join(fired, [*RULE, "run"], "inner")
                  .filter(F.col("tick_us") >= F.col("target_us"))
                  .groupBy(*RULE, "run").agg(F.min_by(F.struct("tick_us", "value"), "tick_us").alias("_f")))
    fires = fire_ticks.select(*RULE, F.col("_f.tick_us").alias("tick_us"), F.col("_f.value").alias("value"),
                              F.lit("FIRING").alias("state"))
    res_runs = path.join(b.select(*RULE, "run", "resolve_us"), [*RULE, "run"]).filter(F.col("resolve_us").isNotNull())
    resolves = (res_runs.join(t.select(*RULE, F.col("tick_us").alias("resolve_us"), "value"), [*RULE, "resolve_us"])
                .select(*RULE, F.col("resolve_us").alias("tick_us"), "value", F.lit("RESOLVED").alias("state")))
    meta = t.select(*RULE, "metric_name", "threshold", "severity").distinct()
    return (fires.unionByName(resolves).join(meta, RULE)
            .select(event_id().alias("event_id"), *RULE, "metric_name", "threshold", "severity", "state",
                    F.timestamp_micros("tick_us").alias("triggered_at"), "value"))


def event_id() -> Column:
    """The same event always has the same id, in batch and stream."""
    return F.md5(F.concat_ws("|", "server_id", "rule_id", "state", F.col("tick_us").cast("string")))


def _path_by_doubling(b: DataFrame, nxt: DataFrame, rounds: int) -> DataFrame:
    """Fired runs by pointer doubling: jump tables J_k = next^(2^k) by
    self-joins, then the path set grown from the first run through
    J_K .. J_0; every step is a distributed join."""
    first = b.groupBy(*RULE).agg(F.min("run").alias("i"))
    jumps = [nxt]
    for _ in range(rounds):
        j = jumps[-1]
        comp = (j.alias("a").join(j.alias("b"), (F.col("a.server_id") == F.col("b.server_id"))
                                  & (F.col("a.rule_id") == F.col("b.rule_id")) & (F.col("a.j") == F.col("b.i")))
                .select(F.col("a.server_id").alias("server_id"), F.col("a.rule_id").alias("rule_id"),
                        F.col("a.i").alias("i"), F.col("b.j").alias("j")))
        jumps.append(cut_lineage(comp))
    path = first
    for k, j in enumerate(reversed(jumps)):
        step = path.join(j, [*RULE, "i"], "inner").select(*RULE, F.col("j").alias("i"))
        path = path.unionByName(step).distinct()
        if k % 3 == 2:      # bound the plan depth; jump tables are already cut
            path = cut_lineage(path)
    return path.withColumnRenamed("i", "run")
