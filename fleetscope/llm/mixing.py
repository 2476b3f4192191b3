"""Mixing sources to target weights by iterative proportional fitting.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import prepare, stored

MARGINS = ("source", "lang", "topic")
#: Targets are a margin's token shares to this power, scaled to one.
POWER = 0.7
#: Sweeps over the margins, and steps of a cap.
SWEEPS, CAP_STEPS = 8, 8
#: A cell's factor counts as one from here on: cells that must give all they
#: have come to one but for the last digits, which depend on the order of sums.
FULL = 1 - 1e-9
#: Share of all tokens that the sample should hold.
BUDGET = 0.6
SEED = "mix"
#: Name of a margin's missing value.
NONE = "(none)"


def text_column() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _count(text: Column, char: str) -> Column:
    """How often a one-byte character is there: by bytes and replace, which take
    a fraction of the time of lengths in characters and translate."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(char), F.lit("")))


def token_weight() -> Column:
    """Words between runs of blanks, tabs and line ends; texts of nothing else
    have none."""
    t = F.btrim(F.regexp_replace(text_column(), "[ \\n\\t]+", " "))
    return F.when(F.octet_length(t) == 0, 0).otherwise(_count(t, " ") + 1).cast("long")


def topic_of() -> Column:
    """A coarse topic from the form of the text: the first that fits of empty,
    notice (speaks of a licence or copyright), contact (an address), table
    (column bars), list (lines under 60 characters on average) and prose."""
    t = text_column()
    lines = _count(t, "\n") + 1
    return (F.when(F.length(t) == 0, "empty")
            .when(F.contains(t, F.lit("icense")) | F.contains(t, F.lit("opyright")), "notice")
            .when(F.contains(t, F.lit("@")), "contact").when(F.contains(t, F.lit(" | ")), "table")
            .when(F.length(t) < 60 * lines, "list").otherwise("prose"))


def uniform(seed: str) -> Column:
    """A number in [0, 1) from the doc_id and nothing else; a row without one
    draws by its text."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit(NONE), text_column()))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), name), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """(margin, target): token shares to a power, scaled to one; a value without
    tokens has target zero."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("t"))
    scaled = sums.select(margin, F.when(F.col("t") > 0, F.pow("t", F.lit(power))).otherwise(0.0).alias("t"))
    total = scaled.agg(F.sum("t")).first()[0] or 1.0
    return scaled.select(margin, (F.col("t") / total).alias("target"))


def cap_scale(values: DataFrame, budget: float, steps: int = CAP_STEPS) -> float:
    """The factor s at which min(tokens, s * w) sums to ``budget`` tokens: values
    that reach their tokens drop out, step by step, one row a step."""
    s = 0.0
    for _ in range(steps):
        full = F.col("w") * s >= F.col("tokens")
        row = values.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("used"),
                         F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("free")).first()
        if not row["free"]:
            break
        before, s = s, max(s, (budget - float(row["used"])) / row["free"])
        if s == before:
            break
    return s


def goals(cells: DataFrame, targets: dict[str, DataFrame], budget: float) -> dict[str, DataFrame]:
    """margin -> (value, goal in tokens, target): the target shares of the
    budget, where no value's goal exceeds the tokens it has; what such a value
    cannot give the others take in the ratio of their targets.  A value without
    target has goal zero.  If the values with a target hold less than the
    budget in some margin, all margins come down to that."""
    sums = {}
    for m in MARGINS:
        have = cells.groupBy(m).agg(F.sum("tokens").alias("tokens"))
        sums[m] = stored(have.join(targets[m].select(m, F.col("target").alias("w")), m, "left")
                         .select(m, "tokens", F.coalesce("w", F.lit(0.0)).alias("w")), "goals")
    tokens = [s.agg(F.sum("tokens").alias("all"), F.sum(F.when(F.col("w") > 0, F.col("tokens"))).alias("reach")).first()
              for s in sums.values()]
    budget = min([budget * float(tokens[0]["all"] or 0), *[float(t["reach"] or 0) for t in tokens]])
    return {m: s.select(m, F.least(F.col("tokens").cast("double"), F.col("w") * cap_scale(s, budget)).alias(f"goal_{m}"),
                        F.col("w").alias(f"target_{m}")) for m, s in sums.items()}


def rake(cells: DataFrame, targets: dict[str, DataFrame], budget: float = BUDGET, sweeps: int = SWEEPS) -> DataFrame:
    """``cells`` (margins, tokens) with their ``goals`` and ``f``, one factor per
    margin value multiplied, so that min(tokens, f * tokens) sums to every
    margin's goals: the caps are part of the fit.  A step scales the cells of a
    value that are not full to what the full ones leave of its goal, or all of
    them if these alone exceed it.  A margin is one sum and one join over the
    stored cells: plans that chained them would read the cells twice as often
    with every margin, and weigh on the driver."""
    fitted = cells.withColumn("f", F.lit(float(budget)))
    for m, goal in goals(cells, targets, budget).items():
        fitted = fitted.join(goal, m)
    columns = [*MARGINS, "tokens", *[f"{k}_{m}" for m in MARGINS for k in ("goal", "target")]]
    fitted = stored(fitted.select(*columns, "f"), "raked")
    full, tokens = F.col("f") >= FULL, F.col("tokens").cast("double")
    for _ in range(sweeps):
        for m in MARGINS:
            goal = F.col(f"goal_{m}")
            sums = fitted.groupBy(m).agg(F.sum(F.when(full, tokens).otherwise(0.0)).alias("fixed"),
                                         F.sum(F.when(full, 0.0).otherwise(tokens * F.col("f"))).alias("free"))
            scale = (F.when((goal > F.col("fixed")) & (F.col("free") > 0), (goal - F.col("fixed")) / F.col("free"))
                     .when(F.col("fixed") + F.col("free") > 0, goal / (F.col("fixed") + F.col("free"))).otherwise(1.0))
            fitted = stored(fitted.join(sums, m).select(*columns, (F.col("f") * scale).alias("f")), "raked")
    return fitted


def fit(docs: DataFrame, budget: float = BUDGET, power: float = POWER, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The raked cells of ``docs``, for ``mixture`` and ``margin_report``."""
    prepare(docs.sparkSession)
    cells = stored(_with_margins(docs).groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    return rake(cells, {m: tempered(cells, m, power) for m in MARGINS} | (targets or {}), budget)


def margin_report(fitted: DataFrame) -> DataFrame:
    """(margin, value, tokens, target, goal, expected): the share asked for, the
    feasible goal in tokens, and the tokens that the sample holds on average;
    ``expected - goal`` is the residual of the fit."""
    parts = [fitted.groupBy(F.lit(m).alias("margin"), F.col(m).alias("value")).agg(
        F.sum("tokens").alias("tokens"), F.first(f"target_{m}").alias("target"), F.first(f"goal_{m}").alias("goal"),
        F.sum(F.least(F.lit(1.0), F.col("f")) * F.col("tokens")).alias("expected")) for m in MARGINS]
    return parts[0].union(parts[1]).union(parts[2])


def _with_margins(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text",
                       F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("source"),
                       F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang"))
    return rows.withColumn("topic", topic_of()).withColumn("n_tokens", token_weight())


def mixture(docs: DataFrame, budget: float = BUDGET, power: float = POWER,
            targets: dict[str, DataFrame] | None = None, seed: str = SEED, fitted: DataFrame | None = None) -> DataFrame:
    """Every row of ``docs`` with ``topic``, ``n_tokens``, ``probability`` and
    ``kept``, under struct ``row`` its own columns.

    Tokens are summed by cell (source, language, topic), combined on the map
    side, so a hot source is a few rows.  The cells are raked, none beyond its
    tokens, to the goals: the targets, given as (value, target) tables or
    tempered shares, of the token budget, as far as each value's tokens go
    (``fitted``: the cells of an earlier ``fit``).  A document stays if a
    uniform number from its doc_id is below its cell's probability: repeated
    rows stay or go together; rows without an id draw by their text.  Nulls in
    source or language are a value of their own; null and empty texts have no
    tokens, topic ``empty`` and, their cells having no tokens to rake,
    probability one, as has any cell without tokens; an empty table gives no
    rows."""
    fitted = fit(docs, budget, power, targets) if fitted is None else fitted
    chance = fitted.select(*MARGINS, F.when(F.col("tokens") > 0, F.least(F.lit(1.0), "f")).otherwise(1.0).alias("probability"))
    rows = _with_margins(docs).withColumn("draw", uniform(seed)).drop("text")
    return (rows.join(chance, list(MARGINS)).select(
        "row", "doc_id", *MARGINS, "n_tokens", "probability", (F.col("draw") < F.col("probability")).alias("kept")))


def mixture_sql(documents: str = "documents", budget: float = BUDGET, power: float = POWER, seed: str = SEED) -> str:
    """The same in SQL, unrolled: (doc_id, source, lang, topic, n_tokens,
    probability, kept)."""
    words = r"trim(regexp_replace(text, '[ \n\t]+', ' ', 'g'), ' ')"
    lines = "(length(text) - length(replace(text, chr(10), '')) + 1)"
    parts = [f"""d AS (
  SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, coalesce(text, '') AS text
  FROM {documents})""", f"""r AS (
  SELECT doc_id, source, lang,
         CASE WHEN length(text) = 0 THEN 'empty'
              WHEN contains(text, 'icense') OR contains(text, 'opyright') THEN 'notice'
              WHEN contains(text, '@') THEN 'contact' WHEN contains(text, ' | ') THEN 'table'
              WHEN length(text) < 60 * {lines} THEN 'list' ELSE 'prose' END AS topic,
         CAST(CASE WHEN length(words) = 0 THEN 0 ELSE length(words) - length(replace(words, ' ', '')) + 1 END AS BIGINT) AS n_tokens,
         CASE WHEN doc_id IS NULL THEN '{NONE}' || text ELSE CAST(doc_id AS VARCHAR) END AS name
  FROM (SELECT *, {words} AS words FROM d))""", f"""f0 AS (
  SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens, CAST({budget} AS DOUBLE) AS f
  FROM r GROUP BY ALL)"""]
    for m in MARGINS:
        parts += [f"t_{m} AS (SELECT {m}, sum(tokens) AS tokens, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {power}) ELSE 0 END AS t FROM f0 GROUP BY {m})",
                  f"w_{m} AS MATERIALIZED (SELECT {m}, tokens, CASE WHEN sum(t) OVER () > 0 THEN t / sum(t) OVER () ELSE 0 END AS w FROM t_{m})",
                  f"s_{m}_0 AS (SELECT CAST(0 AS DOUBLE) AS s)"]
        for i in range(CAP_STEPS):
            parts.append(f"""s_{m}_{i + 1} AS MATERIALIZED (
  SELECT greatest(any_value(s), coalesce(
           ({budget} * sum(tokens) - sum(CASE WHEN w * s >= tokens THEN tokens ELSE 0 END))
           / nullif(sum(CASE WHEN w * s >= tokens THEN 0 ELSE w END), 0), any_value(s))) AS s
  FROM w_{m}, s_{m}_{i})""")
        parts.append(f"g_{m} AS MATERIALIZED (SELECT {m}, least(tokens, w * s) AS goal FROM w_{m}, s_{m}_{CAP_STEPS})")
    n = 0
    for _ in range(SWEEPS):
        for m in MARGINS:
            parts.append(f"""f{n + 1} AS MATERIALIZED (
  SELECT source, lang, topic, tokens,
         f * CASE WHEN goal > fixed AND free > 0 THEN (goal - fixed) / free
                  WHEN fixed + free > 0 THEN goal / (fixed + free) ELSE 1 END AS f
  FROM (SELECT f.*, g.goal, sum(CASE WHEN f.f >= {FULL!r} THEN f.tokens ELSE 0 END) OVER (PARTITION BY f.{m}) AS fixed,
               sum(CASE WHEN f.f >= {FULL!r} THEN 0 ELSE f.tokens * f.f END) OVER (PARTITION BY f.{m}) AS free
        FROM f{n} f JOIN g_{m} g USING ({m})))""")
            n += 1
    u = f"CAST(('0x' || substr(sha256('{seed}:' || name), 1, 12)) AS BIGINT) / 281474976710656.0"
    return "WITH " + ",\n".join(parts) + f""",
p AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN least(1.0, f) ELSE 1.0 END AS probability FROM f{n})
SELECT doc_id, source, lang, topic, n_tokens, round(probability, 6) AS probability, {u} < probability AS kept
FROM r JOIN p USING (source, lang, topic)
"""
