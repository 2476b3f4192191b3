"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm import (decontaminate, hard_negatives, license_scan, lm_quality, mixing, prefix_trie, sentence_dedup,
                            sharding, simhash_dups, suffix_dedup, token_cache, topk_search, url_filter)
from fleetscope.llm.common import prepare, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn
    return put


@register("op1_token_counts")
def op1(spark, sf_dir):
    import public_tokenizers
    return token_cache.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


OP2_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@register("op2_topk_search", OP2_SQL)
def op2(spark, sf_dir):
    v = topk_search.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk_search.top_k(v.where(F.col("vec_id") % 50 == 0), v, 5)


@register("op3_mix_sources", mixing.mixture_sql())
def op3(spark, sf_dir):
    return (mixing.mixture(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
            .select("doc_id", *mixing.MARGINS, "n_tokens", F.round("probability", 6).alias("probability"), "kept"))


@register("op4_url_filter")
def op4(spark, sf_dir):
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), url_filter.seed_table(spark))


@register("op5_decontamination")
def op5(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# A sentence ends after . ! or ? before a blank and after a line end; blank
# pieces join the sentence before them (or the first one).  Every sentence of a
# run has a word, so a run is at most as many sentences as its word floor.
OP6_SQL = r"""
WITH pieces AS (
  SELECT doc_id, unnest(cut) AS piece, generate_subscripts(cut, 1) AS pos
  FROM (SELECT doc_id, string_split(replace(regexp_replace(coalesce(text, ''), '([.!?])([ \t\r\n])', '\1' || chr(1) || '\2', 'g'),
                                            chr(10), chr(10) || chr(1)), chr(1)) AS cut FROM documents)),
marked AS (
  SELECT doc_id, piece, pos, greatest(1, sum(CASE WHEN regexp_matches(piece, '[^ \t\n\r\x0b\f]') THEN 1 ELSE 0 END)
                                        OVER (PARTITION BY doc_id ORDER BY pos)) AS i
  FROM pieces WHERE piece <> ''),
sentences AS (SELECT doc_id, i, string_agg(piece, '' ORDER BY pos) AS sentence FROM marked GROUP BY doc_id, i),
plain AS (
  SELECT *, translate(trim(regexp_replace(sentence, '[ \t\n\r\x0b\f]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                      'abcdefghijklmnopqrstuvwxyz') AS words FROM sentences),
counted AS (SELECT *, CASE WHEN words = '' THEN 0 ELSE length(words) - length(replace(words, ' ', '')) + 1 END AS n FROM plain),
ahead AS (
  SELECT doc_id, i, list(words) OVER o AS texts, list(n) OVER o AS ns
  FROM counted WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {following} FOLLOWING)),
ends AS (SELECT *, list_filter(range({length}, len(ns) + 1), lambda k: list_sum(ns[1:k]) >= {words})[1] AS k FROM ahead),
again AS (
  SELECT doc_id, i, k FROM (SELECT doc_id, i, k, row_number() OVER (PARTITION BY array_to_string(texts[1:k], chr(10)) ORDER BY doc_id, i) AS nth
                            FROM ends WHERE k IS NOT NULL) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, k)) AS i FROM again),
kept AS (
  SELECT s.doc_id, count(*) AS n_sentences, count(g.i) AS n_removed,
         coalesce(string_agg(sentence, '' ORDER BY s.i) FILTER (WHERE g.i IS NULL), '') AS text
  FROM sentences s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.i = s.i GROUP BY s.doc_id)
SELECT doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed, coalesce(k.text, '') AS text
FROM documents d LEFT JOIN kept k USING (doc_id)
""".replace("{following}", str(max(sentence_dedup.SENTENCES, sentence_dedup.WORDS) - 1)).replace(
    "{length}", str(sentence_dedup.SENTENCES)).replace("{words}", str(sentence_dedup.WORDS))


@register("op6_substring_dedup", OP6_SQL)
def op6(spark, sf_dir):
    return sentence_dedup.remove_repeated_sentences(table(spark, sf_dir, "documents"))


@register("op7_quality_classifier")
def op7(spark, sf_dir):
    return lm_quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), order=lm_quality.LONG_ORDER)


@register("op8_simhash_near_dedup")
def op8(spark, sf_dir):
    return simhash_dups.simhash_components(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


@register("op9_license_scan")
def op9(spark, sf_dir):
    return license_scan.licences(table(spark, sf_dir, "documents"))


# Bytes as pairs of hex digits; every window of 100 bytes is a row.
OP10_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d)),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM w) WHERE nth > 1),
steps AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM later),
spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b
  FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM steps) GROUP BY doc_id, span),
gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans),
cut AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
         string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(from_hex(CASE WHEN last IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""


@register("op10_suffix_array_dedup", OP10_SQL)
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_dedup.remove_repeats(docs, 100, with_text=False)
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


# Unsigned CRC-32 of a list of bytes, with the table built by its rule.
CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(CAST(n AS BIGINT), range(8)),
                          lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM range(256) r(n)))"""


def crc_sql(text: str) -> str:
    """SQL of the CRC-32 of a text; ``t`` is the column of ``crc_table``."""
    numbers = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {numbers}), lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295)"


# The trie by grouping paths; a path is the list of its turns' digests.
OP11_SQL = f"""
WITH {CRC_TABLE},
own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, {crc_sql('CAST(conv_id AS VARCHAR)')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM own), crc_table),
turns AS (
  SELECT c.conv_id, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.pos <= c.h
  UNION ALL
  SELECT c.conv_id, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h),
dealt AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS d,
         md5(octet_length(encode(role)) || ':' || role || text) AS m,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM turns),
members AS (
  SELECT conv_id, CAST(d AS INTEGER) AS depth, list(m) OVER (PARTITION BY conv_id ORDER BY d) AS path, words FROM dealt
  UNION ALL SELECT conv_id, 0, CAST([] AS VARCHAR[]), 0 FROM convs),
lengths AS (SELECT conv_id, max(depth) AS n FROM members GROUP BY conv_id),
nodes AS (
  SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = n), '') AS ends
  FROM members JOIN lengths USING (conv_id) GROUP BY path),
children AS (SELECT path[:-2] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (path)),
subtrees AS (
  SELECT path[:k] AS path, sum((n_convs - 1) * words) AS saved, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM counted) GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM counted n JOIN subtrees s USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[:-2]
"""


@register("op11_prefix_trie", OP11_SQL)
def op11(spark, sf_dir):
    turns = prefix_trie.turn_rows(table(spark, sf_dir, "conversations"))
    nodes = prefix_trie.prefix_trie(prefix_trie.keys(prefix_trie.rebuilt(prefix_trie.sequences(turns), 20, 4)))
    return nodes.withColumn("depth", F.col("depth").cast("long"))


OP12_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM scored WHERE same) WHERE nth <= 5),
found AS (
  SELECT p.*, n.vec_id AS negative_id, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
   AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM found WHERE rank <= 5
"""


@register("op12_hard_negatives", OP12_SQL)
def op12(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.labelled_vectors(table(spark, sf_dir, "embeddings").withColumn("label", label))
    found = hard_negatives.hard_negatives(rows, rows.where(F.col("vec_id") % 100 == 0), positives=5, k=5, low=80)
    return found.drop("negative_label")


OP13_SQL = f"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {crc_sql("coalesce(text, '')")} AS text_crc32
      FROM documents, crc_table),
p AS (SELECT *, sum(size) OVER () AS total,
             sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before,
             row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) AS place FROM d),
s AS (SELECT *, CAST(least(7, ((2 * before + size) * 8) // (2 * total)) AS INTEGER) AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       place - min(place) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""


@register("op13_sharding", OP13_SQL)
def op13(spark, sf_dir):
    return sharding.byte_shards(table(spark, sf_dir, "documents"), shards=8)
