"""Registered log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.functions import logtext
from fleetscope.operators import logs as L
from fleetscope.plans.catalog import register
from fleetscope.sources import bindings as B

_SEV = " ".join(f"WHEN regexp_matches(upper(line), '{pat}') THEN '{name}'"
                for name, pat in logtext.SEVERITY_CLASSES)
SEVERITY_SQL = f"CASE {_SEV} ELSE 'other' END"


@register("T1_log_history_200", """
SELECT server_id, log_file, ts, line FROM (
  SELECT *, row_number() OVER (PARTITION BY server_id, log_file ORDER BY ts DESC, seq DESC) AS rn FROM logs)
WHERE rn <= 200""")
def t1(spark, d):
    return L.log_history(B.logs(spark, d), 200).select("server_id", "log_file", "ts", "line")


@register("P3_logs_since", """
SELECT server_id, log_file, ts, line FROM logs WHERE ts > TIMESTAMP '2024-01-30 20:00:00'""")
def p3(spark, d):
    return L.logs_since(B.logs(spark, d), "2024-01-30 20:00:00").select("server_id", "log_file", "ts", "line")


@register("P6_log_search", """
SELECT server_id, log_file, ts, line FROM logs WHERE contains(lower(line), lower('INVALID user'))""")
def p6(spark, d):
    return L.search(B.logs(spark, d), "INVALID user").select("server_id", "log_file", "ts", "line")


@register("F4_log_severity_counts", f"""
SELECT server_id, {SEVERITY_SQL} AS severity, count(*) AS n FROM logs GROUP BY ALL""")
def f4(spark, d):
    return L.with_severity(B.logs(spark, d)).groupBy("server_id", "severity").agg(F.count(F.lit(1)).alias("n"))


_DOC_LINES = r"""
, dl AS (SELECT doc_id, lang, regexp_replace(unnest(string_split(text, chr(10))), '[\r\n]+$', '') AS line
         FROM documents),
lines AS (SELECT * FROM dl WHERE line <> '')"""


@register("F4_F24_document_line_severity", _DOC_LINES + f"""
SELECT lang, {SEVERITY_SQL} AS severity, count(*) AS n FROM lines GROUP BY ALL""")
def f4_docs(spark, d):
    docs = B.read_table(spark, d, "documents")
    lines = L.text_lines(docs, "doc_id", keep=["lang"])
    return (lines.withColumn("severity", logtext.severity("line"))
            .groupBy("lang", "severity").agg(F.count(F.lit(1)).alias("n")))


@register("P6_document_line_search", _DOC_LINES + """
SELECT lang, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM lines
WHERE contains(lower(line), lower('The')) GROUP BY lang""")
def p6_docs(spark, d):
    docs = B.read_table(spark, d, "documents")
    hits = L.search(L.text_lines(docs, "doc_id", keep=["lang"]), "The")
    return hits.groupBy("lang").agg(F.count(F.lit(1)).alias("n_lines"),
                                    F.count_distinct("doc_id").alias("n_docs"))


@register("U1_live_tail_union", """
SELECT server_id, log_file, ts, line FROM (
  SELECT *, row_number() OVER (PARTITION BY server_id, log_file ORDER BY ts DESC, seq DESC) AS rn
  FROM (SELECT * FROM logs WHERE ts <= TIMESTAMP '2024-01-30 22:00:00'
        UNION ALL SELECT * FROM logs WHERE ts > TIMESTAMP '2024-01-30 22:00:00'))
WHERE rn <= 2000""")
def u1(spark, d):
    lg = B.logs(spark, d)
    cut = F.to_timestamp(F.lit("2024-01-30 22:00:00"))
    return (L.live_view(lg.filter(F.col("ts") <= cut), lg.filter(F.col("ts") > cut), 2000)
            .select("server_id", "log_file", "ts", "line"))


@register("S18_F11_log_export_lines", """
SELECT server_id, log_file, ts,
       '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z] [' || log_file || '] ' || line AS value
FROM logs""")
def s18(spark, d):
    return L.export_text(B.logs(spark, d))


@register("P10_F21_watched_logs", """
SELECT server_id, path,
       CASE WHEN starts_with(path, '/var/log/') THEN substr(path, 10) ELSE regexp_extract(path, '[^/]*$') END
         AS log_name
FROM (SELECT server_id, unnest(['/var/log/auth.log', '/var/log/syslog', '/opt/app/logs/app.log']) AS path
      FROM heartbeats)""")
def p10(spark, d):
    return L.watched_logs(B.heartbeats(spark, d))
