"""Log operators: history tail, since-reads, search, severity, live-tail
union, export, and a line view of free text (T1, P3, P6, F4, U1, S18, P10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import logtext
from fleetscope.operators.dedup import newest_n
from fleetscope.operators.series import ts_lit

LOG_KEY = ["server_id", "log_file"]


def _tiebreak(logs: DataFrame) -> list[str] | None:
    return ["seq"] if "seq" in logs.columns else None


def log_history(logs: DataFrame, lines: int = 200) -> DataFrame:
    """Newest N lines (1..2000, default 200) per (server, file); present
    oldest first with ``orderBy('ts')``."""
    if not 1 <= lines <= 2000:
        raise ValueError("lines must be within 1..2000")
    return newest_n(logs, LOG_KEY, "ts", lines, _tiebreak(logs))


def logs_since(logs: DataFrame, since_ts) -> DataFrame:
    """Lines strictly newer than ``since_ts``."""
    return logs.filter(F.col("ts") > ts_lit(since_ts))


def search(logs: DataFrame, query: str) -> DataFrame:
    """Case-insensitive literal substring filter."""
    return logs.filter(logtext.contains_ci("line", query)) if query else logs


def with_severity(logs: DataFrame) -> DataFrame:
    """F4 as a column."""
    return logs.withColumn("severity", logtext.severity("line"))


def live_view(history: DataFrame, live: DataFrame, keep: int = 2000) -> DataFrame:
    """History UNION ALL live tail, newest ``keep`` per (server, file)."""
    return newest_n(history.unionByName(live), LOG_KEY, "ts", keep, _tiebreak(history))


def export_text(logs: DataFrame) -> DataFrame:
    """``[ts] [file] line`` rows; write with ``df.write.text``."""
    return logs.select(*LOG_KEY, "ts", logtext.export_line("ts", "log_file", "line").alias("value"))


def text_lines(docs: DataFrame, id_col: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Whole texts as log lines: split on newlines (F24 cleanup: trailing CR
    removed, empty lines dropped), with the line number."""
    keep = keep or []
    x = docs.select(id_col, *keep, F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "raw"))
    return (x.withColumn("line", logtext.clean_line("raw")).drop("raw")
            .filter(F.col("line") != ""))


def watched_logs(heartbeats: DataFrame) -> DataFrame:
    """P10 + F21: watched files per server from the latest heartbeat."""
    return (heartbeats.select("server_id", F.explode_outer("watched_logs").alias("path"))
            .withColumn("log_name", logtext.log_name("path")))
