"""Log-line scalar functions: severity, search, names, cleanup, export."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: severity keyword classes, first match wins --------------
SEVERITY_CLASSES = [
    ("critical", r"\b(CRIT|CRITICAL|FATAL|EMERG|ALERT)\b"),
    ("error", r"\b(ERROR|ERR)\b"),
    ("warn", r"\bWARN(ING)?\b"),
    ("info", r"\bINFO\b"),
    ("debug", r"\bDEBUG\b"),
]
# every keyword of the classes above contains one of these stems
SEVERITY_STEMS = ["CRIT", "FATAL", "EMERG", "ALERT", "ERR", "WARN", "INFO", "DEBUG"]
METRIC_NAME_RULE = r"^[a-z][a-z0-9_]*[a-z0-9]$"
LOG_ROOT = "/var/log/"
# -----------------------------------------------------------------------------


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


_WORD = "[A-Za-z0-9_]"


def _ascii_bounds(pattern: str) -> str:
    """Word boundaries over ASCII word characters only (Java's ``\\b`` also
    treats accented letters as word characters; the classes are defined with
    ASCII ones).  Each class pattern is ``\\b<keywords>\\b`` with keywords
    that start and end with a word character, so the boundaries are a
    look-behind and a look-ahead."""
    assert pattern.startswith("\\b") and pattern.endswith("\\b")
    return f"(?<!{_WORD})" + pattern[2:-2] + f"(?!{_WORD})"


def severity(line: Column | str = "line") -> Column:
    """severity class of a log line (upper-cased, word-bounded)."""
    u = F.upper(_c(line))
    classes = [(name, _ascii_bounds(pat)) for name, pat in SEVERITY_CLASSES]
    # cheap substring test first: most lines hold no keyword stem and never
    # reach a regex
    maybe = None
    for stem in SEVERITY_STEMS:
        hit = F.contains(u, F.lit(stem))
        maybe = hit if maybe is None else (maybe | hit)
    out = F.when(~maybe, F.lit("other"))
    for name, pat in classes:
        out = out.when(u.rlike(pat), F.lit(name))
    return out.otherwise(F.lit("other"))


def contains_ci(line: Column | str, query: str) -> Column:
    """Case-insensitive literal substring match (not LIKE, not regex)."""
    return F.contains(F.lower(_c(line)), F.lower(F.lit(query)))


def valid_metric_name(name: Column | str = "metric_name") -> Column:
    """Metric naming rule; NULL/empty names are invalid.  The rule's
    ``$`` means end of text (Java's ``$`` would also accept a trailing
    newline), hence ``\\z``."""
    c = _c(name)
    return F.coalesce(c.rlike(METRIC_NAME_RULE[:-1] + r"\z"), F.lit(False))


def log_name(path: Column | str = "path") -> Column:
    """strip the /var/log/ root, else keep the base name."""
    p = _c(path)
    return F.when(p.startswith(LOG_ROOT), F.substr(p, F.lit(len(LOG_ROOT) + 1))) \
        .otherwise(F.substring_index(p, "/", -1))


def clean_line(line: Column | str = "line") -> Column:
    """drop trailing CR/LF (a trim, no regex); callers filter empty
    results."""
    return F.rtrim(_c(line), F.lit("\r\n"))


def utc_iso(ts: Column | str = "ts") -> Column:
    """ISO-8601 UTC with milliseconds and a Z suffix."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def export_line(ts: Column | str = "ts", log_file: Column | str = "log_file",
                line: Column | str = "line") -> Column:
    """``[ts] [file] line`` text form of a log row."""
    return F.concat(F.lit("["), utc_iso(ts), F.lit("] ["), _c(log_file), F.lit("] "), _c(line))
