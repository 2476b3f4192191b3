"""Login-line predicates, extractors and the classifier (pure Catalyst)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: the patterns the login reports are defined by -----------
FAILED_LOGIN = r"Failed password|Invalid user"
IP_PATTERN = r"from (\S+) port"
USER_PATTERN = r"for (?:invalid user )?(\S+) from"
INVALID_USER_PATTERN = r"Invalid user (\S+) from"
CLASSES = [
    # (pattern, type, action, result) -- first match wins, in this order
    (r"Failed password for (?:invalid user )?(\S+) from (\S+) port", "SSH", "Failed Login", "Blocked"),
    (r"Invalid user (\S+) from (\S+)", "SSH", "Invalid User", "Dropped"),
    (r"Accepted (?:publickey|password) for (\S+) from (\S+)", "AUTH", "Login Accepted", "Success"),
    (r"Connection closed by (?:authenticating user |invalid user )?(\S+) (\S+) port", "SSH",
     "Connection Closed", "Dropped"),
]
AUTH_LOG = "auth.log"
# -----------------------------------------------------------------------------


def failed_login(line: Column | str = "line") -> Column:
    """Line is a failed or invalid-user login attempt."""
    return F.col(line).rlike(FAILED_LOGIN) if isinstance(line, str) else line.rlike(FAILED_LOGIN)


def _c(line: Column | str) -> Column:
    return F.col(line) if isinstance(line, str) else line


def attacker_ip(line: Column | str = "line") -> Column:
    """``from <ip> port``; '' when absent (kept: '' counts as a value)."""
    return F.regexp_extract(_c(line), IP_PATTERN, 1)


def target_user(line: Column | str = "line") -> Column:
    """user of a failed login, NULL when neither pattern yields one."""
    l_ = _c(line)
    return F.coalesce(F.nullif(F.regexp_extract(l_, USER_PATTERN, 1), F.lit("")),
                      F.nullif(F.regexp_extract(l_, INVALID_USER_PATTERN, 1), F.lit("")))


def classify(line: Column | str = "line") -> Column:
    """struct(type, action, username, source_ip, result) of the first
    matching class, NULL when no class matches."""
    l_ = _c(line)
    out = None
    for pat, typ, action, result in CLASSES:
        s = F.struct(F.lit(typ).alias("type"), F.lit(action).alias("action"),
                     F.regexp_extract(l_, pat, 1).alias("username"),
                     F.regexp_extract(l_, pat, 2).alias("source_ip"),
                     F.lit(result).alias("result"))
        out = F.when(l_.rlike(pat), s) if out is None else out.when(l_.rlike(pat), s)
    return out


def is_private_ip(ip: Column | str = "ip") -> Column:
    """F19 (second half): private address by prefix."""
    c = _c(ip)
    return c.startswith("10.") | c.startswith("192.168.")


def attacker_severity(attempts: Column | str = "attempts") -> Column:
    """>=500 critical, >=100 attention, else ok."""
    a = _c(attempts)
    return F.when(a >= 500, "critical").when(a >= 100, "attention").otherwise("ok")
