"""Calendar and cyclic time features."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hour_fraction(ts: Column | str = "ts") -> Column:
    t = _c(ts)
    return F.hour(t) + F.minute(t) / 60.0 + F.second(t) / 3600.0


def hour_sin(ts: Column | str = "ts") -> Column:
    """sin(2*pi*(h + m/60 + s/3600)/24) with whole seconds."""
    return F.sin(F.lit(2 * math.pi) * hour_fraction(ts) / 24.0)


def hour_cos(ts: Column | str = "ts") -> Column:
    return F.cos(F.lit(2 * math.pi) * hour_fraction(ts) / 24.0)


def day_of_week(ts: Column | str = "ts") -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(ts))


def is_weekend(ts: Column | str = "ts") -> Column:
    return (F.weekday(_c(ts)) >= 5).cast("int")


def day_start(ts: Column | str = "ts") -> Column:
    """Start of the UTC day."""
    return F.date_trunc("day", _c(ts))


def month_key(ts: Column | str = "ts") -> Column:
    """``yyyyMM`` month partition key."""
    return F.date_format(_c(ts), "yyyyMM").cast("int")
