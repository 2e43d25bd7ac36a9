"""Time expressions that do not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 of a naive timestamp, read as UTC."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), c.cast("timestamp_ntz"))


def day_number(ts: Column | str) -> Column:
    """Days since 1970-01-01 (int) of a naive timestamp."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_date(c.cast("date"))


def gap(unit: str, earlier: Column, later: Column) -> Column:
    """Whole units between two timestamps, truncated toward zero."""
    return F.timestamp_diff(unit, earlier, later)


def iso_weekday(ts: Column | str) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(ts) + 1
