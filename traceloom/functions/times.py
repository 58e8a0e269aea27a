"""Epoch milliseconds from the forms that users and sources write; 0 or null where there is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _iso(text: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(text))


def parse_user_ts(text: Column) -> Column:
    """Digits over 1e10 are milliseconds, other digits seconds; a date is UTC midnight; else an ISO time, or null."""
    t = F.trim(text)
    n = t.try_cast("long")
    return F.when(t.rlike(r"^[0-9]+$"), F.when(n > 10_000_000_000, n).otherwise(n * 1000)).otherwise(_iso(t))


def parse_source_ts(text: Column) -> Column:
    """Numbers under 1e10 are seconds, others milliseconds; negative or unreadable ones are 0."""
    t = F.trim(text)
    n = t.try_cast("double").cast("long")
    return F.coalesce(F.when(t.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), F.when(n < 0, F.lit(0)).when(n < 10_000_000_000, n * 1000).otherwise(n)).otherwise(_iso(t)), F.lit(0)).cast("long")


def day(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def format_ts(ms: Column) -> Column:
    return F.when(ms > 0, F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("-")


def age(ms: Column, now_ms: int) -> Column:
    """Minutes, hours, days, months or years before now."""
    m = F.greatest(F.lit(now_ms) - ms, F.lit(0)) / 60_000
    f = lambda per, unit: F.concat(F.floor(m / per).cast("string"), F.lit(unit))
    return F.when(ms <= 0, "-").when(m < 60, f(1, "m")).when(m < 1440, f(60, "h")).when(m < 43_200, f(1440, "d")).when(m < 525_600, f(43_200, "mo")).otherwise(f(525_600, "y"))
