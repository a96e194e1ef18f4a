"""Weekday arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trading_days_before(anchor: Column, n: Column | int) -> Column:
    """The date ``n`` weekdays before ``anchor``; a weekend counts back from Monday."""
    n = n if isinstance(n, Column) else F.lit(int(n))
    day = F.weekday(anchor)
    monday_shift = F.when(day >= 5, 7 - day).otherwise(0)
    start = F.when(day >= 5, 0).otherwise(day)
    rest = n % 5
    back = F.floor(n / 5) * 7 + rest + F.when(rest > start, 2).otherwise(0)
    moved = F.date_sub(F.date_add(anchor, monday_shift.cast("int")), back.cast("int"))
    return F.when(n > 0, moved).otherwise(anchor)


def is_stale(as_of: Column, today: Column, max_trading_days: int = 2) -> Column:
    return as_of < trading_days_before(today, max_trading_days)


def business_days(start: Column, end: Column) -> Column:
    """Array of the weekdays from start to end."""
    return F.filter(F.sequence(start, end), lambda d: F.weekday(d) < 5)


def iso_date(text: Column) -> Column:
    return F.try_to_date(F.substring(text.cast("string"), 1, 10), "yyyy-MM-dd")


def time_bucket(ts: Column) -> Column:
    hour = F.hour(ts) + F.minute(ts) / 60.0
    return (
        F.when(hour < 10.5, "open").when(hour < 14.0, "midday").when(hour < 16.0, "close").otherwise("after")
    )
