"""Times kept as text: parsing, rendering and differences (all in UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
OFFSET = r"(?i)(z|utc|[+-]\d{2}:?\d{2}|[+-]\d{2})$"


def instant(col: Column) -> Column:
    """Timestamp of an ISO-like text; a text without an offset is UTC; null if unreadable.

    The result does not depend on the session time zone.
    """
    text = F.trim(col)
    timed = F.when(text.rlike(OFFSET), text).otherwise(F.concat(text, F.lit("Z")))
    return _cast(F.when(text.rlike(r"\d:\d"), timed).otherwise(F.concat(text, F.lit("T00:00:00Z"))))


def _cast(col: Column) -> Column:
    return col.try_cast("timestamp")


def strict_instant(col: Column) -> Column:
    """Only ``YYYY-MM-DDTHH:MM:SSZ``; anything else (fractions too) is null."""
    return F.when(col.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"), _cast(col))


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 with their fraction."""
    return F.unix_micros(ts) / F.lit(1e6)


def month_utc(ts: Column) -> Column:
    """``YYYY-MM`` in UTC whatever the session time zone is."""
    days = F.floor(F.unix_seconds(ts) / F.lit(86400)).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM")


def hours_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / F.lit(3.6e9)


def days_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / F.lit(86400e6)


def iso(ts: Column) -> Column:
    """Render seconds as ``YYYY-MM-DDTHH:MM:SSZ`` (the session must run in UTC)."""
    return F.date_format(ts, ISO)
