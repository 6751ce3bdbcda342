"""Time expressions. The session time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND_FORMAT = "yyyy-MM-dd HH:mm:ss"


def utc(value: Column) -> Column:
    """Strings (ISO 8601, with or without zone) and zone-less timestamps as UTC instants."""
    return value.cast("timestamp")


def parse_strict(value: Column) -> Column:
    """A malformed value raises (ANSI mode)."""
    return F.to_timestamp(value)


def parse_coerce(value: Column) -> Column:
    """A malformed value becomes null."""
    return F.try_to_timestamp(value)


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def second_text(ts: Column) -> Column:
    return F.date_format(ts, SECOND_FORMAT)


def in_window(at: Column, after, until=None) -> Column:
    """after < at <= until; ``until`` may be open."""
    cond = at > F.lit(after).cast("timestamp")
    return cond if until is None else cond & (at <= F.lit(until).cast("timestamp"))
