"""Timestamp sniffing, minute buckets and ages. All times are UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the ISO-like stamp recognised inside free text.
ISO_STAMP = r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b"


def sniff_ts(line: Column) -> Column:
    """First ISO-like stamp in a raw line, or null."""
    found = F.regexp_extract(line, f"({ISO_STAMP})", 1)
    return F.when(found != "", found)


def to_ts(raw: Column) -> Column:
    """Parse an ISO-like stamp; null instead of an error on bad text."""
    return raw.try_cast("timestamp")


def minute_key(raw: Column) -> Column:
    """First 16 characters of the raw stamp, the textual minute bucket."""
    return F.left(raw, F.lit(16))


def minute(ts: Column) -> Column:
    return F.date_trunc("minute", ts)


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts)


def age_days(ts: Column, now: Column) -> Column:
    """Whole days elapsed between ts and now."""
    return F.floor((F.unix_micros(now) - F.unix_micros(ts)) / F.lit(86_400_000_000)).cast("int")


def recency_points(ts: Column, now: Column) -> Column:
    """10 within a day, 5 within a week, else 0."""
    days = (F.unix_micros(now) - F.unix_micros(ts)) / F.lit(86_400_000_000.0)
    return F.when(days <= 1, 10).when(days <= 7, 5).otherwise(0)
