"""Application logs: overview, error groups, top errors, rates, spikes, flaky tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates
from ..functions.text import contains_any, fingerprint
from ..rules import words
from .history import top_groups
from .spikes import spikes

# Levels that count as errors and warnings.
ERROR_LEVELS = ("error", "critical", "fatal")
WARN_LEVELS = ("warn", "warning")

# Signs of a retried test, and how a test is named in a log line.
RETRY_PATTERN = (
    r"(?i:rerun|retry|flaky|attempt \d+ of \d+|pass after retry|failed, will retry)"
)
TEST_NAME_PATTERN = (
    r"(?i)(?:✓|✗|FAIL|PASS|×|•)\s*[→>]\s*([^(]+)|(?:describe|it|test)\s*\(['\"]([^'\"]+)"
)


def is_error() -> Column:
    return F.lower(F.coalesce("level", F.lit(""))).isin(*ERROR_LEVELS)


def is_warning() -> Column:
    return F.lower(F.coalesce("level", F.lit(""))).isin(*WARN_LEVELS)


def log_overview(logs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Lines, errors, warnings and the first/last raw stamp (compared as text)."""
    stamp = F.when(F.length("ts_raw") > 0, F.col("ts_raw"))
    return logs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if(is_error()).alias("error_count"),
        F.count_if(is_warning()).alias("warn_count"),
        F.min(stamp).alias("first_ts"),
        F.max(stamp).alias("last_ts"),
    )


def is_critical(msg: Column) -> Column:
    return contains_any(F.lower(msg), words.CRITICAL_TERMS)


def severity(count: Column, critical: Column) -> Column:
    """high on a critical term or 50 occurrences, medium from 10, else low."""
    return F.when(critical | (count >= 50), "high").when(count >= 10, "medium").otherwise("low")


def error_groups(logs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Errors grouped by fingerprint with count, earliest example and severity.

    All aggregates merge on the map side, so one dominant fingerprint costs one row per task.
    """
    errs = logs.where(is_error()).withColumn("pattern", fingerprint(F.col("message")))
    return (
        errs.groupBy(*by, "pattern")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.min_by("message", "line").alias("example"),
            F.bool_or(is_critical(F.col("message"))).alias("_critical"),
        )
        .withColumn("severity", severity(F.col("count"), F.col("_critical")))
        .drop("_critical")
    )


def top_errors(logs: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent exact error messages."""
    return top_groups(logs.where(is_error()), ["message"], k, "count")


def frequency(logs: DataFrame) -> DataFrame:
    """Lines per textual minute of the raw stamp."""
    return (
        logs.where(F.length("ts_raw") > 0)
        .groupBy(dates.minute_key(F.col("ts_raw")).alias("minute"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def anomalies(logs: DataFrame, minutes: int = 5, threshold: float = 3.0) -> DataFrame:
    """Error spikes per service.

    For every error in time order (equal times by line): errors in the inclusive window that starts at it (later rows
    of the same instant only) against the mean of the up to 20 preceding counts, floor 1. Of a service's equal messages at
    one raw stamp the first counts. One pass in time order, see ``spikes``.
    """
    errs = logs.where(is_error() & F.col("ts").isNotNull()).select("service", dates.epoch_ms(F.col("ts")).alias("ms"), "line", "ts_raw", "message")
    found = spikes(errs, minutes * 60_000, threshold, int(logs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return (
        found.groupBy("service", "ts_raw", "message")
        .agg(F.min_by(F.struct("count", "baseline"), F.struct("at", "line")).alias("_f"))
        .select("service", "ts_raw", "message", "_f.count", "_f.baseline")
    )


def flaky_tests(lines: DataFrame, k: int = 100) -> DataFrame:
    """Distinct retry lines per test name, most first; unnamed lines are labelled file:line."""
    from ..sources.files import base_name

    file = base_name(F.col("path"))
    m = F.lit(TEST_NAME_PATTERN)
    named = F.trim(
        F.concat(F.regexp_extract("text", TEST_NAME_PATTERN, 1), F.regexp_extract("text", TEST_NAME_PATTERN, 2))
    )
    return (
        lines.where(F.col("text").rlike(RETRY_PATTERN))
        .select(
            file.alias("file"),
            F.when(F.regexp_like("text", m), named)
            .otherwise(F.concat_ws(":", file, F.col("line").cast("string"))).alias("test"),
            F.left("text", F.lit(80)).alias("head"),
        )
        .distinct()
        .groupBy("test")
        .agg(F.count(F.lit(1)).alias("failure_count"))
        .orderBy(F.col("failure_count").desc(), "test")
        .limit(k)
    )


def trace_summary(spans: DataFrame) -> DataFrame:
    """Spans and wall duration per trace; open ends count as 0."""
    return spans.where(F.col("trace_id").isNotNull() & (F.col("trace_id") != "")).groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("spans"),
        (F.coalesce(F.max("end_time"), F.lit(0.0)) - F.coalesce(F.min("start_time"), F.lit(0.0))).alias("duration"),
    )


