"""Streaming operators: streaming DataFrame in, streaming DataFrame out.

Late rows are dropped after the watermark (default ten minutes) and show up in the progress as
``numRowsDroppedByWatermark``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.debt import comment_items
from ..operators.logs import is_error
from ..operators.match import bug_findings
from ..operators.memory import topic_signals
from ..operators.sessions import counters, with_rates
from ..sources.files import to_lines, with_language

WATERMARK = "10 minutes"

# Baseline length, seconds between use and re-match that count as a failure, and
# failures a correction survives.
BASELINE = 20
REMATCH_SECONDS = 120
MAX_FAILURES = 3


def log_rate_stream(logs: DataFrame, width: str = "1 minute", watermark: str = WATERMARK) -> DataFrame:
    """Lines per tumbling window, emitted once the watermark has passed it (append mode)."""
    return (
        logs.withWatermark("ts", watermark).groupBy(F.window("ts", width).alias("w"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("w.start").alias("minute"), "count"))


def window_counts(logs: DataFrame, size: str, slide: str) -> DataFrame:
    """Rows per service and sliding window; the same expression serves batch and stream."""
    return (
        logs.groupBy("service", F.window("ts", size, slide).alias("w"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select("service", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "count"))


def window_count_stream(logs: DataFrame, size: str = "5 minutes", slide: str = "1 minute", watermark: str = WATERMARK) -> DataFrame:
    """Closed sliding windows with their error counts (append mode); errors drive the watermark."""
    return window_counts(logs.where(is_error()).withWatermark("ts", watermark), size, slide)


def anomaly_stream(counts: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Windows whose count exceeds threshold x the mean of the service's up to 20 preceding windows
    (floor 1), from a stream of closed windows as written by ``window_count_stream``.

    Raw errors are counted by the built-in aggregation of the first stage, so the keyed state only
    sees one row per window, whatever the traffic of a service.
    """

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("start")
        out = []
        for start, n in zip(rows["start"], rows["count"], strict=True):
            if past:
                mean = sum(past) / len(past)
                if n > threshold * max(mean, 1.0):
                    out.append((key[0], start, int(n), mean))
            past = [*past, int(n)][-BASELINE:]
        state.update((past,))
        yield pd.DataFrame(out, columns=["service", "start", "count", "baseline"]).astype(
            {"start": "datetime64[us]", "count": "int64", "baseline": "float64"})

    return counts.select("service", "start", "count").groupBy("service").applyInPandasWithState(
        judge, "service string, start timestamp, count bigint, baseline double", "past array<bigint>", "append",
        GroupStateTimeout.NoTimeout)


def candidate_stream(experiences: DataFrame, failures: DataFrame) -> DataFrame:
    """Running topic candidates (update mode): built-in aggregation state per topic, merged on the
    map side, so a dominant topic stays one small row per task."""
    return topic_signals(experiences, failures).groupBy("topic").agg(
        F.count(F.lit(1)).alias("confidence"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.min_by("context", F.struct("source", "ts", "id", "seq")).alias("context"))


def correction_decay_stream(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """(correction_id, ts, outcome) per match of events(correction_id, kind, ts).

    A match within two minutes of the last use counts a failure, more than three revoke the
    correction, a later match resets the count; idle time alone changes nothing. The state is
    three numbers per correction. A micro-batch's rows of one correction are ordered in memory, so
    bound the trigger's input (maxFilesPerTrigger / maxBytesPerTrigger).
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used, failed, revoked = state.get if state.exists else (-1, 0, False)
        out = []
        rows = pd.concat(list(batches)).sort_values(["us", "kind"])
        for us, kind in zip(rows["us"], rows["kind"], strict=True):
            if revoked:
                break
            if kind == "applied":
                used = int(us)
                continue
            near = used >= 0 and us - used < REMATCH_SECONDS * 1_000_000
            failed = failed + 1 if near else 0
            revoked = failed > MAX_FAILURES
            out.append((key[0], int(us), "revoked" if revoked else "failed" if near else "ok"))
        state.update((used, failed, revoked))
        yield pd.DataFrame(out, columns=["correction_id", "us", "outcome"]).astype({"us": "int64"})

    rows = events.withWatermark("ts", watermark).select("correction_id", "kind", "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("correction_id").applyInPandasWithState(
        step, "correction_id string, us bigint, outcome string", "used bigint, failed int, revoked boolean", "append",
        GroupStateTimeout.NoTimeout)


def dedup_stream(rows: DataFrame, key: str = "content_hash", ts: str = "created_at", watermark: str = WATERMARK) -> DataFrame:
    """First arrival per key within the watermark horizon; ``runs.start_dedup`` remembers every key."""
    return rows.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def session_metrics_stream(log: DataFrame, gap: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Session counters and rates per user and inactivity gap."""
    prompt = F.when(F.col("event") == "PROMPT", F.col("ts"))
    grouped = log.withWatermark("ts", watermark).groupBy("session", F.session_window("ts", gap).alias("w")).agg(
        *counters(), F.min(prompt).alias("first_prompt"), F.max(prompt).alias("last_prompt"))
    return with_rates(grouped.select(
        "session", F.col("w.start").alias("start"), F.col("w.end").alias("end"),
        *[c for c in grouped.columns if c not in ("session", "w")]))


def scan_stream(files: DataFrame, dialect: str = "todo") -> DataFrame:
    """Debt comments of newly arrived files; stateless."""
    return comment_items(to_lines(files), dialect)


def finding_stream(files: DataFrame) -> DataFrame:
    """Bug findings of newly arrived files; stateless."""
    return bug_findings(to_lines(with_language(files), "lang"))
