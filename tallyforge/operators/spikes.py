"""Error spikes as a sweep over signed events in time order.

The number of errors in the window that starts at an error is what a sweep knows there: an error at t opens the windows
that start from t - W on, and is seen no more once the sweep has passed it. So with one opening event per error, the
count at an error is the openings so far minus the errors so far, and its baseline the mean of the counts before it.

Events are range-partitioned by service and place, so one service may span any number of partitions, and one instant too. Each
partition tells in one row what its last service leaves behind (running sum and last counts); these rows, one a
partition, are chained in one task and handed back to the partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import pinned

#: Preceding counts that make a baseline.
DEPTH = 20
_EVENT = ("service", "at", "error", "line")
_TAIL = "pid int, first string, last string, single boolean, net long, tail array<long>"
_CARRY = "pid int, service string, net long, tail array<long>"
_SPIKE = "service string, at long, line long, ts_raw string, message string, count long, baseline double"


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, str | None]]:
    """``batch, from, to, service`` of the stretches of one service in sorted batches."""
    for batch in batches:
        services = batch.column("service")
        coded = services.dictionary_encode()
        codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(codes)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(codes)], strict=True):
            if b > a:
                yield batch, a, b, services[a].as_py()


def _counts(batch: pa.RecordBatch, a: int, b: int, net: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of the errors of a stretch, their counts, and the running sum after it."""
    error = batch.column("error").to_numpy(zero_copy_only=False)[a:b]
    running = net + np.cumsum(np.where(error, -1, 1))
    rows = np.flatnonzero(error)
    return rows + a, running[rows] + 1, int(running[-1])


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    first = service = None
    single, seen, net, tail = True, False, 0, np.zeros(0, np.int64)
    for batch, a, b, name in _stretches(batches):
        if not seen:
            first, seen = name, True
        elif name != service:
            single, net, tail = False, 0, np.zeros(0, np.int64)
        service = name
        _, counts, net = _counts(batch, a, b, net)
        tail = np.concatenate([tail, counts])[-DEPTH:]
    if seen:
        yield pa.RecordBatch.from_pydict(
            {"pid": pa.array([TaskContext.get().partitionId()], pa.int32()), "first": pa.array([first], pa.string()), "last": pa.array([service], pa.string()),
             "single": [single], "net": pa.array([net], pa.int64()), "tail": pa.array([tail.tolist()], pa.list_(pa.int64()))})


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each partition is handed: one row per partition, in order of partitions."""
    out: list[tuple] = []
    held: tuple | None = None
    for batch in batches:
        for r in batch.to_pylist():
            goes_on = held is not None and held[0] == r["first"]
            net, tail = (held[1], held[2]) if goes_on else (0, [])
            if goes_on:
                out.append((r["pid"], r["first"], net, tail))
            if r["single"]:
                held = (r["last"], net + r["net"], (tail + [x + net for x in r["tail"]])[-DEPTH:])
            else:
                held = (r["last"], r["net"], r["tail"])
    cols = list(zip(*out, strict=True)) or [[]] * 4
    yield pa.RecordBatch.from_arrays([
        pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.int64()))],
        names=["pid", "service", "net", "tail"])


def _spikes(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        service, seen, net, tail = None, False, 0, np.zeros(0, np.int64)
        for batch, a, b, name in _stretches(batches):
            if not seen:
                carry = batch.column("carry")[a].as_py()
                if carry is not None:
                    net, tail = carry["net"], np.array(carry["tail"], np.int64)
            elif name != service:
                net, tail = 0, np.zeros(0, np.int64)
            service, seen = name, True
            rows, counts, net = _counts(batch, a, b, net)
            if not len(rows):
                continue
            every = np.concatenate([tail, counts])
            sums = np.concatenate([[0], np.cumsum(every)])
            at = np.arange(len(tail), len(every))
            since = np.maximum(at - DEPTH, 0)
            had = at - since
            baseline = (sums[at] - sums[since]) / np.maximum(had, 1)
            high = (had > 0) & (counts > threshold * np.maximum(baseline, 1.0))
            tail = every[-DEPTH:]
            if high.any():
                picked = batch.take(pa.array(rows[high]))
                yield pa.RecordBatch.from_arrays(
                    [*(picked.column(c) for c in ("service", "at", "line", "ts_raw", "message")), pa.array(counts[high]), pa.array(baseline[high])],
                    names=["service", "at", "line", "ts_raw", "message", "count", "baseline"])

    return run


def spikes(errors: DataFrame, span_ms: int, threshold: float, partitions: int) -> DataFrame:
    """Errors(service, ms, line, ts_raw, message) whose forward count exceeds ``threshold`` times the mean (at least 1) of up
    to ``DEPTH`` counts before, with both."""
    def event(at, error):
        return F.struct(at.alias("at"), F.lit(error).alias("error"))

    events = errors.select(
        F.col("service").cast("string").alias("service"), F.col("line").cast("long").alias("line"), F.col("ts_raw").cast("string").alias("ts_raw"), "message",
        F.explode(F.array(event(F.col("ms") - span_ms, False), event(F.col("ms"), True))).alias("_e"))
    events = events.select(
        "service", "_e.at", "_e.error", F.when(F.col("_e.error"), F.col("line")).alias("line"),
        F.when(F.col("_e.error"), F.col("ts_raw")).alias("ts_raw"), F.when(F.col("_e.error"), F.col("message")).alias("message"))
    # both passes must see the same partitions, which bounds taken from samples alone would not promise
    sorted_ = pinned(events.repartitionByRange(partitions, *_EVENT).sortWithinPartitions(*_EVENT))
    tails = sorted_.select("service", "error").mapInArrow(_tails, _TAIL)
    # one row a partition, of at most DEPTH numbers
    carry = tails.repartition(1).sortWithinPartitions("pid").mapInArrow(_chained, _CARRY)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    dealt = sorted_.withColumns({"pid": F.spark_partition_id(), "_first": place == 0})
    handed = dealt.join(F.broadcast(carry.select("pid", F.struct("net", "tail").alias("carry"))), "pid", "left")
    return handed.select("service", "at", "error", "line", "ts_raw", "message", F.when(F.col("_first"), F.col("carry")).alias("carry")).mapInArrow(
        _spikes(threshold), _SPIKE)
