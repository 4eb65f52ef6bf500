"""Running streams to completion and batch-triggered consolidation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..operators.history import distinct_first
from ..operators.memory import PROMOTE_AT, memory_candidates, promote
from ..session import scratch_path
from ..sources.sinks import exists


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Process all input available now into the shared folder and read the result.

    Update-mode results are written per batch with their batch number in ``batch_id``.
    """
    spark = stream.sparkSession
    out, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
        schema = stream.schema
    else:
        # replaying a batch overwrites its own folder, so a restart repeats nothing
        def write(df: DataFrame, batch: int) -> None:
            df.write.mode("overwrite").parquet(f"{out}/batch_id={batch}")

        query = writer.foreachBatch(write).start()
        schema = StructType([*stream.schema.fields, StructField("batch_id", IntegerType())])
    query.awaitTermination()
    return spark.read.schema(schema).parquet(out)


def start_consolidation(
    failures: DataFrame, folder: str, checkpoint: str, minimum: int = 5,
    consolidate: Callable[[DataFrame], DataFrame] | None = None, now: bool = True,
) -> StreamingQuery:
    """Collect failures and consolidate whenever at least ``minimum`` are unprocessed.

    Every batch lands in ``<folder>/pending/batch=<n>``; a consolidation covers the batches above
    the last consolidated one and writes ``<folder>/candidates/upto=<n>``. Both are overwritten
    when a batch is replayed.
    """
    spark = failures.sparkSession
    build = consolidate or _failure_candidates

    def handle(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/pending/batch={batch}")
        done = _last(spark, f"{folder}/candidates", "upto", batch)
        waiting = spark.read.schema(StructType([*df.schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/pending").where(
            (F.col("batch") > done) & (F.col("batch") <= batch))
        if waiting.limit(minimum).count() >= minimum:
            build(waiting.drop("batch")).write.mode("overwrite").parquet(f"{folder}/candidates/upto={batch}")

    writer = failures.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if now else writer.trigger(processingTime="1 minute")).start()


def _earlier(spark: SparkSession, folder: str, fields: StructType, batch: int) -> DataFrame:
    """Rows that batches before ``batch`` have written below ``folder``; none before the first has."""
    schema = StructType([*fields.fields, StructField("batch", LongType())])
    if not exists(spark, folder):
        return spark.createDataFrame([], fields)
    return spark.read.schema(schema).parquet(folder).where(F.col("batch") < batch).drop("batch")


def start_dedup(
    rows: DataFrame, folder: str, checkpoint: str, key: str = "content_hash", order: tuple[str, ...] = ("created_at",), now: bool = True,
) -> StreamingQuery:
    """Store the first row of every key that no earlier batch has stored, however long ago.

    A batch writes ``<folder>/batch=<n>`` after an anti-join with the batches before it; replayed, it overwrites its own
    folder. Rows without a key are stored once.
    """

    def handle(df: DataFrame, batch: int) -> None:
        first = distinct_first(df, [key], [F.col(c) for c in order])
        known = _earlier(df.sparkSession, folder, df.select(key).schema, batch).withColumnRenamed(key, "_key")
        fresh = first.join(known, first[key].eqNullSafe(known["_key"]), "left_anti")
        fresh.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if now else writer.trigger(processingTime="1 minute")).start()


def start_promotion(
    candidates: DataFrame, durable: DataFrame, folder: str, checkpoint: str, at: int = PROMOTE_AT, now: bool = True,
) -> StreamingQuery:
    """Promote running candidates (update mode) that reach ``at`` and are durable neither yet nor by an earlier batch.

    Batches write ``<folder>/batch=<n>`` as ``start_dedup`` does.
    """

    def handle(df: DataFrame, batch: int) -> None:
        ready = promote(df, durable, at)
        known = _earlier(df.sparkSession, folder, ready.select("context_hash").schema, batch)
        ready.join(known, "context_hash", "left_anti").write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    writer = candidates.writeStream.option("checkpointLocation", checkpoint).outputMode("update").foreachBatch(handle)
    return (writer.trigger(availableNow=True) if now else writer.trigger(processingTime="1 minute")).start()


def _last(spark: SparkSession, path: str, column: str, below: int) -> int:
    """Highest partition value under a folder that is lower than ``below``; -1 without any."""
    if not exists(spark, path):
        return -1
    found = spark.read.parquet(path).where(F.col(column) < below).agg(F.max(column)).first()[0]
    return -1 if found is None else int(found)


def _failure_candidates(failures: DataFrame) -> DataFrame:
    none = failures.sparkSession.createDataFrame([], "id bigint, ts timestamp, lessons array<string>")
    return memory_candidates(none, failures)
