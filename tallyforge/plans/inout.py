"""Readers and sinks: written below the shared folder, read back, and held against the tables they came from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import logs as SL, sinks as SK, tables as ST
from . import bindings as B
from .bindings import with_sql
from .registry import query


@query("numbered_log_lines", """
SELECT 'svc' || user_id % 5 AS service, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS line, event_id || ' ' || event_type AS message FROM events""")
def numbered_log_lines(t):
    """One log file per service in order of its events, read back in whatever splits."""
    path = scratch_path(t.spark, "numbered-logs")
    rows = t.events.select((F.col("user_id") % 5).alias("service"), "event_id", F.concat_ws(" ", "event_id", "event_type").alias("value"))
    rows.repartition("service").sortWithinPartitions("service", "event_id").select("service", "value").write.partitionBy("service").text(path)
    lines = SL.read_lines(t.spark, f"{path}/*")
    return lines.select(F.concat(F.lit("svc"), F.regexp_extract("file", r"service=(\d+)", 1)).alias("service"), "line", F.col("text").alias("message"))


@query("jsonl_round_trip", """
SELECT conv_id, turn, role, text, CASE WHEN conv_id % 7 = 0 THEN 'broken ' || conv_id END AS corrupt FROM conversations WHERE conv_id % 7 <> 0
UNION ALL SELECT NULL, NULL, NULL, NULL, 'broken ' || conv_id || ' ' || turn FROM conversations WHERE conv_id % 7 = 0""")
def jsonl_round_trip(t):
    """Conversations as JSON lines, those of every seventh broken; unreadable lines keep their text."""
    path = scratch_path(t.spark, "jsonl")
    broken = F.concat_ws(" ", F.lit("broken"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    t.conversations.select(F.when(F.col("conv_id") % 7 == 0, broken).otherwise(F.to_json(F.struct("conv_id", "turn", "role", "text")))).write.text(path)
    back = SL.read_jsonl(t.spark, path, "conv_id bigint, turn bigint, role string, text string")
    return back.withColumnRenamed("_corrupt_record", "corrupt")


@query("commit_table", with_sql("commits", "SELECT repo, hash, author, epoch_us(ts) AS us, message FROM commits"))
def commit_table(t):
    """Commits landed as Parquet and read under the declared schema."""
    path = scratch_path(t.spark, "commit-table")
    B.commits(t).write.parquet(path)
    return ST.read_commits(t.spark, path).select("repo", "hash", "author", F.unix_micros("ts").alias("us"), "message")


@query("appended_events", """
SELECT day, count(*) AS n, count(DISTINCT event_id) AS ids FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id FROM events UNION ALL SELECT strftime(ts, '%Y-%m-%d'), event_id FROM events WHERE event_type = 'error') GROUP BY 1""")
def appended_events(t):
    """Two appends to one log, partitioned by day."""
    path = scratch_path(t.spark, "event-log")
    SK.append_events(t.events, path, "parquet")
    SK.append_events(t.events.where("event_type = 'error'"), path, "parquet")
    return t.spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


@query("rewritten_store", with_sql("memories", "SELECT id, content_hash, turn FROM memories WHERE turn > 0 AND conv_id % 3 <> 0"))
def rewritten_store(t):
    """A store replaced twice from its own content; the newest number counts."""
    path = scratch_path(t.spark, "store")
    SK.overwrite_store(B.memories(t).select("id", "content_hash", "conv_id", "turn"), path)
    SK.overwrite_store(SK.read_store(t.spark, path).where("turn > 0"), path)
    SK.overwrite_store(SK.read_store(t.spark, path).where("conv_id % 3 <> 0"), path)
    return SK.read_store(t.spark, path).select("id", "content_hash", "turn")


@query("exported_debt_items", with_sql("debt_store", "SELECT repo, path, line, tag, message, status FROM debt_store"))
def exported_debt_items(t):
    """The JSON lines of the debt export, read back."""
    from .scans import debt_store

    path = scratch_path(t.spark, "debt-export")
    SK.export_debt(debt_store(t), path)
    return SL.read_jsonl(t.spark, f"{path}/items", "repo string, path string, line int, tag string, message string, status string").drop("_corrupt_record")
