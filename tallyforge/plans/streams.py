"""Streaming queries drained over the given tables, checked against their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import runs as R, streams as S
from . import bindings as B
from .bindings import with_sql
from .logs import SESSION_EVENTS
from .registry import Tables, query

from .stores import TOPIC_SQL

_LATE = "(SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


class Streams(Tables):
    """The same tables as file streams."""

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        path = f"{self.sf_dir}/{name}.parquet"
        schema = self.spark.read.parquet(path).schema
        # a glob lets the table be one file or a folder of files
        df = self.spark.readStream.schema(schema).parquet(f"{self.sf_dir}/{name}[.]parquet")
        zoneless = {f.name: F.col(f.name).cast("timestamp") for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"}
        return df.withColumns(zoneless) if zoneless else df


def live(t: Tables) -> Streams:
    return Streams(t.spark, t.sf_dir)


@query("log_rate_stream", with_sql("log_entries", f"""
SELECT epoch_us(time_bucket(INTERVAL 1 MINUTE, ts)) AS minute_us, count(*) AS count FROM log_entries GROUP BY 1 HAVING time_bucket(INTERVAL 1 MINUTE, any_value(ts)) + INTERVAL 1 MINUTE <= {_LATE}"""))
def log_rate_stream(t):
    rate = R.drain(S.log_rate_stream(B.log_entries(live(t))), "log-rate")
    return rate.select(F.unix_micros("minute").alias("minute_us"), "count")


@query("anomaly_stream", with_sql("log_entries", f"""
, x AS (SELECT service, time_bucket(INTERVAL 30 MINUTE, ts) - s * INTERVAL 30 MINUTE AS start FROM log_entries, (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) v(s) WHERE level = 'error'),
c AS (SELECT service, start, count(*) AS n FROM x GROUP BY ALL HAVING start + INTERVAL 4 HOUR <= (SELECT max(ts) FROM log_entries WHERE level = 'error') - INTERVAL 10 MINUTE),
b AS (SELECT *, avg(n) OVER (PARTITION BY service ORDER BY start ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS base FROM c)
SELECT service, epoch_us(start) AS start_us, n AS count, floor(base * 10000::DOUBLE + 0.5::DOUBLE)::DOUBLE / 10000::DOUBLE AS baseline FROM b WHERE base IS NOT NULL AND n > 2.0 * greatest(base, 1)"""))
def anomaly_stream(t):
    from ..functions.maths import half_up

    counts = R.drain(S.window_count_stream(B.log_entries(live(t)), "4 hours", "30 minutes"), "window-counts")
    again = t.spark.readStream.schema(counts.schema).parquet(*{f.rsplit("/", 1)[0] for f in counts.inputFiles()})
    found = R.drain(S.anomaly_stream(again, 2.0), "anomalies")
    return found.select("service", F.unix_micros("start").alias("start_us"), "count", half_up(F.col("baseline"), 4).alias("baseline"))


@query("candidate_stream", with_sql("experiences failures", TOPIC_SQL.replace(" WHERE processed_at IS NULL", "") + """
SELECT topic, confidence, epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us, context FROM cand"""))
def candidate_stream(t):
    from ..operators.history import first_rows

    s = live(t)
    updates = R.drain(S.candidate_stream(B.experiences(s), B.failures(s)), "candidates", "update")
    last = first_rows(updates, ["topic"], [F.col("batch_id").desc()])
    return last.select("topic", "confidence", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "context")


def decay_events(t):
    kind = F.when(F.col("event_type") == "purchase", "applied").otherwise("match")
    return t.events.where("event_type IN ('purchase', 'error', 'view')").select(
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("correction_id"), kind.alias("kind"),
        # the log's pace quickened, so that re-matches fall within the two minutes
        F.timestamp_micros((F.unix_micros("ts") / 400).cast("bigint")).alias("ts"))


@query("correction_decay_stream", """
WITH e AS (SELECT 'c' || user_id AS id, CASE event_type WHEN 'purchase' THEN 'applied' ELSE 'match' END AS kind, epoch_us(ts) // 400 AS us FROM events WHERE event_type IN ('purchase', 'error', 'view')),
u AS (SELECT *, last_value(CASE WHEN kind = 'applied' THEN us END IGNORE NULLS) OVER (PARTITION BY id ORDER BY us, kind ROWS UNBOUNDED PRECEDING) AS used FROM e),
m AS (SELECT id, us, coalesce(us - used < 120000000, false) AS near FROM u WHERE kind = 'match'),
g AS (SELECT *, sum((NOT near)::INT) OVER (PARTITION BY id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM m),
f AS (SELECT *, sum(near::INT) OVER (PARTITION BY id, k ORDER BY us ROWS UNBOUNDED PRECEDING) AS failed FROM g),
r AS (SELECT *, min(CASE WHEN failed > 3 THEN us END) OVER (PARTITION BY id) AS gone FROM f)
SELECT id AS correction_id, us, CASE WHEN failed > 3 THEN 'revoked' WHEN near THEN 'failed' ELSE 'ok' END AS outcome FROM r WHERE gone IS NULL OR us <= gone""")
def correction_decay_stream(t):
    return R.drain(S.correction_decay_stream(decay_events(live(t))), "decay")


@query("dedup_stream", with_sql("memories", "SELECT DISTINCT content_hash FROM memories"))
def dedup_stream(t):
    folder = scratch_path(t.spark, "dedup")
    R.start_dedup(B.memories(live(t)).select("content_hash", "created_at"), f"{folder}/store", f"{folder}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{folder}/store").select("content_hash")


@query("promoted_stream", with_sql("experiences failures", TOPIC_SQL.replace(" WHERE processed_at IS NULL", "") + """
SELECT DISTINCT left(sha256(trim(replace(context, chr(10), ' '))), 16) AS context_hash FROM cand WHERE confidence >= 3"""))
def promoted_stream(t):
    s, folder = live(t), scratch_path(t.spark, "promoted")
    none = t.spark.createDataFrame([], "context_hash string")
    R.start_promotion(S.candidate_stream(B.experiences(s), B.failures(s)), none, f"{folder}/store", f"{folder}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{folder}/store").select("context_hash")


@query("session_metrics_stream", with_sql("session_events", f"""
, g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY session ORDER BY ts) >= INTERVAL 6 HOUR AS brk FROM session_events), s AS (SELECT *, sum(coalesce(brk, false)::INT) OVER (PARTITION BY session ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT session, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) FILTER (event = 'TASK+') AS tasks_created, count(*) FILTER (event = 'PROMPT') AS prompts, count(*) FILTER (contains(event, 'FAIL')) AS failures,
 CASE WHEN count(*) FILTER (event = 'PROMPT') > 0 THEN floor(count(*) FILTER (event = 'AGENT')::DOUBLE / count(*) FILTER (event = 'PROMPT')::DOUBLE * 100::DOUBLE + 0.5::DOUBLE) ELSE 0 END::BIGINT AS agent_utilization
FROM s GROUP BY session, k HAVING max(ts) + INTERVAL 6 HOUR <= {_LATE}"""))
def session_metrics_stream(t):
    log = live(t).events.select(F.col("user_id").alias("session"), "ts", B.pick(SESSION_EVENTS, F.col("event_id") % 8).alias("event"))
    m = R.drain(S.session_metrics_stream(log, "6 hours"), "sessions")
    return m.select("session", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "tasks_created", "prompts", "failures", "agent_utilization")


@query("scan_stream", with_sql("todo_rows", "SELECT repo, path, line, tag, message FROM todo_rows"))
def scan_stream(t):
    return R.drain(S.scan_stream(B.code_files(live(t)).select("repo", "path", "content")), "scan")


@query("finding_stream", with_sql("findings", "SELECT repo, path, line, rule_id FROM findings"))
def finding_stream(t):
    return R.drain(S.finding_stream(B.code_files(live(t)).select("repo", "path", "content")), "findings").select("repo", "path", "line", "rule_id")


@query("consolidated_failures", with_sql("failures", TOPIC_SQL.replace(
    "SELECT id, ts, 0 AS source, unnest(lessons) AS said, unnest([0, 1]) AS seq FROM experiences WHERE processed_at IS NULL\n  UNION ALL ", "").replace(" WHERE processed_at IS NULL", "")
    .replace("error, 0 FROM", "error AS said, 0 AS seq FROM").replace("SELECT id, ts, 1, error", "SELECT id, ts, 1 AS source, error") + "SELECT topic, confidence, context FROM cand"))
def consolidated_failures(t):
    from ..session import scratch_path

    folder = scratch_path(t.spark, "consolidation")
    R.start_consolidation(B.failures(live(t)), folder, f"{folder}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{folder}/candidates").select("topic", "confidence", "context")
