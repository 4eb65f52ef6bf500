"""Log and trace queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import logs as L
from ..operators.history import distinct_first
from ..sources.files import to_lines
from ..sources.logs import parse_log_lines, parse_session_log, parse_spans
from . import bindings as B
from .bindings import define, with_sql
from .registry import query

FINGERPRINT_SQL = r"""
  CASE WHEN length(fp) < 5 THEN left(message, 80) ELSE fp END"""

define("error_rows", r"""
SELECT *, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(message,
  '\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b', '<TS>', 'g'),
  '\b\d+\b', '<N>', 'g'), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS fp
FROM log_entries WHERE level = 'error'""", ("log_entries",))

_CRIT = " OR ".join(f"contains(lower(message), '{w}')" for w in
                    ("fatal", "crash", "out of memory", "segfault", "panic", "emergency"))


@query("log_overview", with_sql("log_entries", """
SELECT count(*) AS total_lines, count(*) FILTER (level = 'error') AS error_count,
       count(*) FILTER (level = 'warn') AS warn_count, min(ts_raw) AS first_ts, max(ts_raw) AS last_ts
FROM log_entries"""))
def log_overview(t):
    return L.log_overview(B.log_entries(t))


@query("error_groups", with_sql("error_rows", f"""
SELECT {FINGERPRINT_SQL} AS pattern, count(*) AS count, min_by(message, line) AS example,
       CASE WHEN bool_or({_CRIT}) OR count(*) >= 50 THEN 'high' WHEN count(*) >= 10 THEN 'medium' ELSE 'low' END AS severity
FROM error_rows GROUP BY 1"""))
def error_groups(t):
    return L.error_groups(B.log_entries(t))


@query("error_groups_by_service", with_sql("error_rows", f"""
SELECT service, {FINGERPRINT_SQL} AS pattern, count(*) AS count, min_by(message, line) AS example,
       CASE WHEN bool_or({_CRIT}) OR count(*) >= 50 THEN 'high' WHEN count(*) >= 10 THEN 'medium' ELSE 'low' END AS severity
FROM error_rows GROUP BY 1, 2"""))
def error_groups_by_service(t):
    return L.error_groups(B.log_entries(t), ("service",))


@query("top_errors", with_sql("log_entries", """
SELECT message, count(*) AS count FROM log_entries WHERE level = 'error'
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""))
def top_errors(t):
    return L.top_errors(B.log_entries(t))


@query("log_frequency", with_sql("log_entries", """
SELECT left(ts_raw, 16) AS minute, count(*) AS count FROM log_entries GROUP BY 1"""))
def log_frequency(t):
    return L.frequency(B.log_entries(t))


@query("error_anomalies", with_sql("log_entries", """
, e AS (SELECT service, line, ts_raw, message, epoch_ms(ts) AS ms FROM log_entries WHERE level = 'error'),
c AS (SELECT *, count(*) OVER (PARTITION BY service ORDER BY ms RANGE BETWEEN CURRENT ROW AND 14400000 FOLLOWING)
               - (row_number() OVER (PARTITION BY service, ms ORDER BY line) - 1) AS cnt FROM e),
b AS (SELECT *, avg(cnt) OVER (PARTITION BY service ORDER BY ms, line ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS base FROM c),
a AS (SELECT *, row_number() OVER (PARTITION BY service, ts_raw, message ORDER BY ms, line) AS rn
      FROM b WHERE base IS NOT NULL AND cnt > 1.5 * greatest(base, 1))
SELECT service, ts_raw, message, cnt AS count, base AS baseline FROM a WHERE rn = 1"""))
def error_anomalies(t):
    return L.anomalies(B.log_entries(t), minutes=240, threshold=1.5)


@query("first_seen_messages", with_sql("log_entries", """
SELECT message, min(line) AS line, min_by(service, line) AS service FROM log_entries GROUP BY 1"""))
def first_seen_messages(t):
    logs = B.log_entries(t).select("message", "line", "service")
    return distinct_first(logs, ["message"], [F.col("line")])


def raw_log_lines(t):
    """Log text of mixed shape: JSON objects, stamped text, garbage and blanks."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    obj = F.to_json(F.struct(stamp.alias("timestamp"), F.upper("event_type").alias("level"),
                             F.concat(F.lit("k="), F.col("props")).alias("message"),
                             F.col("user_id").alias("user")))
    kind = F.col("event_id") % 5
    text = (F.when(kind == 0, obj).when(kind == 1, F.concat(stamp, F.lit(" ERROR job "), F.col("user_id").cast("string")))
            .when(kind == 2, F.concat(F.lit("garbage {"), F.col("event_type"))).when(kind == 3, "[1, 2]").otherwise("   "))
    return t.events.select(F.col("event_id").alias("line"), text.alias("text"))


@query("parsed_log_lines", r"""
SELECT event_id AS line,
       CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS ts_raw,
       CASE WHEN event_id % 5 = 0 THEN upper(event_type) END AS level,
       CASE event_id % 5 WHEN 0 THEN 'k=' || props
            WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' ERROR job ' || user_id
            WHEN 2 THEN 'garbage {' || event_type END AS message,
       event_id % 5 IN (1, 2) AS is_raw,
       CASE WHEN event_id % 5 = 0 THEN user_id::VARCHAR END AS user_attr,
       CASE WHEN event_id % 5 IN (0, 1) THEN epoch(date_trunc('second', ts))::BIGINT END AS epoch_s
FROM events WHERE event_id % 5 <> 4""")
def parsed_log_lines(t):
    return parse_log_lines(raw_log_lines(t), "text", "line").select(
        "line", "ts_raw", "level", "message", "is_raw",
        F.try_element_at("attrs", F.lit("user")).alias("user_attr"),
        F.unix_seconds("ts").alias("epoch_s"),
    )


def trace_lines(t):
    """Trace JSON with each id alias and each way of giving times."""
    at = F.unix_micros("ts") / F.lit(1e6)
    tid = F.concat(F.lit("t"), F.col("user_id").cast("string"))
    by_stamp = F.to_json(F.struct(tid.alias("traceId"), at.alias("timestamp")))
    ranged = F.to_json(F.struct(tid.alias("trace_id"), at.alias("startTime"), (at + F.col("value")).alias("endTime")))
    nested = F.to_json(F.struct(F.struct(tid.alias("id")).alias("trace"), at.alias("startTime"), (at + 1).alias("endTime")))
    kind = F.col("event_id") % 4
    return t.events.select(
        F.when(kind == 0, by_stamp).when(kind == 1, ranged).when(kind == 2, nested).otherwise("{broken").alias("text"))


@query("trace_summary", """
SELECT 't' || user_id AS trace_id, count(*) AS spans,
       max(CASE event_id % 4 WHEN 0 THEN epoch_us(ts) / 1e6 WHEN 1 THEN epoch_us(ts) / 1e6 + value ELSE epoch_us(ts) / 1e6 + 1 END)
       - min(epoch_us(ts) / 1e6) AS duration
FROM events WHERE event_id % 4 <> 3 GROUP BY 1""")
def trace_summary(t):
    return L.trace_summary(parse_spans(trace_lines(t)))


@query("flaky_tests", with_sql("code_lines", r"""
, r AS (SELECT regexp_extract(path, '([^/]*)$', 1) AS file, line, text FROM code_lines
        WHERE regexp_matches(text, '(?i)rerun|retry|flaky|attempt \d+ of \d+|pass after retry|failed, will retry')),
n AS (SELECT DISTINCT file,
        CASE WHEN regexp_matches(text, '(?i)(?:✓|✗|FAIL|PASS|×|•)\s*[→>]\s*([^(]+)|(?:describe|it|test)\s*\([''"]([^''"]+)')
             THEN trim(regexp_extract(text, '(?i)(?:✓|✗|FAIL|PASS|×|•)\s*[→>]\s*([^(]+)|(?:describe|it|test)\s*\([''"]([^''"]+)', 1)
                    || regexp_extract(text, '(?i)(?:✓|✗|FAIL|PASS|×|•)\s*[→>]\s*([^(]+)|(?:describe|it|test)\s*\([''"]([^''"]+)', 2))
             ELSE file || ':' || line END AS test, left(text, 80) AS head FROM r)
SELECT test, count(*) AS failure_count FROM n GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100"""))
def flaky_tests(t):
    return L.flaky_tests(to_lines(B.code_files(t)))


@query("log_ages", with_sql("log_entries", """
SELECT line, floor((1735689600000000 - epoch_us(ts)) / 86400000000)::INT AS age_days,
       CASE WHEN (1735689600000000 - epoch_us(ts)) / 86400000000.0 <= 1 THEN 10
            WHEN (1735689600000000 - epoch_us(ts)) / 86400000000.0 <= 7 THEN 5 ELSE 0 END AS recency
FROM log_entries"""))
def log_ages(t):
    now = F.timestamp_micros(F.lit(1735689600000000))
    ts = F.col("ts")
    return B.log_entries(t).select(
        "line", dates.age_days(ts, now).alias("age_days"), dates.recency_points(ts, now).alias("recency"))


SESSION_EVENTS = ["TASK+", "TASK done", "WRITE", "GIT COMMIT", "FAIL", "AGENT", "PROMPT", "BRANCH SWITCH"]

define("session_events", f"""
SELECT user_id AS session, strftime(ts, '%H:%M:%S') AS clock,
       list_extract({B.lit_list(SESSION_EVENTS)}, (event_id % 8)::INT + 1) AS event,
       event_type || ' ' || props AS detail, ts
FROM events""")


def session_lines(t):
    text = F.concat(F.lit("["), F.date_format("ts", "HH:mm:ss"), F.lit("] "),
                    B.pick(SESSION_EVENTS, F.col("event_id") % 8), F.lit(": "), F.col("event_type"),
                    F.lit(" "), F.col("props"))
    return t.events.select(F.col("user_id").alias("session"), "ts", text.alias("text"))


@query("session_log_events", with_sql("session_events", """
SELECT session, clock, event, detail, count(*) AS n FROM session_events GROUP BY ALL"""))
def session_log_events(t):
    rows = parse_session_log(session_lines(t), "text", "session")
    return rows.groupBy("session", "clock", "event", "detail").agg(F.count(F.lit(1)).alias("n"))
