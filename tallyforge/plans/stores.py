"""Queries over failures, experiences, memories, messages, knowledge and trade-offs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import decisions as DC, experience as E, knowledge as KN, memory as M, mutate as U
from ..rules import knowledge as KR, words
from . import bindings as B
from .bindings import define, lit_list, pick, with_sql
from .registry import query
from .scans import NOW_US, now, q

# --- failures and experiences --------------------------------------------------------


@query("unresolved_build_failures", with_sql("failures", """
SELECT id, tool, error FROM failures WHERE type = 'build' AND NOT resolved ORDER BY ts DESC, id LIMIT 50"""))
def unresolved_build_failures(t):
    return E.select_failures(B.failures(t), "build", True, 50).select("id", "tool", "error")


@query("unprocessed_failures", with_sql("failures", """
SELECT id, tool FROM failures WHERE processed_at IS NULL AND id NOT IN (SELECT id FROM failures WHERE id % 7 = 0)"""))
def unprocessed_failures(t):
    f = B.failures(t)
    return E.unprocessed(f, f.where("id % 7 = 0")).select("id", "tool")


@query("recent_experiences", with_sql("experiences", """
SELECT id, outcome FROM experiences WHERE lower(task_type) = 'click' ORDER BY ts DESC, id LIMIT 10"""))
def recent_experiences(t):
    return E.recent(B.experiences(t), "CLICK", 10).select("id", "outcome")


@query("decision_search", with_sql("decisions", """
SELECT id, context, selected FROM decisions WHERE contains(lower(context), 'shard7') OR contains(lower(selected), 'shard7') OR contains(lower(rationale), 'shard7')
 OR list_contains(list_transform(options, lambda o: contains(lower(o), 'shard7')), true)"""))
def decision_search(t):
    return E.query_decisions(B.decisions(t), "Shard7").select("id", "context", "selected")


define("insights", """
SELECT lower(trim(p)) AS pattern, count(*) AS frequency,
 floor(sum(CASE outcome WHEN 'success' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) / count(*)::DOUBLE * 100::DOUBLE + 0.5::DOUBLE)::DOUBLE / 100::DOUBLE AS success_rate
FROM (SELECT outcome, unnest(patterns) AS p FROM experiences) WHERE trim(p) <> '' GROUP BY 1""", ("experiences",))


@query("pattern_insights", with_sql("insights", "SELECT * FROM insights"))
def pattern_insights(t):
    return E.pattern_insights(B.experiences(t))


@query("experience_stats", with_sql("insights decisions", """
SELECT 'outcome' AS dim, o AS key, count(id) AS n FROM (VALUES ('success'), ('failure'), ('partial')) v(o) LEFT JOIN experiences ON outcome = o GROUP BY 2
UNION ALL (SELECT 'pattern', pattern, frequency FROM insights ORDER BY frequency DESC, pattern LIMIT 5)
UNION ALL (SELECT 'decision', id::VARCHAR, floor(epoch(ts))::BIGINT FROM decisions ORDER BY ts DESC, id LIMIT 10)"""))
def experience_stats(t):
    return E.experience_stats(B.experiences(t), B.decisions(t))


_KEY = r"left(regexp_replace(error, '\d+', '0', 'g'), 80)"
define("suggestions", rf"""
SELECT k AS error_key, n, CASE WHEN name = '' THEN 'recurring_error_' || n ELSE name END AS pattern,
 regexp_replace(left(e, 100), '([|\\{{}}()\[\]^$+?.])', '\\\1', 'g') AS symptom, tools,
 CASE WHEN contains(lower(k), 'timeout') THEN 'timeout' WHEN contains(lower(k), 'not found') OR contains(lower(k), 'enoent') THEN 'path'
  WHEN contains(lower(k), 'rate limit') OR contains(lower(k), '429') THEN 'rate_limit' WHEN contains(lower(k), 'permission') OR contains(lower(k), 'denied') THEN 'permission'
  WHEN contains(lower(k), 'parse') OR contains(lower(k), 'syntax') THEN 'parse' ELSE 'investigate' END AS kind
FROM (SELECT k, count(*) AS n, arg_min(error, (-epoch_us(ts), id::VARCHAR)) AS e, string_agg(DISTINCT tool, ', ' ORDER BY tool) AS tools,
  left(regexp_replace(lower(array_to_string(regexp_split_to_array(regexp_replace(k, '[^a-zA-Z0-9 ]', '', 'g'), '\s+')[1:5], '_')), '_+', '_', 'g'), 60) AS name
 FROM (SELECT *, {_KEY} AS k FROM failures WHERE processed_at IS NULL) GROUP BY k HAVING count(*) >= 2)""", ("failures",))


@query("failure_suggestions", with_sql("suggestions", "SELECT * FROM suggestions"))
def failure_suggestions(t):
    return E.failure_suggestions(B.failures(t)).drop("fix")


def corrections(t):
    """Learned corrections: one per tool for the retry and disk errors, plus a broken pattern."""
    rows = t.supplier.select(
        F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("id"),
        F.when(F.col("s_suppkey") % 2 == 0, "local").otherwise("global").alias("scope"), F.col("s_suppkey").alias("seq"),
        F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("pattern"),
        F.when(F.col("s_suppkey") == 3, "([").otherwise(F.concat(F.lit("\\b(disk|host) "), F.col("s_suppkey").cast("string"), F.lit("\\D*$"))).alias("symptom"),
        F.concat(F.lit("fix "), F.col("s_suppkey").cast("string")).alias("fix"),
        F.when(F.col("s_suppkey") % 3 == 0, "learn").otherwise("manual").alias("source"),
        (F.col("s_suppkey") % 4).alias("applied_count"),
        F.when(F.col("s_suppkey") % 5 == 0, F.lit("2024-01-10").cast("timestamp")).alias("last_applied_at"))
    return rows


define("corrections", r"""
SELECT 'c' || s_suppkey AS id, CASE s_suppkey % 2 WHEN 0 THEN 'local' ELSE 'global' END AS scope, s_suppkey AS seq, 'p' || s_suppkey AS pattern,
 CASE WHEN s_suppkey = 3 THEN NULL ELSE '\b(disk|host) ' || s_suppkey || '\D*$' END AS symptom, 'fix ' || s_suppkey AS fix,
 CASE WHEN s_suppkey % 3 = 0 THEN 'learn' ELSE 'manual' END AS source, s_suppkey % 4 AS applied_count,
 CASE WHEN s_suppkey % 5 = 0 THEN TIMESTAMP '2024-01-10' END AS last_applied_at FROM supplier""")


@query("learn_report", with_sql("failures corrections", """
SELECT count(*) AS total_failures, count(*) FILTER (NOT resolved) AS unresolved_failures,
 (SELECT count(*) FROM corrections WHERE source = 'learn') AS corrections_written, (SELECT count(*) FROM corrections) AS active_patterns FROM failures"""))
def learn_report(t):
    return E.learn_report(B.failures(t), corrections(t))


@query("matched_corrections", with_sql("failures corrections", """
, m AS (SELECT error, c.id, row_number() OVER (PARTITION BY error ORDER BY scope = 'global', seq) AS rn
  FROM (SELECT DISTINCT error FROM failures) f JOIN corrections c ON regexp_matches(lower(error), symptom))
SELECT f.id, m.id AS correction_id FROM failures f LEFT JOIN m ON m.error = f.error AND rn = 1"""))
def matched_corrections(t):
    return E.match_corrections(B.failures(t), corrections(t)).select("id", "correction_id")


@query("upserted_corrections", with_sql("corrections suggestions", """
, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY n DESC, error_key) AS rn FROM suggestions) WHERE rn = 1)
SELECT coalesce(c.pattern, s.pattern) AS pattern, coalesce(CASE WHEN seq = 3 THEN '([' ELSE c.symptom END, s.symptom) AS symptom, c.fix AS old_fix, coalesce(c.applied_count, 0) AS applied_count
FROM corrections c FULL JOIN s ON s.pattern = c.pattern"""))
def upserted_corrections(t):
    c = corrections(t)
    up = E.upsert_corrections(c, E.failure_suggestions(B.failures(t)))
    return up.join(c.select("pattern", F.col("fix").alias("old_fix")), "pattern", "left").select(
        "pattern", "symptom", "old_fix", "applied_count")


@query("bumped_corrections", with_sql("corrections failures", """
, u AS (SELECT 'c' || (id % 120) AS id, count(*) AS n, max(ts) AS last FROM failures GROUP BY 1)
SELECT c.id, c.applied_count + coalesce(n, 0) AS applied_count, floor(epoch(greatest(c.last_applied_at, last)))::BIGINT AS last_s FROM corrections c LEFT JOIN u USING (id)"""))
def bumped_corrections(t):
    uses = B.failures(t).select(F.concat(F.lit("c"), (F.col("id") % 120).cast("string")).alias("id"), "ts")
    return U.bump_usage(corrections(t), uses).select("id", "applied_count", F.unix_seconds("last_applied_at").alias("last_s"))


@query("suppressed_rules", with_sql("corrections", "SELECT id AS rule_id FROM corrections WHERE seq % 10 <> 0"))
def suppressed_rules(t):
    rules = corrections(t).select(F.col("id").alias("rule_id"), "seq")
    return U.suppress(rules, rules.where("seq % 10 = 0")).select("rule_id")


@query("failure_experiences", with_sql("failures", """
SELECT left(sha256(type || '|' || error || '|' || regexp_replace(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '\\.?0+$', '')), 16) AS key, 'Failure in ' || type || ': ' || error AS lesson FROM failures""".replace("\\\\", "\\")))
def failure_experiences(t):
    rows = B.failures(t).select(F.col("type").alias("task_type"), "error", F.col("tool").alias("context"), "ts")
    return E.failure_rows(rows).select(F.substring("id", 5, 16).alias("key"), F.get("lessons", F.lit(0)).alias("lesson"))


@query("decision_rows", with_sql("decisions", "SELECT id % 100 AS experience_id, selected, rationale FROM decisions"))
def decision_rows(t):
    done = B.decisions(t).select((F.col("id") % 100).alias("id"), F.array(F.struct("selected", "rationale")).alias("decisions"))
    return E.decision_rows(done).select("experience_id", "selected", "rationale")


@query("topics", with_sql("log_entries", r"""
, c AS (SELECT DISTINCT message, string_split_regex(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(message,
   '(?:https?|ftp)://[\n\S]+', ' ', 'g'), '(?:/[a-zA-Z0-9_.-]+)+', ' ', 'g'), 'at\s+.*:\d+:\d+', ' ', 'g'), '[a-fA-F0-9-]{16,}', ' ', 'g')), '[^a-z0-9\s]', ' ', 'g'), '\s+') AS w FROM log_entries),
f AS (SELECT message, w, list_filter(w, lambda x, i: length(x) > 2 AND NOT regexp_matches(x, '^\d+$') AND NOT list_contains(STOPS, x) AND list_position(w, x) = i) AS k FROM c)
SELECT message, CASE WHEN len(k) = 0 THEN 'general_operations' ELSE array_to_string(k[1:4], '_') END AS topic FROM f""".replace("STOPS", lit_list(words.TOPIC_STOP_WORDS))))
def topics(t):
    return B.log_entries(t).select("message").distinct().withColumn("topic", X.topic(F.col("message")))


TOPIC_SQL = r"""
, x AS (SELECT id, ts, 0 AS source, unnest(lessons) AS said, unnest([0, 1]) AS seq FROM experiences WHERE processed_at IS NULL
  UNION ALL SELECT id, ts, 1, error, 0 FROM failures WHERE processed_at IS NULL),
c AS (SELECT *, string_split_regex(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(said,
   '(?:https?|ftp)://[\n\S]+', ' ', 'g'), '(?:/[a-zA-Z0-9_.-]+)+', ' ', 'g'), 'at\s+.*:\d+:\d+', ' ', 'g'), '[a-fA-F0-9-]{16,}', ' ', 'g')), '[^a-z0-9\s]', ' ', 'g'), '\s+') AS w FROM x),
f AS (SELECT *, list_filter(w, lambda x, i: length(x) > 2 AND NOT regexp_matches(x, '^\d+$') AND NOT list_contains(STOPS, x) AND list_position(w, x) = i) AS k FROM c),
s AS (SELECT *, CASE WHEN len(k) = 0 THEN 'general_operations' ELSE array_to_string(k[1:4], '_') END AS topic,
  CASE WHEN source = 0 THEN said ELSE 'Failure observation: ' || said END AS context FROM f),
cand AS (SELECT topic, count(*) AS confidence, min(ts) AS first_seen, max(ts) AS last_seen, arg_min(context, (source, ts, id, seq)) AS context FROM s GROUP BY 1)
""".replace("STOPS", lit_list(words.TOPIC_STOP_WORDS))


def candidates(t):
    return M.memory_candidates(E.unprocessed(B.experiences(t)), E.unprocessed(B.failures(t)))


@query("memory_candidates", with_sql("experiences failures", TOPIC_SQL + """
SELECT topic, confidence, epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us, context FROM cand"""))
def memory_candidates(t):
    return candidates(t).select("topic", "confidence", F.unix_micros("first_seen").alias("first_us"),
                                F.unix_micros("last_seen").alias("last_us"), "context")


@query("promoted_memories", with_sql("experiences failures", TOPIC_SQL + """
, h AS (SELECT *, left(sha256(trim(replace(context, chr(10), ' '))), 16) AS context_hash FROM cand WHERE confidence >= 200),
r AS (SELECT *, row_number() OVER (PARTITION BY context_hash ORDER BY topic) AS rn FROM h)
SELECT topic, confidence, context_hash FROM r WHERE rn = 1 AND context_hash NOT IN (SELECT context_hash FROM h WHERE confidence % 3 = 0)"""))
def promoted_memories(t):
    """Durable facts so far: candidates whose confidence is a multiple of three."""
    c = candidates(t)
    durable = c.where("confidence >= 200 AND confidence % 3 = 0").select(M.context_hash(F.col("context")).alias("context_hash"))
    return M.promote(c, durable, 200).select("topic", "confidence", "context_hash")


@query("staged_memories", with_sql("experiences failures", TOPIC_SQL + "SELECT topic, confidence FROM cand WHERE confidence < 200"))
def staged_memories(t):
    return M.staged(candidates(t), 200).select("topic", "confidence")


# --- memories ------------------------------------------------------------------------


@query("memory_store", with_sql("memories", """
, a AS (SELECT content_hash, agent, arg_min(platform, (created_at, id)) AS platform, min(created_at) AS ts FROM memories GROUP BY ALL),
e AS (SELECT content_hash, arg_min(id, (created_at, id)) AS id, arg_min(name, (created_at, id)) AS name FROM memories GROUP BY 1)
SELECT e.content_hash, e.id, e.name, string_agg(agent || '@' || platform, ',' ORDER BY agent) AS agents, epoch_us(max(ts)) AS updated_us FROM e JOIN a USING (content_hash) GROUP BY ALL"""))
def memory_store(t):
    return _flat(M.new_store(B.memories(t)))


def _flat(store):
    agents = F.array_join(F.array_sort(F.transform("provenance", lambda p: F.concat(p["agent"], F.lit("@"), p["platform"]))), ",")
    return store.select("content_hash", "id", "name", agents.alias("agents"), F.unix_micros("updated_at").alias("updated_us"))


define("mem_sides", """
SELECT *, conv_id % 2 = 0 AS old FROM memories""", ("memories",))
_SIDES = """
, a AS (SELECT content_hash, agent, old, arg_min(platform, (created_at, id)) AS platform, min(created_at) AS ts FROM mem_sides GROUP BY ALL),
e AS (SELECT content_hash, old, arg_min(id, (created_at, id)) AS id, arg_min(name, (created_at, id)) AS name FROM mem_sides GROUP BY ALL),
k AS (SELECT content_hash, bool_or(old) AS known FROM e GROUP BY 1),
p AS (SELECT a.* FROM a JOIN k USING (content_hash) WHERE NOT known OR old OR NOT EXISTS (SELECT 1 FROM a b WHERE b.old AND b.content_hash = a.content_hash AND b.agent = a.agent))
"""


@query("upserted_memories", with_sql("mem_sides", _SIDES + """
SELECT e.content_hash, e.id, e.name, string_agg(agent || '@' || platform, ',' ORDER BY agent) AS agents, epoch_us(max(ts)) AS updated_us
FROM e JOIN k ON k.content_hash = e.content_hash AND e.old = k.known JOIN p ON p.content_hash = e.content_hash GROUP BY ALL"""))
def upserted_memories(t):
    rows = B.memories(t)
    return _flat(M.upsert_memory(M.new_store(rows.where("conv_id % 2 = 0")), rows.where("conv_id % 2 = 1")))


@query("synced_memory_counts", with_sql("mem_sides", """
, a AS (SELECT content_hash, agent, old, arg_min(platform, (created_at, id)) AS platform FROM mem_sides GROUP BY ALL),
n AS (SELECT DISTINCT content_hash FROM a WHERE NOT old)
SELECT (SELECT count(*) FROM n) AS synced,
 (SELECT count(*) FROM a WHERE NOT old AND content_hash IN (SELECT content_hash FROM a WHERE old)
   AND NOT EXISTS (SELECT 1 FROM a b WHERE b.old AND b.content_hash = a.content_hash AND b.agent = a.agent AND b.platform = a.platform)) AS conflicts,
 (SELECT count(*) FROM n WHERE content_hash NOT IN (SELECT content_hash FROM a WHERE old)) AS new_entries"""))
def synced_memory_counts(t):
    rows = B.memories(t)
    merged = M.sync_memory(M.new_store(rows.where("conv_id % 2 = 0")), M.new_store(rows.where("conv_id % 2 = 1")))
    return M.sync_counts(merged)


@query("memory_search", with_sql("memories", """
, s AS (SELECT content_hash, arg_min(struct_pack(id, name, description, content, tags, platform, memory_type), (created_at, id)) AS e, list(DISTINCT agent) AS agents,
  epoch_us(max(first)) AS u FROM (SELECT *, min(created_at) OVER (PARTITION BY content_hash, agent) AS first FROM memories) GROUP BY 1)
SELECT e.id AS id, e.name AS name FROM s WHERE e.platform IN ('desk', 'shell') AND list_contains(agents, 'user') AND e.memory_type IN ('intent')
 AND (list_contains(e.tags, 'user') OR list_contains(e.tags, 'Tag1')) AND contains(lower(e.content), 'en') ORDER BY u DESC, e.id LIMIT 20"""))
def memory_search(t):
    found = M.query_memory(M.new_store(B.memories(t)), ["desk", "shell"], "USE", "intent", ["USER", "tag1"], "EN", 20)
    return found.select("id", "name")


@query("memory_by_id", with_sql("memories", "SELECT id, name, content FROM memories WHERE id = 'mem-3-1'"))
def memory_by_id(t):
    return M.by_id(B.memories(t), "mem-3-1").select("id", "name", "content")


@query("memory_stats", with_sql("memories", """
, s AS (SELECT content_hash, arg_min(struct_pack(tags, platform, memory_type), (created_at, id)) AS e FROM memories GROUP BY 1)
SELECT 'platform' AS dim, e.platform AS key, count(*) AS n FROM s GROUP BY 2 UNION ALL SELECT 'memory_type', e.memory_type, count(*) FROM s GROUP BY 2
UNION ALL (SELECT 'tag', tag, count(*) AS n FROM (SELECT unnest(e.tags) AS tag FROM s) GROUP BY 2 ORDER BY n DESC, tag LIMIT 10)
UNION ALL SELECT 'agents', 'distinct', count(DISTINCT platform || ':' || agent) FROM (SELECT agent, arg_min(platform, (created_at, id)) AS platform FROM memories GROUP BY content_hash, agent)"""))
def memory_stats(t):
    return M.memory_stats(M.new_store(B.memories(t)))


@query("recent_memory", with_sql("memories", """
SELECT count(*) > 0 AS has_entries, count(*) FILTER (created_at > TIMESTAMP '2024-01-09') AS recent_count FROM memories"""))
def recent_memory(t):
    return M.recent_memory(B.memories(t), F.lit("2024-01-16").cast("timestamp"))


@query("memory_retention", with_sql("memories", """
SELECT id, floor(exp(-0.6931471805599453::DOUBLE * greatest((1706745600000000 - epoch_us(updated_at)) / 86400000000.0::DOUBLE, 0.0::DOUBLE) / CASE memory_type WHEN 'decision' THEN 30 WHEN 'experience' THEN 14 WHEN 'intent' THEN 60
 WHEN 'concept' THEN 90 WHEN 'data' THEN 7 ELSE 30 END::DOUBLE) * 10000::DOUBLE + 0.5::DOUBLE)::DOUBLE / 10000::DOUBLE AS retained FROM memories"""))
def memory_retention(t):
    return M.retention(B.memories(t), F.timestamp_micros(F.lit(1706745600000000))).select("id", "retained")


@query("exported_memory_yaml", with_sql("memories", """
SELECT id, concat_ws(chr(10), '  - id: ' || id, '    name: ' || name, '    type: ' || memory_type, '    platform: ' || platform, '    tags: [' || array_to_string(tags, ', ') || ']',
 '    agents: [' || platform || ':' || agent || ']', '    content: |', array_to_string(list_transform(string_split(content, chr(10)), lambda x: '      ' || x), chr(10)), '') AS text FROM memories"""))
def exported_memory_yaml(t):
    return M.export_memory(_single(t), "yaml")


def _single(t):
    return B.memories(t).withColumn(
        "provenance", F.array(F.struct("agent", "platform", F.col("created_at").alias("ts"))))


@query("exported_memory_markdown", with_sql("memories", """
SELECT id, concat_ws(chr(10), '## ' || name, '', '**Type:** ' || memory_type || '  ', '**Tags:** ' || array_to_string(tags, ', ') || '  ', '**Agents:** ' || platform || ' (@' || agent || ')  ',
 '**Created:** ' || strftime(created_at, '%Y-%m-%dT%H:%M:%S.%gZ') || '  ', '**Updated:** ' || strftime(updated_at, '%Y-%m-%dT%H:%M:%S.%gZ') || '  ', '', description, '', '```', content, '```', '', '---', '') AS text FROM memories"""))
def exported_memory_markdown(t):
    return M.export_memory(_single(t), "markdown")


@query("visible_messages", with_sql("messages", """
SELECT id, sender, recipient FROM messages WHERE (recipient IN ('all', 'assistant') OR sender = 'assistant') AND ts > TIMESTAMP '2024-01-03'"""))
def visible_messages(t):
    return M.messages_for(B.messages(t), "assistant", F.lit("2024-01-03").cast("timestamp")).select("id", "sender", "recipient")


@query("clipped_messages", with_sql("messages", """
, r AS (SELECT id, recipient, repeat(content, 40) AS c FROM messages), k AS (SELECT id, recipient, CASE WHEN length(c) > 50000 THEN left(c, 50000) || chr(10) || '... [Truncated: Exceeded 50KB limit]' ELSE c END AS c FROM r)
SELECT id, sha256(CASE WHEN recipient = 'all' AND length(c) > 10000 THEN '[BROADCAST WARNING] Large broadcasts degrade performance. Please target specific agents if possible.' || chr(10) || chr(10) || c ELSE c END) AS digest FROM k"""))
def clipped_messages(t):
    big = B.messages(t).withColumn("content", F.repeat("content", F.lit(40)))
    return M.clip_messages(big).select("id", F.sha2("content", 256).alias("digest"))


# --- mutations -----------------------------------------------------------------------


@query("resolved_failures", with_sql("failures", """
SELECT id, resolved OR id % 10 = 1 AS resolved, CASE WHEN id % 10 = 1 THEN 'fixed' END AS resolution FROM failures"""))
def resolved_failures(t):
    f = B.failures(t)
    changes = f.where("id % 10 = 1").select("id", "ts", F.lit(True).alias("resolved"), F.lit("fixed").alias("resolution"))
    return U.apply_updates(f, changes, "id", ["resolved", "resolution"], latest="ts").select("id", "resolved", "resolution")


@query("marked_experiences", with_sql("experiences", """
SELECT id, CASE WHEN processed_at IS NOT NULL THEN epoch_us(processed_at) WHEN id % 3 = 0 THEN 1735689600000000 END AS processed_us FROM experiences"""))
def marked_experiences(t):
    x = B.experiences(t)
    return U.mark_processed(x, x.where("id % 3 = 0"), now()).select("id", F.unix_micros("processed_at").alias("processed_us"))


@query("purged_failures", with_sql("failures", """
SELECT id FROM failures WHERE NOT (ts < TIMESTAMP '2024-01-21' - INTERVAL 24 HOUR AND resolved) AND id % 11 <> 0"""))
def purged_failures(t):
    f = B.failures(t)
    kept = U.purge(f, U.older_than("ts", F.lit("2024-01-21").cast("timestamp"), 24) & F.col("resolved"))
    return U.delete_by_id(kept, f.where("id % 11 = 0")).select("id")


@query("stale_parts", """
WITH u AS (SELECT 'p' || l_partkey AS name, max(l_shipdate) AS last FROM lineitem GROUP BY 1),
i AS (SELECT 'p' || p_partkey AS name, TIMESTAMP '1999-01-01' + INTERVAL (p_size) DAY AS modified FROM part)
SELECT name, floor((epoch_us(TIMESTAMP '2001-01-01') - epoch_us(coalesce(last, modified))) / 86400000000.0)::BIGINT AS idle_days FROM i LEFT JOIN u USING (name)
WHERE (epoch_us(TIMESTAMP '2001-01-01') - epoch_us(coalesce(last, modified))) / 86400000000.0 > 50""")
def stale_parts(t):
    items = t.part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"),
                          (F.lit("1999-01-01").cast("timestamp") + F.make_dt_interval(F.col("p_size"))).alias("modified_at"))
    usage = t.lineitem.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name"), F.col("l_shipdate").alias("ts"))
    return U.stale_items(items, usage, F.lit("2001-01-01").cast("timestamp"), 50).select("name", "idle_days")


# --- knowledge -----------------------------------------------------------------------

LIBS = ["prisma", "React", "docker", "Express", ""]
SOURCES = ["context7", "web", "manual"]
QUESTIONS = ["prisma the query", "React with hand", "docker de la maison"]


def knowledge(t):
    d = F.col("doc_id")
    return B.dealt(t.documents, "source", "doc_id").select(
        F.col("doc_id").alias("id"), F.timestamp_micros(F.lit(NOW_US) - (d % 120) * F.lit(86400000000)).alias("ts"),
        F.when(d % 13 == 0, "").otherwise(F.concat(F.lit("Topic "), (d % 17).cast("string"), F.lit(" query"))).alias("topic"),
        pick(LIBS, d % 5).alias("library"), pick(SOURCES, d % 3).alias("source"), F.col("text").alias("content"),
        F.array("lang", F.concat(F.lit("with "), "source")).alias("relevance"),
        F.array(F.concat(F.lit("hand"), (d % 9).cast("string")), F.lit("Docker")).alias("tags"))


define("knowledge", f"""
SELECT doc_id AS id, make_timestamp({NOW_US} - (doc_id % 120) * 86400000000) AS ts, CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'Topic ' || (doc_id % 17) || ' query' END AS topic,
 list_extract({lit_list(LIBS)}, (doc_id % 5)::INT + 1) AS library, list_extract({lit_list(SOURCES)}, (doc_id % 3)::INT + 1) AS source, text AS content,
 [lang, 'with ' || source] AS relevance, ['hand' || (doc_id % 9), 'Docker'] AS tags FROM documents""")


def _rel_sql(text: str) -> str:
    low = text.lower()
    ws = [w for w in low.split() if len(w) > 2]
    s = []
    for f, a, b in (("topic", 10, 5), ("library", 8, 4)):
        s.append(f"CASE WHEN contains(lower({f}), {q(low)}) THEN {a} ELSE 0 END")
        s += [f"CASE WHEN contains(lower({f}), {q(w)}) THEN {b} ELSE 0 END" for w in ws]
    for f, a, b in (("relevance", 6, 3), ("tags", 5, 2)):
        inner = " + ".join(f"CASE WHEN contains(lower(v), {q(w)}) THEN {b} ELSE 0 END" for w in ws)
        s.append(f"list_sum(list_transform({f}, lambda v: CASE WHEN contains(lower(v), {q(low)}) THEN {a} ELSE {inner} END))")
    s.append(f"CASE WHEN contains(lower(content), {q(low)}) THEN 3 ELSE 0 END")
    s += [f"least((length(lower(content)) - length(replace(lower(content), {q(w)}, ''))) / {len(w)} * 0.5::DOUBLE, 5.0::DOUBLE)" for w in ws]
    return " + ".join(s)


define("relevance", " UNION ALL ".join(
    f"SELECT {q(x)} AS query, k.*, ({_rel_sql(x)})::DOUBLE AS base, CASE WHEN ({NOW_US} - epoch_us(ts)) / 86400000000.0 < 30 THEN 2.0::DOUBLE WHEN ({NOW_US} - epoch_us(ts)) / 86400000000.0 < 90 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS fresh FROM knowledge k"
    for x in QUESTIONS), ("knowledge",))


@query("knowledge_relevance", with_sql("relevance", "SELECT query, id, base + fresh AS score FROM relevance WHERE base > 0 AND base + fresh >= 2"))
def knowledge_relevance(t):
    return KN.relevance(knowledge(t), QUESTIONS, now()).select("query", "id", "score")


@query("knowledge_top", with_sql("relevance", """
SELECT query, id, score FROM (SELECT query, id, base + fresh AS score, row_number() OVER (PARTITION BY query ORDER BY base + fresh DESC, id) AS rn FROM relevance WHERE base > 0 AND base + fresh >= 2) WHERE rn <= 20"""))
def knowledge_top(t):
    return KN.query_knowledge(knowledge(t), QUESTIONS, now()).select("query", "id", "score")


@query("knowledge_sentences", with_sql("relevance", r"""
, t3 AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY base + fresh DESC, id) AS rn FROM relevance WHERE base > 0 AND base + fresh >= 2),
s AS (SELECT query, library, rn, trim(list_filter(string_split_regex(content, '[.!?\n]'), lambda x: x <> '')[1]) AS sentence FROM t3 WHERE rn <= 3)
SELECT query, arg_min(library, rn) AS library, arg_min(sentence, rn) AS sentence FROM s WHERE length(sentence) < 200 GROUP BY 1"""))
def knowledge_sentences(t):
    return KN.knowledge_sentences(knowledge(t), QUESTIONS, now())


define("asked", f"""
SELECT query, list_filter(string_split_regex(lower(query), '\\s+'), lambda w: length(w) > 2) AS w FROM (
 SELECT DISTINCT lower(p_brand) || ' with ' || p_name AS query FROM part UNION SELECT DISTINCT 'Prisma ' || replace(target, '/', ' ') || ' topic ' FROM page_imports)
WHERE len(list_filter(string_split_regex(lower(query), '\\s+'), lambda w: length(w) > 2)) > 0""", ("page_imports",))


def _points_sql(field: str, whole: int, each: int) -> str:
    return f"CASE WHEN contains(lower({field}), lower(query)) THEN {whole} ELSE 0 END + list_sum(list_transform(w, lambda x: CASE WHEN contains(lower({field}), x) THEN {each} ELSE 0 END))"


def _element_sql(field: str, whole: int, each: int) -> str:
    return f"list_sum(list_transform({field}, lambda v: CASE WHEN contains(lower(v), lower(query)) THEN {whole} ELSE list_sum(list_transform(w, lambda x: CASE WHEN contains(lower(v), x) THEN {each} ELSE 0 END)) END))"


_REL = f"""({_points_sql("topic", 10, 5)} + {_points_sql("library", 8, 4)} + {_element_sql("relevance", 6, 3)} + {_element_sql("tags", 5, 2)}
 + CASE WHEN contains(lower(content), lower(query)) THEN 3 ELSE 0 END
 + list_sum(list_transform(w, lambda x: least((length(lower(content)) - length(replace(lower(content), x, ''))) / length(x) * 0.5::DOUBLE, 5.0::DOUBLE))))::DOUBLE"""
_FRESH = f"CASE WHEN ({NOW_US} - epoch_us(ts)) / 86400000000.0 < 30 THEN 2.0::DOUBLE WHEN ({NOW_US} - epoch_us(ts)) / 86400000000.0 < 90 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"


def asked(t):
    """Questions as a table, from brands, names and link targets."""
    from .specs import page_imports

    brands = t.part.select(F.concat(F.lower("p_brand"), F.lit(" with "), F.col("p_name")).alias("query"))
    links = page_imports(t).select(F.concat(F.lit("Prisma "), F.replace("target", F.lit("/"), F.lit(" ")), F.lit(" topic ")).alias("query"))
    return brands.unionByName(links).distinct()


@query("knowledge_top_by_table", with_sql("asked knowledge", f"""
, r AS (SELECT query, id, {_REL} AS base, {_FRESH} AS fresh FROM asked, knowledge)
SELECT query, id, base + fresh AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY base + fresh DESC, id) AS rn FROM r WHERE base > 0 AND base + fresh >= 2) WHERE rn <= 20"""))
def knowledge_top_by_table(t):
    return KN.query_knowledge(knowledge(t), asked(t), now()).select("query", "id", "score")


@query("suggested_practices", with_sql("knowledge", f"""
, p(task, framework, priority, title) AS (VALUES {", ".join(f"({q(a)}, {q(b)}, {q(c)}, {q(d)})" for a, b, c, d in KR.PRACTICES)}),
asked AS (SELECT DISTINCT task, framework, task || ' ' || framework AS query, list_filter(string_split_regex(lower(task || ' ' || framework), '\\s+'), lambda w: length(w) > 2) AS w FROM p),
r AS (SELECT task, framework, query, k.*, {_REL} AS base, {_FRESH} AS fresh FROM asked, knowledge k),
t20 AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY base + fresh DESC, id) AS rn FROM r WHERE base > 0 AND base + fresh >= 2)
SELECT task, framework, title, 'rules' AS source, priority, CASE priority WHEN 'high' THEN 0 ELSE 1 END AS rank FROM p
UNION ALL SELECT task, framework, library || ': ' || topic, source || ' — ' || library, 'medium', 1 FROM t20 WHERE rn <= 20
 AND (contains(lower(content), 'best practice') OR contains(lower(content), 'recommend') OR contains(lower(content), 'should'))"""))
def suggested_practices(t):
    """Every (task, framework) of the practice table."""
    pairs = [(task, framework) for task, framework, _, _ in KR.PRACTICES]
    return KN.suggest_practices(knowledge(t), pairs, now())


def _tip_sql() -> str:
    rows = []
    for i, (cat, kws, _) in enumerate(KR.TIPS):
        s = "0"
        for kw in kws:
            s += f" + CASE WHEN contains(lower(content), {q(kw)}) THEN 2 ELSE 0 END"
            s += "".join(f" + CASE WHEN contains(lower(content), {q(p)}) THEN 1 ELSE 0 END" for p in kw.split() if len(p) > 2)
        rows.append(f"SELECT id, {i} AS i, {q(cat)} AS category, {s} AS score FROM messages")
    return " UNION ALL ".join(rows)


@query("context_tips", with_sql("messages", f"""
, s AS ({_tip_sql()}) SELECT id, CASE WHEN max(score) > 0 THEN arg_max(category, (score, -i)) END AS category, max(score)::INT AS tip_score FROM s GROUP BY 1"""))
def context_tips(t):
    return KN.context_tips(B.messages(t)).select("id", "category", "tip_score")


@query("knowledge_stats", with_sql("knowledge", """
SELECT 'library' AS dim, coalesce(nullif(library, ''), 'unknown') AS key, count(*) AS n FROM knowledge GROUP BY 2
UNION ALL SELECT 'source', s, count(id) FROM (VALUES ('context7'), ('web'), ('manual')) v(s) LEFT JOIN knowledge ON source = s GROUP BY 2
UNION ALL (SELECT 'topic', coalesce(nullif(topic, ''), 'untagged') AS k, count(*) AS n FROM knowledge GROUP BY 2 ORDER BY n DESC, k LIMIT 10)"""))
def knowledge_stats(t):
    return KN.knowledge_stats(knowledge(t))


# --- trade-offs ----------------------------------------------------------------------

LEVELS = ["low", "medium", "high"]


def tradeoffs(t):
    pk = F.col("p_partkey")

    def approach(i: int):
        return F.struct(
            F.lit(f"Option {'ABC'[i]}").alias("name"), ((pk + i) % 5).cast("int").alias("n_pros"), ((pk * 2 + i) % 4).cast("int").alias("n_cons"),
            pick(LEVELS, (pk + i) % 3).alias("complexity"), pick(LEVELS, (pk * 2 + i) % 3).alias("performance"),
            pick(LEVELS, (F.col("p_size") + i) % 3).alias("maintainability"), pick(LEVELS, (pk + 2 * i) % 3).alias("security"))

    full = F.array(*[approach(i) for i in range(3)])
    return t.part.select(
        pk.alias("id"), F.concat_ws(" ", "p_name", F.lower("p_type"), "p_brand").alias("context"),
        F.slice(full, F.lit(1), (pk % 4).cast("int")).alias("approaches"),
        pick(["Option A", "option-b", "Option B", "OPTION C"], pk % 4).alias("recommended"),
        pick(["validated", "wrong", "unknown"], F.col("p_size") % 3).alias("outcome"))


define("tradeoffs", """
SELECT p_partkey AS id, concat_ws(' ', p_name, lower(p_type), p_brand) AS context, p_size, p_partkey % 4 AS n,
 list_extract(['Option A', 'option-b', 'Option B', 'OPTION C'], (p_partkey % 4)::INT + 1) AS recommended, list_extract(['validated', 'wrong', 'unknown'], (p_size % 3)::INT + 1) AS outcome FROM part""")
define("approach_scores", """
SELECT id, i, 'Option ' || ['A', 'B', 'C'][i + 1] AS name, (id + i) % 5 - (id * 2 + i) % 4 + 3 - (id + i) % 3 + 1 + (id * 2 + i) % 3 + 1 + (p_size + i) % 3 + 1 + (id + 2 * i) % 3 AS score,
 (id + i) % 5 - (id * 2 + i) % 4 + 12 - (id + i) % 3 - (id * 2 + i) % 3 - (p_size + i) % 3 - (id + 2 * i) % 3 AS compat FROM tradeoffs, (VALUES (0), (1), (2)) v(i) WHERE i < n""", ("tradeoffs",))


def _rec_sql(col: str) -> str:
    return f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {col} DESC, i) AS rn FROM approach_scores),
a AS (SELECT id, max(name) FILTER (rn = 1) AS name, max({col}) FILTER (rn = 1) AS s1, max({col}) FILTER (rn = 2) AS s2, count(*) AS n FROM r GROUP BY 1)
SELECT t.id, coalesce(name, '') AS recommended, s1::INT AS score, CASE WHEN a.n IS NULL THEN 0.0 WHEN a.n = 1 THEN 0.5 ELSE least((s1 - s2)::DOUBLE / greatest(s1, 1), 1.0::DOUBLE) END::DOUBLE AS confidence FROM tradeoffs t LEFT JOIN a USING (id)"""


@query("recommended_approaches", with_sql("approach_scores", _rec_sql("score")))
def recommended_approaches(t):
    return DC.recommend(tradeoffs(t))


@query("recommended_approaches_compat", with_sql("approach_scores", _rec_sql("compat")))
def recommended_approaches_compat(t):
    return DC.recommend(tradeoffs(t), compat=True)


@query("tradeoff_outcomes", with_sql("tradeoffs", "SELECT outcome, count(*) AS n FROM tradeoffs GROUP BY 1"))
def tradeoff_outcomes(t):
    return DC.outcome_counts(tradeoffs(t))


@query("tradeoff_stats", with_sql("tradeoffs", """
, k AS (SELECT *, regexp_replace(lower(recommended), '[^a-z0-9]', '', 'g') AS k FROM tradeoffs)
SELECT arg_min(recommended, id) AS approach, count(*) FILTER (outcome = 'validated') AS validated, count(*) FILTER (outcome = 'wrong') AS wrong, count(*) FILTER (outcome <> 'unknown') AS total,
 count(*) FILTER (outcome = 'validated')::DOUBLE / count(*) FILTER (outcome <> 'unknown')::DOUBLE AS accuracy FROM k GROUP BY k"""))
def tradeoff_stats(t):
    return DC.tradeoff_stats(tradeoffs(t))


_CTX = ["small ring economy Brand#2", "red widget standard"]


def _jac(col: str, text: str) -> str:
    toks = sorted({w for w in "".join(c for c in text.lower() if c.isalnum() or c == " ").split() if len(w) > 2})
    return f"""SELECT {q(text)} AS query, id, len(list_intersect(w, {lit_list(toks)})) AS c, len(w) + {len(toks)} - len(list_intersect(w, {lit_list(toks)})) AS u FROM toks"""


define("toks", r"""SELECT id, list_distinct(list_filter(string_split_regex(regexp_replace(lower(context), '[^a-z0-9\s]', '', 'g'), '\s+'), lambda x: length(x) > 2)) AS w FROM tradeoffs""", ("tradeoffs",))


@query("similar_decisions", with_sql("toks", f"""
, j AS ({" UNION ALL ".join(_jac("w", c) for c in _CTX)}), s AS (SELECT query, id, c::DOUBLE / u AS similarity, row_number() OVER (PARTITION BY query ORDER BY c::DOUBLE / u DESC, id) AS rn FROM j WHERE c::DOUBLE / u > 0.1)
SELECT query, id, similarity FROM s WHERE rn <= 5"""))
def similar_decisions(t):
    return DC.similar_contexts(tradeoffs(t), _CTX)


@query("similar_decisions_by_table", with_sql("toks", r"""
, c AS (SELECT query, list_distinct(list_filter(string_split_regex(regexp_replace(lower(query), '[^a-z0-9\s]', '', 'g'), '\s+'), lambda x: length(x) > 2)) AS v
  FROM (SELECT DISTINCT p_name || ' for ' || lower(p_type) || ' on ' || p_brand || ' by ' || p_name AS query FROM part)),
j AS (SELECT query, id, len(list_intersect(v, w)) AS n, len(v) + len(w) AS total FROM c, toks),
s AS (SELECT query, id, n::DOUBLE / (total - n) AS similarity, row_number() OVER (PARTITION BY query ORDER BY n::DOUBLE / (total - n) DESC, id) AS rn FROM j WHERE n::DOUBLE / (total - n) > 0.1)
SELECT query, id, similarity FROM s WHERE rn <= 5"""))
def similar_decisions_by_table(t):
    """Every distinct name, kind and brand of the part table as a context."""
    contexts = t.part.select(F.concat("p_name", F.lit(" for "), F.lower("p_type"), F.lit(" on "), "p_brand", F.lit(" by "), "p_name").alias("query"))
    return DC.similar_contexts(tradeoffs(t), contexts)


@query("context_overlap", with_sql("toks", f"""
SELECT id, len(list_intersect(w, ['small', 'ring', 'economy', 'brand2'])) AS common, len(list_distinct(list_concat(w, ['small', 'ring', 'economy', 'brand2']))) AS all FROM toks"""))
def context_overlap(t):
    both = DC.overlap(X.tokens(F.col("context")), X.tokens(F.lit("small ring economy Brand#2")))
    return tradeoffs(t).select("id", both.alias("_o")).select("id", "_o.common", "_o.all")


