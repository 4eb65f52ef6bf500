"""Prompt, session, compaction and complexity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.jsons import is_json
from ..operators import compaction as CP, complexity as CX, mutate as U, prompts as P, sessions as S
from ..rules import prompts as PR, words
from ..session import pinned
from ..sources.logs import parse_session_log
from . import bindings as B
from .bindings import define, pick, with_sql
from .logs import session_lines
from .registry import query
from .scans import q

# conversations plus a deterministic clause, so that keywords occur
ASKS = ["please refactor the api and add tests", "deploy to production server", "what is the slow query", "fix typo in src/a.ts and lib/b.py",
        "rm -rf / now", "buat migration for authentication src/ lib/ app/ test/ x.go", "thanks"]


def prompts(t):
    return t.conversations.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.concat_ws(" ", pick(ASKS, (F.col("conv_id") + F.col("turn")) % len(ASKS)), "text").alias("text"), "conv_id", "turn")


define("prompts", f"""
SELECT conv_id || '-' || turn AS id, list_extract({B.lit_list(ASKS)}, ((conv_id + turn) % {len(ASKS)})::INT + 1) || ' ' || text AS text, conv_id, turn FROM conversations""")
_WORDS = r"len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))"


@query("prompt_intents", with_sql("prompts", f"""
, l AS (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS low, {_WORDS} AS n FROM prompts),
h AS (SELECT *, list_filter([{", ".join(f"CASE WHEN regexp_matches(low, {q(chr(92) + 'b(?:' + p + ')' + chr(92) + 'b')}) THEN '{i}' END" for i, p in PR.INTENTS)}], lambda x: x IS NOT NULL) AS k FROM l),
g AS (SELECT * REPLACE (CASE WHEN len(list_filter(k, lambda x: x NOT IN ('batch', 'export', 'plan', 'ask'))) = 0 AND regexp_matches(low, {q(chr(92) + 'b(?:' + PR.CODE_WORDS + ')' + chr(92) + 'b')}) THEN list_append(k, 'implement') ELSE k END AS k) FROM h)
SELECT id, n::INT AS words, array_to_string(k, ',') AS intents, coalesce(k[1], 'unknown') AS primary_intent, CASE WHEN n > 150 THEN 'complex' WHEN n > 50 THEN 'standard' ELSE 'simple' END AS complexity,
 CASE WHEN regexp_matches(low, {q(PR.SECOND_LANGUAGE[1])}) THEN 'id' ELSE 'en' END AS language,
 CASE {" ".join(f"WHEN regexp_matches(low, {q(p)}) THEN '{s}'" for _, s, p in PR.RISKS)} ELSE 'low' END AS risk FROM g"""))
def prompt_intents(t):
    return P.prompt_intents(prompts(t)).select("id", "words", "intents", "primary_intent", "complexity", "language", "risk")


#: One prompt per skill in each language, code words alone, and none.
SAID = [
    "deploy the container with helm", "refactor this layer separation", "cek struktur dan kelemahan kode", "bikin fitur baru untuk endpoint ini", "perbaiki bug yang gagal",
    "brainstorm a trade-off", "rekomendasi alternatif", "susun rencana dan tahapan", "write a unit test", "uji dengan pengujian", "draw a call graph", "update the readme",
    "store this lesson for cross agent use", "simpan pelajaran ini, ingat", "hardcoded credential in the env file", "npm audit for a cve", "tak terpakai, mati kode",
    "optimasi query yang lambat", "susun ulang dan rapikan", "server in production", "folder tsconfig", "bulk edit of kode", "jelaskan kode ini", "terima kasih"]


def said(t):
    return t.conversations.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.concat_ws(" ", pick(SAID, (F.col("conv_id") * 5 + F.col("turn")) % len(SAID)), F.when(F.col("conv_id") % 3 == 0, F.col("text"))).alias("text"))


def _has(pattern: str) -> str:
    return f"regexp_matches(low, {q(chr(92) + 'b(?:' + pattern + ')' + chr(92) + 'b')})"


_SAID_SQL = f"""
WITH s AS (SELECT conv_id || '-' || turn AS id, list_extract({B.lit_list(SAID)}, ((conv_id * 5 + turn) % {len(SAID)})::INT + 1) || CASE WHEN conv_id % 3 = 0 THEN ' ' || text ELSE '' END AS text FROM conversations),
l AS (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS low, {_WORDS} AS n FROM s)"""


@query("context_intents", _SAID_SQL + f""",
h AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {_has(p)} THEN {{'s': '{a}', 'i': '{b}'}} END" for a, b, p in PR.CONTEXT_SKILLS[:-1])}], lambda x: x IS NOT NULL) AS k, {_has(PR.CONTEXT_SKILLS[-1][2])} AS late FROM l),
g AS (SELECT *, CASE WHEN len(k) > 0 THEN list_transform(k, lambda x: x.s) WHEN late THEN ['deploy-docker'] ELSE ['none'] END AS sk, CASE WHEN len(k) > 0 THEN list_transform(k, lambda x: x.i) WHEN late THEN ['deploy'] ELSE ['unknown'] END AS it FROM h)
SELECT id, n::INT AS words, array_to_string(sk, ',') AS skills, array_to_string(it, ',') AS intents, it[1] AS primary_intent,
 CASE WHEN n > 150 THEN 'complex' WHEN {_has(PR.ORDINARY_WORDS)} AND n > 20 THEN 'standard' WHEN {_has(PR.LARGE_WORDS)} THEN 'complex' WHEN n > 50 THEN 'standard' ELSE 'simple' END AS complexity,
 CASE WHEN regexp_matches(low, {q(PR.SECOND_LANGUAGE[1])}) THEN 'id' ELSE 'en' END AS language,
 CASE {" ".join(f"WHEN regexp_matches(low, {q(p)}) THEN '{s}'" for _, s, p in PR.RISKS)} ELSE 'low' END AS risk FROM g""")
def context_intents(t):
    return P.context_intents(said(t)).select("id", "words", "skills", "intents", "primary_intent", "complexity", "language", "risk")


@query("code_word_intents", _SAID_SQL + f""",
h AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {_has(p)} THEN '{i}' END" for i, p in PR.INTENTS)}], lambda x: x IS NOT NULL) AS k FROM l)
SELECT id, array_to_string(CASE WHEN len(list_filter(k, lambda x: x NOT IN ('batch', 'export', 'plan', 'ask'))) = 0 AND {_has(PR.CODE_WORDS)} THEN list_append(k, 'implement') ELSE k END, ',') AS intents FROM h""")
def code_word_intents(t):
    """Prompts without a skill of their own that name code."""
    return P.prompt_intents(said(t)).select("id", "intents")


@query("task_complexity", with_sql("prompts", f"""
, s AS (SELECT id, {_WORDS} AS n, len(regexp_extract_all(text, {q(PR.FILE_MENTION)})) AS f, regexp_matches(text, {q(PR.COMPLEX_TASK)}) AS c, regexp_matches(text, {q(PR.SIMPLE_TASK)}) AS e FROM prompts),
p AS (SELECT id, greatest(0, least(8, CASE WHEN n > 80 THEN 3 WHEN n > 40 THEN 2 WHEN n > 20 THEN 1 ELSE 0 END + CASE WHEN f >= 5 THEN 3 WHEN f >= 3 THEN 2 WHEN f >= 1 THEN 1 ELSE 0 END + CASE WHEN c THEN 2 ELSE 0 END - CASE WHEN e THEN 2 ELSE 0 END)) AS score FROM s)
SELECT id, score, CASE WHEN score >= 5 THEN 'COMPLEX' WHEN score >= 3 THEN 'MODERATE' ELSE 'SIMPLE' END AS level FROM p"""))
def task_complexity(t):
    return P.task_complexity(prompts(t)).select("id", "score", "level")


COMMANDS = ["rm -rf /", "rm -r build", "git push --force origin main", "git push -f origin dev", "git push --force-with-lease origin main", "ls -la", "sudo rm  -fR  ~/", "rm -rf ./*"]


@query("risky_commands", """
SELECT event_id AS id, CASE event_id % 8 WHEN 0 THEN 'rm_root' WHEN 2 THEN 'force_push_main' WHEN 3 THEN 'force_push' WHEN 6 THEN 'rm_root' WHEN 7 THEN 'rm_root' ELSE CASE WHEN user_id % 3 = 0 AND user_id % 2 = 1 THEN 'env_write' ELSE 'none' END END AS rule,
 CASE WHEN event_id % 8 IN (0, 2, 6, 7) THEN 'deny' WHEN event_id % 8 = 3 OR (user_id % 3 = 0 AND user_id % 2 = 1) THEN 'warn' ELSE 'allow' END AS decision FROM events""")
def risky_commands(t):
    u = F.col("user_id")
    cmds = t.events.select(F.col("event_id").alias("id"), pick(COMMANDS, F.col("event_id") % 8).alias("command"),
                           F.when(u % 3 == 0, "app/.env.local").otherwise("app/main.ts").alias("path"), (u % 2 == 0).alias("ignored"))
    return P.risky_commands(cmds).select("id", "rule", "decision")


@query("token_cost", """
WITH m AS (SELECT conv_id, role, text, make_timestamp(1704067200000000 + (conv_id * 3600 + turn * 60) * 1000000) AS ts FROM conversations),
a AS (SELECT role, count(DISTINCT conv_id) AS sessions, floor(sum(length(text)) / 4.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS tokens FROM m WHERE ts >= TIMESTAMP '2024-01-06' - INTERVAL 3 DAY GROUP BY 1)
SELECT *, '$' || printf('%.6f', tokens * 0.000003::DOUBLE) AS cost FROM a""")
def token_cost(t):
    logs = B.messages(t).select(F.col("conv_id").alias("session"), "ts", F.col("content").alias("text"), F.col("sender").alias("role"))
    return P.token_cost(logs, F.lit("2024-01-06").cast("timestamp"), 3, ("role",))


@query("cache_hits", """
WITH p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id % 7, role ORDER BY conv_id, turn) > 1 AS hit FROM conversations) SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses FROM p""")
def cache_hits(t):
    """A prefix is a hit when its hash was used before."""
    from ..operators.history import distinct_first

    task = F.concat(F.lit("t"), (F.col("conv_id") % 7).cast("string"))
    rows = t.conversations.select("conv_id", "turn", X.align_prefix(F.col("text"), "demo", task, F.col("role"))["prefix_hash"].alias("h"))
    first = distinct_first(rows, ["h"], [F.col("conv_id"), F.col("turn")]).withColumn("hit", F.lit(False))
    return P.cache_hits(rows.join(first, ["h", "conv_id", "turn"], "left").select(F.coalesce("hit", F.lit(True)).alias("hit")))


@query("aligned_prefixes", """
SELECT conv_id, turn, left(sha256('[PROJECT] demo | task:t' || (conv_id % 7) || ' | mode:' || role || ' | '), 8) AS prefix_hash, length('[PROJECT] demo | task:t' || (conv_id % 7) || ' | mode:' || role || ' | ' || chr(10) || ltrim(text))::INT AS n FROM conversations""")
def aligned_prefixes(t):
    task = F.concat(F.lit("t"), (F.col("conv_id") % 7).cast("string"))
    return t.conversations.select("conv_id", "turn", X.align_prefix(F.col("text"), "demo", task, F.col("role")).alias("_a")).select(
        "conv_id", "turn", "_a.prefix_hash", F.length("_a.aligned").alias("n"))


_RATE = "CASE WHEN {b} > 0 THEN floor({a}::DOUBLE / {b}::DOUBLE * 100::DOUBLE + 0.5::DOUBLE) ELSE 0 END::BIGINT"


@query("session_metrics", with_sql("session_events", f"""
, m AS (SELECT session, {", ".join(f"count(*) FILTER (event = '{e}') AS {k}" for k, e in S.COUNTED.items())}, count(*) FILTER (contains(event, 'FAIL')) AS failures,
 min(clock) FILTER (event = 'PROMPT') AS first_prompt, max(clock) FILTER (event = 'PROMPT') AS last_prompt FROM session_events GROUP BY 1)
SELECT *, {_RATE.format(a="tasks_completed", b="tasks_created")} AS completion_rate, {_RATE.format(a="agents", b="prompts")} AS agent_utilization FROM m"""))
def session_metrics(t):
    return S.session_metrics(parse_session_log(session_lines(t), "text", "session"))


def thoughts(t):
    c, n = F.col("conv_id"), F.col("turn")
    branch = (n > 0) & ((c + n) % 5 == 0)
    rev = (n > 0) & ((c + n) % 4 == 0) & ~branch
    return t.conversations.select(
        c.alias("session"), n.alias("seq"), (n + 1).alias("thought_number"), rev.alias("is_revision"), F.when(rev, n).alias("revises"),
        F.when(branch, n).alias("branch_from"), F.when(branch, F.concat(F.lit("b-"), (n % 2).cast("string"))).alias("branch_id"), (n % 3 != 2).alias("next_needed"))


define("thoughts", """
SELECT conv_id AS session, turn AS seq, turn + 1 AS n, turn > 0 AND (conv_id + turn) % 4 = 0 AND NOT (turn > 0 AND (conv_id + turn) % 5 = 0) AS rev, turn > 0 AND (conv_id + turn) % 5 = 0 AS br, 'b-' || (turn % 2) AS b, turn % 3 <> 2 AS nxt FROM conversations""")


@query("thought_summary", with_sql("thoughts", """
SELECT session, count(*) AS thoughts, count(*) FILTER (rev) AS revisions, count(DISTINCT b) FILTER (br) AS branches, count(*) FILTER (br) AS branch_thoughts, NOT arg_max(nxt, seq) AS completed FROM thoughts GROUP BY 1"""))
def thought_summary(t):
    return S.thought_summary(thoughts(t))


@query("thought_edges", with_sql("thoughts", """
, m AS (SELECT session, n, lag(n) OVER (PARTITION BY session ORDER BY seq) AS p FROM thoughts WHERE NOT rev AND NOT br), s AS (SELECT *, replace(b, '-', '') AS k, lag(n) OVER (PARTITION BY session, b ORDER BY seq) AS p FROM thoughts WHERE br)
SELECT session, 'next' AS kind, 'T' || p AS src, 'T' || n AS dst FROM m WHERE p IS NOT NULL UNION ALL SELECT session, 'revision', 'T' || seq, 'T' || n FROM thoughts WHERE rev
UNION ALL SELECT session, 'branch', 'T' || seq, 'B' || k FROM s WHERE p IS NULL UNION ALL SELECT session, 'step', CASE WHEN p = n - 1 THEN 'B' || k || '_' || p ELSE 'B' || k END, 'B' || k || '_' || n FROM s"""))
def thought_edges(t):
    return S.thought_edges(thoughts(t))


# --- compaction ----------------------------------------------------------------------


@query("compacted_code", with_sql("code_files", r"""
, c AS (SELECT repo, path, content, CASE lower(regexp_extract(path, '(\.[^./]+)$', 1)) WHEN '.py' THEN 'hash' WHEN '.sql' THEN 'none' WHEN '.md' THEN 'none' WHEN '.json' THEN 'none' ELSE 'slash' END AS k FROM code_files),
s AS (SELECT repo, path, content, k, regexp_replace(CASE k WHEN 'slash' THEN regexp_replace(regexp_replace(content, '(https?://)|//[^\n]*', '\1', 'g'), '/\*[\s\S]*?\*/', '', 'g')
   WHEN 'hash' THEN regexp_replace(content, '([''"]#)|#[^\n]*', '\1', 'g') ELSE content END, '\n{3,}', chr(10) || chr(10), 'g') AS x FROM c)
SELECT repo, path, sha256(CASE WHEN k = 'none' THEN content ELSE regexp_replace(x, '\b([a-zA-Z_][a-zA-Z0-9_]{17})[a-zA-Z0-9_]{3,}\b', '\1…', 'g') END) AS digest FROM s"""))
def compacted_code(t):
    f = B.code_files(t)
    return f.select("repo", "path", F.sha2(X.compact_code(F.col("content"), X.code_language(F.col("path"))), 256).alias("digest"))


@query("compacted_prose", """
WITH b AS (SELECT doc_id, array_to_string(list_transform(generate_series(1, 40), lambda i: text || chr(10)), '') AS t FROM documents), l AS (SELECT doc_id, t, string_split(t, chr(10)) AS ls FROM b)
SELECT doc_id, sha256(CASE WHEN len(ls) > 500 THEN array_to_string(list_concat(ls[1:250], ['… [' || (len(ls) - 500) || ' lines collapsed]'], ls[-250:]), chr(10)) ELSE t END) AS digest FROM l""")
def compacted_prose(t):
    big = F.repeat(F.concat("text", F.lit("\n")), F.lit(40))
    return t.documents.select("doc_id", F.sha2(X.compact_prose(big), 256).alias("digest"))


def json_docs(t):
    """Objects with empty, long and renamed fields, and lists of forty small objects."""
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit("0"))
    obj = F.concat(F.lit('{"message":"'), "event_type", F.lit('","description":"'), F.repeat("event_type", F.lit(60)), F.lit('","empty":"","none":null,"count":'), k, F.lit(',"user":{"id":'), F.col("user_id").cast("string"), F.lit("}}"))
    row = F.concat(F.lit('{"name":"'), "event_type", F.lit('","k":'), k, F.lit("}"))
    rows = F.concat(F.lit("["), F.array_join(F.array_repeat(row, 40), ","), F.lit("]"))
    e = F.col("event_id")
    return B.dealt(t.events, "event_id").select(e.alias("id"), F.lit("log.txt").alias("path"), F.when(e % 3 == 0, rows).when(e % 3 == 1, obj).otherwise(F.concat(F.lit("[1,"), k, F.lit("]"))).alias("content"), "ts")


_JSON = """
WITH e AS (SELECT event_id AS id, event_type AS y, user_id AS u, coalesce(json_extract_string(props, '$.k'), '0') AS k, ts FROM events),
c AS (SELECT id, ts, CASE id % 3 WHEN 0 THEN '[' || array_to_string(list_transform(generate_series(1, 40), lambda i: '{"name":"' || y || '","k":' || k || '}'), ',') || ']'
  WHEN 1 THEN '{"message":"' || y || '","description":"' || repeat(y, 60) || '","empty":"","none":null,"count":' || k || ',"user":{"id":' || u || '}}' ELSE '[1,' || k || ']' END AS content,
 CASE id % 3 WHEN 0 THEN '{"_schema":{"k0":"k","k1":"name"},"_count":40,"_items":[' || array_to_string(list_transform(generate_series(1, 30), lambda i: '{"k0":' || k || ',"k1":"' || y || '"}'), ',') || '],"_truncated":10}'
  WHEN 1 THEN '{"count":' || k || ',"desc":"' || CASE WHEN length(repeat(y, 60)) > 200 THEN left(repeat(y, 60), 200) || '…[+' || (length(repeat(y, 60)) - 200) || 'ch]' ELSE repeat(y, 60) END || '","msg":"' || y || '","user":{"id":' || u || '}}'
  ELSE '[1,' || k || ']' END AS short FROM e)"""


@query("compacted_json", _JSON + " SELECT id, sha256(short) AS digest FROM c")
def compacted_json(t):
    return json_docs(t).select("id", F.sha2(CP.compact_json(F.col("content")), 256).alias("digest"))


@query("compacted_contents", _JSON + """
, s AS (SELECT id, strlen(content)::INT AS original_size, strlen(short)::INT AS compacted_size, left(sha256(content), 12) AS hash FROM c)
SELECT id, 'json' AS content_type, original_size, compacted_size, hash, floor((1.0::DOUBLE - compacted_size::DOUBLE / original_size::DOUBLE) * 100::DOUBLE + 0.5::DOUBLE)::DOUBLE / 100::DOUBLE AS ratio FROM s""")
def compacted_contents(t):
    from ..functions.maths import half_up

    return CP.compact(json_docs(t)).select("id", "content_type", "original_size", "compacted_size", "hash", half_up(F.col("ratio"), 2).alias("ratio"))


def stored(t):
    return U.store_originals(CP.compact(json_docs(t)).withColumn("stored_at", F.col("ts")))


_STORE = _JSON + """
, s AS (SELECT id, ts, content, left(sha256(content), 12) AS hash, 1.0::DOUBLE - strlen(short)::DOUBLE / strlen(content)::DOUBLE AS ratio FROM c),
o AS (SELECT *, hash || '-json' AS store_id FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY ts, id) AS rn FROM s WHERE ratio >= 0.15) WHERE rn = 1)"""


@query("stored_originals", _STORE + " SELECT store_id, id FROM o")
def stored_originals(t):
    return stored(t).select("store_id", "id")


@query("restored_originals", _STORE + """
, w AS (SELECT CASE WHEN id % 2 = 0 THEN store_id WHEN id % 3 = 0 THEN left(store_id, (id % 4)::INT + 1) ELSE left(store_id, 8) END AS wanted FROM o)
SELECT DISTINCT w.wanted, arg_min(o.store_id, o.store_id) OVER (PARTITION BY w.wanted) AS store_id FROM (SELECT DISTINCT wanted FROM w) w JOIN o ON o.store_id = w.wanted OR (starts_with(o.store_id, w.wanted) AND w.wanted NOT IN (SELECT store_id FROM o))""")
def restored_originals(t):
    store = pinned(stored(t).select("store_id", "id", "content"))
    wanted = store.select(F.when(F.col("id") % 2 == 0, F.col("store_id")).when(F.col("id") % 3 == 0, F.left("store_id", (F.col("id") % 4 + 1).cast("int"))).otherwise(F.left("store_id", F.lit(8))).alias("store_id")).distinct()
    return U.restore(store, wanted).select("wanted", "store_id")


@query("original_store_stats", _STORE + """
, r AS (SELECT count(*) AS entries, sum(strlen(content))::BIGINT AS bytes, floor(avg(ratio) * 100::DOUBLE + 0.5::DOUBLE)::DOUBLE / 100::DOUBLE AS average_ratio FROM o)
SELECT 'json' AS content_type, * FROM r UNION ALL SELECT '(total)', * FROM r""")
def original_store_stats(t):
    return CP.store_stats(stored(t))


@query("content_types", with_sql("code_files", r"""
SELECT repo, path, CASE WHEN regexp_matches(trim(content), '^[{\[]') AND json_valid(content) THEN 'json' WHEN regexp_matches(path, '\.(ts|js|tsx|jsx|py|go|java)$') THEN 'code' ELSE 'prose' END AS content_type FROM code_files"""))
def content_types(t):
    return B.code_files(t).select("repo", "path", X.content_type(F.col("content"), F.col("path")).alias("content_type"))


@query("json_validity", "SELECT event_id, json_valid(CASE event_id % 4 WHEN 0 THEN '{' || props ELSE props END) AS valid FROM events")
def json_validity(t):
    return t.events.select("event_id", is_json(F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))).alias("valid"))


@query("prompt_versions", with_sql("code_files", r"""
, p AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'prompts/v1.' || (doc_id % 9) || '.2/a.md' WHEN 1 THEN 'skills/My Note ' || doc_id || '.md' ELSE 'agents/x.txt' END AS path, doc_id FROM code_files)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '1.' || (doc_id % 9) || '.2' WHEN 1 THEN '1.0.0-my-note-' || doc_id ELSE '1.0.0-unversioned' END AS version FROM p"""))
def prompt_versions(t):
    d = F.col("doc_id")
    s = d.cast("string")
    path = (F.when(d % 3 == 0, F.concat(F.lit("prompts/v1."), (d % 9).cast("string"), F.lit(".2/a.md")))
            .when(d % 3 == 1, F.concat(F.lit("skills/My Note "), s, F.lit(".md"))).otherwise("agents/x.txt"))
    return t.documents.select("doc_id", X.prompt_version(path).alias("version"))


@query("size_advice", """
SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f', floor(b / 1024.0::DOUBLE * 10 + 0.5) / 10.0::DOUBLE) || ' KB' ELSE printf('%.1f', floor(b / 1048576.0::DOUBLE * 10 + 0.5) / 10.0::DOUBLE) || ' MB' END AS shown,
 CASE WHEN floor(b / 1024.0::DOUBLE + 0.5::DOUBLE) < 5 THEN 'small' WHEN floor(b / 1024.0::DOUBLE + 0.5::DOUBLE) < 15 THEN 'split_consider' ELSE 'split' END AS advice FROM (SELECT doc_id, strlen(text) AS b FROM documents)""")
def size_advice(t):
    b = F.octet_length("text")
    return t.documents.select("doc_id", X.human_bytes(b).alias("shown"), X.size_advice(b).alias("advice"))


@query("slugs", r"""
SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(h), '[^a-zA-Z0-9\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')) AS kebab,
 regexp_replace(regexp_replace(lower(h), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, regexp_replace(lower(h), '[^a-z0-9]', '', 'g') AS norm,
 CASE WHEN regexp_matches(h, '^\d') THEN '_' ELSE '' END || regexp_replace(h, '[^a-zA-Z0-9_]', '_', 'g') AS safe FROM (SELECT doc_id, left(text, 60) AS h FROM documents)""")
def slugs(t):
    h = F.left("text", F.lit(60))
    return t.documents.select("doc_id", X.kebab(h).alias("kebab"), X.slug(h).alias("slug"), X.norm_name(h).alias("norm"), X.sanitize_id(h).alias("safe"))


_ID = "list_concat(" + ", ".join(f"regexp_extract_all(content, {q(p)}, 1)" for p in words.DECLARATION_PATTERNS) + ")"


@query("declared_names", with_sql("code_files", f"""
, n AS (SELECT repo, path, unnest(list_distinct({_ID})) AS name FROM code_files)
SELECT repo, path, name, CASE {" ".join(f"WHEN regexp_matches(name, {q(p)}) THEN '{s}'" for s, p in words.NAMING_STYLES.items())} ELSE 'unknown' END AS style FROM n"""))
def declared_names(t):
    return B.code_files(t).select("repo", "path", F.explode(X.identifiers(F.col("content"))).alias("name")).withColumn("style", X.naming_style(F.col("name")))


# --- complexity ----------------------------------------------------------------------


def _places(name: str, rx: str, text: str = "content") -> str:
    """Texts and 0-based places of all matches of a pattern, from what lies between them."""
    return (f"list_transform(range(1, len({name}x) + 1), lambda k: {{'m': {name}x[k], 'pos': (list_sum(list_transform({name}p[1:k], lambda z: length(z))) "
            f"+ coalesce(list_sum(list_transform({name}x[1:k - 1], lambda z: length(z))), 0))::BIGINT}}) AS {name}",
            f"string_split_regex({text}, {q(rx)}) AS {name}p, regexp_extract_all({text}, {q(rx)}) AS {name}x")


_POINTS = [("d" + str(i), ("(?m)" if p.pattern.startswith("^") else "") + p.pattern) for i, p in enumerate(CX.DECISIONS)]
_ALL_PLACES = [_places("f", CX.FUNCTION.pattern), _places("w", CX.ARROW.pattern), *[_places(n, p) for n, p in _POINTS], _places("b", "[{}]")]
_NAME = " ".join(f"WHEN regexp_matches(m, {q(p.pattern)}) THEN regexp_extract(m, {q(p.pattern)}, 1)" for p in CX.NAMES)
define("found_functions", f"""
WITH src AS (SELECT doc_id, repo, path, coalesce(content, '') AS content FROM code_files),
cut AS (SELECT *, {", ".join(c for _, c in _ALL_PLACES)} FROM src),
spots AS (SELECT doc_id, repo, path, content, {", ".join(a for a, _ in _ALL_PLACES)} FROM cut),
brace AS (SELECT doc_id, u.pos AS pos, u.m AS m, sum(CASE u.m WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY u.pos) AS s FROM (SELECT doc_id, unnest(b) AS u FROM spots)),
deep AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY pos)) AS depth FROM brace),
pair AS (SELECT o.doc_id, o.pos AS open, min(c.pos) AS close FROM deep o LEFT JOIN deep c ON c.doc_id = o.doc_id AND c.m = '}}' AND c.pos > o.pos AND c.depth = o.depth - 1 WHERE o.m = '{{' GROUP BY ALL),
point AS (SELECT doc_id, unnest(list_concat({", ".join(n for n, _ in _POINTS)})).pos AS pos FROM spots),
shape AS (SELECT doc_id, repo, path, content, 0 AS kind, unnest(f) AS u FROM spots UNION ALL SELECT doc_id, repo, path, content, 1, unnest(w) FROM spots),
line AS (SELECT doc_id, repo, path, content, kind, u.m AS m, u.pos AS pos, 1 + length(left(content, u.pos::INT)) - length(replace(left(content, u.pos::INT), chr(10), '')) AS line FROM shape),
one AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY kind, pos) AS rn FROM line),
body AS (SELECT *, pos + length(m) + length(regexp_extract(substr(content, (pos + length(m) + 1)::INT), '^\\s*')) AS solid FROM one WHERE rn = 1),
span AS (
 SELECT b.*, CASE WHEN m = '' THEN '' {_NAME} ELSE '(anonymous)' END AS name, pos AS start, p.close + 1 AS stop FROM body b JOIN pair p ON p.doc_id = b.doc_id AND p.open = (SELECT min(open) FROM pair z WHERE z.doc_id = b.doc_id AND z.open >= b.pos) WHERE kind = 0 AND p.close IS NOT NULL
 UNION ALL SELECT b.*, regexp_extract(m, {q(CX.ARROW.pattern)}, 1), solid,
  CASE WHEN substr(content, (solid + 1)::INT, 1) = '{{' THEN coalesce(p.close, length(content) - 1) + 1
   ELSE solid + length(regexp_extract(substr(content, (solid + 1)::INT), '^[^;,]*')) END
  FROM body b LEFT JOIN pair p ON p.doc_id = b.doc_id AND p.open = solid WHERE kind = 1)
SELECT doc_id, repo, path, name, line::INT AS line, 1 + (SELECT count(*) FROM point p WHERE p.doc_id = span.doc_id AND p.pos >= start AND p.pos < stop)::INT AS complexity,
 CASE WHEN trim(regexp_extract(m, '\\(([^)]*)\\)', 1)) = '' THEN 0 ELSE len(string_split(regexp_extract(m, '\\(([^)]*)\\)', 1), ',')) END::INT AS params,
 (1 + length(substr(content, (start + 1)::INT, (stop - start)::INT)) - length(replace(substr(content, (start + 1)::INT, (stop - start)::INT), chr(10), '')))::INT AS n_lines FROM span""", ("code_files",))


#: Files whose functions are looked for.
CODE_PATH = r"\.(ts|tsx|js|jsx|java|go)$"
define("code_fns", f"SELECT * FROM found_functions WHERE regexp_matches(path, {q(CODE_PATH)})", ("found_functions",))


def code_functions(t, keep="true"):
    return CX.discover_functions(B.code_files(t).where(F.col("path").rlike(CODE_PATH)).where(keep))


@query("discovered_functions", with_sql("code_fns", "SELECT repo, path, name, line, complexity, params, n_lines FROM code_fns"))
def discovered_functions(t):
    return code_functions(t)


_CX = "sum(complexity)::DOUBLE / count(*)::DOUBLE AS average, max(complexity) AS maximum, count(*) AS functions"


@query("code_complexity", with_sql("code_fns", f"SELECT repo, path, {_CX} FROM code_fns GROUP BY ALL"))
def code_complexity(t):
    return CX.file_complexity(code_functions(t))


@query("code_complexity_overall", with_sql("code_fns", "SELECT count(DISTINCT (repo, path)) AS files, sum(complexity)::DOUBLE / count(*)::DOUBLE AS overall_average FROM code_fns"))
def code_complexity_overall(t):
    return CX.overall_complexity(code_functions(t))


@query("code_hotspots", with_sql("code_fns", f"SELECT repo, path, average FROM (SELECT repo, path, {_CX} FROM code_fns GROUP BY ALL) WHERE average > 1.5"))
def code_hotspots(t):
    return CX.hotspots(CX.file_complexity(code_functions(t)), 1.5).select("repo", "path", "average")


@query("code_complexity_changes", with_sql("code_fns", f"""
, b AS (SELECT repo, path, {_CX} FROM code_fns WHERE doc_id % 20 <> 10 GROUP BY ALL), a AS (SELECT repo, path, {_CX} FROM code_fns WHERE doc_id % 20 <> 0 GROUP BY ALL),
r AS (SELECT a.repo, a.path, 'average' AS metric, b.average AS before, a.average AS after FROM a JOIN b USING (repo, path) UNION ALL SELECT a.repo, a.path, 'maximum', b.maximum::DOUBLE, a.maximum::DOUBLE FROM a JOIN b USING (repo, path)
 UNION ALL SELECT a.repo, a.path, 'functions', coalesce(b.functions, 0)::DOUBLE, a.functions::DOUBLE FROM a LEFT JOIN b USING (repo, path))
SELECT repo, path, metric, before, after, after - before AS change FROM r WHERE after <> before"""))
def code_complexity_changes(t):
    """The tree before and after: each lacks the files the other has added."""
    return CX.complexity_changes(CX.file_complexity(code_functions(t, "doc_id % 20 <> 10")), CX.file_complexity(code_functions(t, "doc_id % 20 <> 0")))


def function_rows(t):
    return t.lineitem.select(
        F.col("l_returnflag").alias("repo"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"),
        F.col("l_quantity").cast("int").alias("complexity"), "l_linenumber")


define("fns", "SELECT l_returnflag AS repo, 'p' || l_partkey AS path, l_quantity::INT AS complexity, l_linenumber FROM lineitem")
define("cx", "SELECT repo, path, sum(complexity)::DOUBLE / count(*)::DOUBLE AS average, max(complexity) AS maximum, count(*) AS functions FROM fns GROUP BY ALL", ("fns",))


@query("file_complexity", with_sql("cx", "SELECT * FROM cx"))
def file_complexity(t):
    return CX.file_complexity(function_rows(t))


@query("overall_complexity", with_sql("fns", "SELECT count(DISTINCT repo || path) AS files, sum(complexity)::DOUBLE / count(*)::DOUBLE AS overall_average FROM fns"))
def overall_complexity(t):
    return CX.overall_complexity(function_rows(t))


@query("complexity_hotspots", with_sql("cx", "SELECT repo, path, average FROM cx WHERE average > 10 ORDER BY average DESC, repo, path LIMIT 20"))
def complexity_hotspots(t):
    return CX.hotspots(CX.file_complexity(function_rows(t)), 10, 20).select("repo", "path", "average")


@query("complexity_changes", with_sql("fns", """
, b AS (SELECT repo, path, sum(complexity)::DOUBLE / count(*)::DOUBLE AS a, max(complexity)::DOUBLE AS m, count(*)::DOUBLE AS f FROM fns WHERE l_linenumber <= 3 GROUP BY ALL), a AS (SELECT repo, path, sum(complexity)::DOUBLE / count(*)::DOUBLE AS a, max(complexity)::DOUBLE AS m, count(*)::DOUBLE AS f FROM fns WHERE l_linenumber >= 2 GROUP BY ALL),
r AS (SELECT repo, path, 'average' AS metric, b.a AS before, a.a AS after FROM a JOIN b USING (repo, path) UNION ALL SELECT repo, path, 'maximum', b.m, a.m FROM a JOIN b USING (repo, path) UNION ALL SELECT repo, path, 'functions', coalesce(b.f, 0), a.f FROM a LEFT JOIN b USING (repo, path))
SELECT *, after - before AS change FROM r WHERE after <> before"""))
def complexity_changes(t):
    f = function_rows(t)
    return CX.complexity_changes(CX.file_complexity(f.where("l_linenumber <= 3")), CX.file_complexity(f.where("l_linenumber >= 2")))
