"""Queries over documents as source files: debt, bugs, scanners, secrets, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, text as X
from ..operators import codestats as C, debt as D, match as M, scan as S, secrets as Z
from ..operators.history import distinct_first, top_groups
from ..rules import bugs as bug_rules, debt as debt_rules
from ..sources.files import path_glob, to_lines, with_language
from . import bindings as B
from .bindings import define, with_sql
from .registry import query

NOW_US = 1735689600000000


def now():
    return F.timestamp_micros(F.lit(NOW_US))


def lines(t, *keep):
    return to_lines(B.code_files(t), *keep)


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


CLEAN = r"trim(regexp_replace(regexp_replace(%s, '^\s*(?://|#|<!--?|/\*+|\*+)\s*', ''), '\s*(?:\*/|-->)?\s*$', ''))"


def comment_sql(dialect: str, rx: str) -> str:
    said = f"coalesce(nullif(regexp_extract(text, {q(rx)}, 2), ''), upper(regexp_extract(text, {q(rx)}, 1)))"
    msg = f"trim({said})" if dialect == "inline" else CLEAN % said
    return f"""
SELECT repo, path, line, doc_id, upper(regexp_extract(text, {q(rx)}, 1)) AS tag, {msg} AS message
FROM code_lines WHERE regexp_matches(text, {q(rx)})"""


TODO_RX = (r"(?i)^\s*(?://|#|<!--|\{/\*|/\*|\*)\s*(" + "|".join(debt_rules.TODO_TAGS)
           + r")\b\s*:?\s*(.*?)(?:\*/|-->)?\s*$")
TODO_COMPAT_RX = TODO_RX.replace(r"^\s*", "^")
DEBT_RX = (r"(?i)^\s*(?://|#|<!--?|/\*+|\*)\s*(" + "|".join(debt_rules.DEBT_TAGS)
           + r")\b\s*:?\s*(.*?)(?:\*/|-->)?\s*$")
INLINE_RX = r"(?i)//\s*(" + "|".join(debt_rules.INLINE_TAGS) + r")\b\s*:?\s*(.*?)$"
define("todo_rows", comment_sql("todo", TODO_RX), ("code_lines",))
define("todo_rows_compat", comment_sql("todo", TODO_COMPAT_RX), ("code_lines",))
define("debt_rows", comment_sql("debt", DEBT_RX), ("code_lines",))
define("inline_rows", comment_sql("inline", INLINE_RX), ("code_lines",))


@query("todo_items", with_sql("todo_rows", "SELECT repo, path, line, tag, message FROM todo_rows"))
def todo_items(t):
    return D.comment_items(lines(t), "todo")


@query("todo_items_compat", with_sql("todo_rows_compat", "SELECT repo, path, line, tag, message FROM todo_rows_compat"))
def todo_items_compat(t):
    return D.comment_items(lines(t), "todo", compat=True)


@query("debt_comments", with_sql("debt_rows", "SELECT repo, path, line, tag, message FROM debt_rows"))
def debt_comments(t):
    return D.comment_items(lines(t), "debt")


@query("inline_debt_comments", with_sql("inline_rows", "SELECT repo, path, line, tag, message FROM inline_rows"))
def inline_debt_comments(t):
    return D.comment_items(lines(t), "inline")


@query("todo_items_in_glob", with_sql("todo_rows", r"""
SELECT repo, path, line, tag FROM todo_rows
WHERE (regexp_matches(path, '^src/(?:.*/)?[^/]*\.ts$') OR regexp_matches(path, '^lib/.*$')) AND NOT regexp_matches(path, '^(?:.*/)?[^/]*\.test\.ts$')"""))
def todo_items_in_glob(t):
    items = path_glob(D.comment_items(lines(t), "todo"), ["src/**/*.ts", "lib/**"], ["**/*.test.ts"])
    return items.select("repo", "path", "line", "tag")


@query("todo_items_since", with_sql("todo_rows", """
SELECT repo, path, line, tag FROM todo_rows WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"""))
def todo_items_since(t):
    """Only files changed since a ref: here those whose document carries a quality label."""
    files = B.code_files(t)
    changed = files.join(t.labels.where("quality = 1"), "doc_id", "left_semi")
    return D.items_since(D.comment_items(lines(t), "todo"), changed).select("repo", "path", "line", "tag")


def blamed_todos(t):
    return D.enrich_blame(D.comment_items(lines(t), "todo"), B.blame_lines(t), now())


define("blamed_todos", f"""
SELECT i.repo, i.path, i.line, i.tag, i.message, b.author, b.last_changed,
       floor(({NOW_US} - epoch_us(b.last_changed)) / 86400000000)::INT AS age_days
FROM todo_rows i LEFT JOIN blame_lines b USING (repo, path, line)""", ("todo_rows", "blame_lines"))


@query("todo_blame", with_sql("blamed_todos", "SELECT repo, path, line, tag, author, age_days FROM blamed_todos"))
def todo_blame(t):
    return blamed_todos(t).select("repo", "path", "line", "tag", "author", "age_days")


@query("todo_rollup", with_sql("blamed_todos", """
SELECT 'tag' AS dim, NULL AS repo, tag AS key, count(*) AS n FROM blamed_todos GROUP BY 3
UNION ALL SELECT 'path', repo, path, count(*) FROM blamed_todos GROUP BY 2, 3
UNION ALL SELECT 'author', NULL, coalesce(author, 'unknown'), count(*) FROM blamed_todos GROUP BY 3"""))
def todo_rollup(t):
    return D.todo_rollup(blamed_todos(t))


@query("todo_summary", with_sql("blamed_todos", """
SELECT count(*) AS total_items, coalesce(floor(sum(age_days) / count(age_days) + 0.5), 0)::BIGINT AS average_age FROM blamed_todos"""))
def todo_summary(t):
    return D.todo_summary(blamed_todos(t))


@query("oldest_todos", with_sql("blamed_todos", """
SELECT repo, path, line, age_days FROM blamed_todos WHERE age_days IS NOT NULL
ORDER BY age_days DESC, repo, path, line LIMIT 10"""))
def oldest_todos(t):
    return D.oldest(blamed_todos(t)).select("repo", "path", "line", "age_days")


@query("top_todo_files", with_sql("todo_rows", "SELECT path, count(*) AS n FROM todo_rows GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"))
def top_todo_files(t):
    return top_groups(D.comment_items(lines(t), "todo"), ["path"], 15)


def _score_sql(patterns, each: int, bonus: str = "0") -> str:
    tests = " + ".join(f"CASE WHEN regexp_matches(message, {q('(?i)' + p)}) THEN {each} ELSE 0 END" for p in patterns)
    return f"({tests} + {bonus})"


def _classify_sql() -> str:
    lead = r"upper(regexp_extract(message, '(?i)^(TODO|FIXME|HACK|XXX|SECURITY|PERF|OPTIMIZE|REVIEW)\b', 1))"
    t_scores, s_scores = [], []
    for name, pats in debt_rules.TYPE_PATTERNS.items():
        tags = [k for k, v in debt_rules.PREFIX_TYPES.items() if v == name]
        bonus = f"CASE WHEN {lead} IN ({', '.join(q(x) for x in tags)}) THEN 3 ELSE 0 END" if tags else "0"
        t_scores.append((name, _score_sql(pats, 2, bonus)))
    for name, pats in debt_rules.SEVERITY_PATTERNS.items():
        s_scores.append((name, _score_sql(pats, 1)))
    cols = ", ".join(f"{e} AS t_{n}" for n, e in t_scores) + ", " + ", ".join(f"{e} AS s_{n}" for n, e in s_scores)
    t_max = "greatest(" + ", ".join(f"t_{n}" for n, _ in t_scores) + ")"
    s_max = "greatest(" + ", ".join(f"s_{n}" for n, _ in s_scores) + ")"
    t_case = " ".join(f"WHEN t_{n} = {t_max} THEN '{n}'" for n, _ in t_scores)
    s_case = " ".join(f"WHEN s_{n} = {s_max} THEN '{n}'" for n, _ in s_scores)
    return f"""
SELECT repo, path, line, doc_id, tag, message,
  CASE WHEN {t_max} > 0 THEN CASE {t_case} END
       WHEN upper(message) LIKE 'FIXME%' THEN 'bug' WHEN upper(message) LIKE 'SEC%' THEN 'security'
       WHEN upper(message) LIKE 'PERF%' OR upper(message) LIKE 'OPTIMIZE%' THEN 'performance'
       WHEN upper(message) LIKE 'HACK%' OR upper(message) LIKE 'KLUDGE%' OR upper(message) LIKE 'WORKAROUND%' THEN 'refactor'
       WHEN upper(message) LIKE 'TODO%' THEN 'enhancement' ELSE 'refactor' END AS type,
  CASE WHEN {t_max} = 0 AND upper(message) LIKE 'FIXME%' THEN 'major'
       WHEN {t_max} = 0 AND upper(message) LIKE 'SEC%' THEN 'critical'
       WHEN {t_max} = 0 AND (upper(message) LIKE 'PERF%' OR upper(message) LIKE 'OPTIMIZE%' OR upper(message) LIKE 'HACK%'
            OR upper(message) LIKE 'KLUDGE%' OR upper(message) LIKE 'WORKAROUND%') THEN 'major'
       WHEN {t_max} = 0 AND upper(message) LIKE 'TODO%' THEN 'minor'
       WHEN {s_max} > 0 THEN CASE {s_case} END ELSE 'minor' END AS severity
FROM (SELECT *, {cols} FROM debt_rows)"""


define("classed_debt", _classify_sql(), ("debt_rows",))
define("debt_store", f"""
SELECT c.*, floor(({NOW_US} - epoch_us(b.last_changed)) / 86400000000)::INT AS age_days,
       CASE WHEN (c.doc_id + c.line) % 6 = 0 THEN 'resolved' ELSE 'open' END AS status,
       (c.line % 9 + 1)::DOUBLE AS fix_cost, (c.doc_id % 6)::DOUBLE AS leave_cost
FROM classed_debt c LEFT JOIN blame_lines b USING (repo, path, line)""", ("classed_debt", "blame_lines"))


def debt_store(t):
    items = D.with_class(D.comment_items(lines(t, "doc_id"), "debt"))
    aged = D.enrich_blame(items, B.blame_lines(t), now())
    return aged.select(
        "repo", "path", "line", "doc_id", "tag", "message", "type", "severity", "age_days",
        F.when((F.col("doc_id") + F.col("line")) % 6 == 0, "resolved").otherwise("open").alias("status"),
        (F.col("line") % 9 + 1).cast("double").alias("fix_cost"), (F.col("doc_id") % 6).cast("double").alias("leave_cost"))


@query("classified_debt", with_sql("classed_debt", "SELECT repo, path, line, type, severity FROM classed_debt"))
def classified_debt(t):
    return D.with_class(D.comment_items(lines(t), "debt")).select("repo", "path", "line", "type", "severity")


_SCORE = """count(*) AS total, count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'resolved') AS resolved,
 coalesce(sum(CASE severity WHEN 'critical' THEN 10 WHEN 'major' THEN 5 ELSE 1 END) FILTER (status = 'open'), 0)::BIGINT AS score,
 coalesce(floor(sum(coalesce(age_days, 0)) FILTER (status = 'open') / nullif(count(*) FILTER (status = 'open'), 0) + 0.5), 0)::BIGINT AS average_age"""


@query("debt_score", with_sql("debt_store", f"SELECT {_SCORE} FROM debt_store"))
def debt_score(t):
    return D.debt_score(debt_store(t))


@query("debt_score_by_repo", with_sql("debt_store", f"SELECT repo, {_SCORE} FROM debt_store GROUP BY repo"))
def debt_score_by_repo(t):
    return D.debt_score(debt_store(t), ("repo",))


@query("debt_breakdown", with_sql("debt_store", """
, o AS (SELECT severity, type, repo, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '(root)' END AS module FROM debt_store WHERE status = 'open'),
z AS (SELECT 'severity' AS dim, unnest(['critical', 'major', 'minor']) AS key UNION ALL
      SELECT 'type', unnest(['bug', 'security', 'performance', 'refactor', 'documentation', 'enhancement'])),
c AS (SELECT 'severity' AS dim, NULL AS repo, severity AS key, count(*) AS n FROM o GROUP BY 3 UNION ALL SELECT 'type', NULL, type, count(*) FROM o GROUP BY 3
      UNION ALL SELECT 'module', repo, module, count(*) FROM o GROUP BY 2, 3)
SELECT coalesce(c.dim, z.dim) AS dim, repo, coalesce(c.key, z.key) AS key, coalesce(n, 0) AS n FROM c FULL JOIN z ON c.dim = z.dim AND c.key = z.key"""))
def debt_breakdown(t):
    return D.debt_breakdown(debt_store(t))


@query("debt_budget", with_sql("debt_store", """
SELECT s > 100 AS exceeded, s AS current_score, 100::BIGINT AS threshold, 100 - s AS remaining
FROM (SELECT coalesce(sum(CASE severity WHEN 'critical' THEN 10 WHEN 'major' THEN 5 ELSE 1 END), 0)::BIGINT AS s FROM debt_store WHERE status = 'open')"""))
def debt_budget(t):
    return D.debt_budget(debt_store(t))


@query("open_debts", with_sql("debt_store", "SELECT repo, path, line, severity FROM debt_store WHERE status = 'open'"))
def open_debts(t):
    return D.open_debts(debt_store(t)).select("repo", "path", "line", "severity")


@query("merged_debt", with_sql("classed_debt", """
, e AS (SELECT repo, path, line, 'known' AS origin FROM classed_debt WHERE doc_id % 3 = 0)
SELECT * FROM e UNION ALL SELECT repo, path, line, 'scan' FROM classed_debt s
WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.repo = s.repo AND e.path = s.path AND e.line = s.line)"""))
def merged_debt(t):
    scanned = D.comment_items(lines(t, "doc_id"), "debt")
    known = scanned.where("doc_id % 3 = 0").select("repo", "path", "line", F.lit("known").alias("origin"))
    fresh = scanned.select("repo", "path", "line", F.lit("scan").alias("origin"))
    return D.merge_debt(known, fresh)


@query("debt_bands", with_sql("debt_store", """
, b AS (SELECT *, CASE WHEN age_days < 30 THEN 'normal' WHEN age_days < 90 THEN 'validate' WHEN age_days < 180 THEN 'yellow' ELSE 'must_fix' END AS band,
        CASE WHEN leave_cost > 0 THEN fix_cost / leave_cost END AS ratio FROM debt_store)
SELECT repo, path, line, band, CASE WHEN ratio < 1 THEN 'defer' WHEN ratio <= 2 THEN 'monitor' WHEN ratio > 2 THEN 'fix' END AS advice,
  CASE WHEN severity = 'critical' OR (severity = 'major' AND band = 'must_fix') THEN 'fix_now' WHEN severity = 'major' THEN 'schedule'
       WHEN band = 'must_fix' THEN 'defer_with_deadline' ELSE 'drop' END AS quadrant,
  band = 'must_fix' OR coalesce(ratio > 2, false) AS must_fix FROM b"""))
def debt_bands(t):
    return D.debt_band(debt_store(t)).select("repo", "path", "line", "band", "advice", "quadrant", "must_fix")


# --- bug rules -----------------------------------------------------------------------

LANG_SQL = "CASE " + " ".join(
    f"WHEN e = '{k}' THEN '{v}'" for k, v in __import__("tallyforge.rules.words", fromlist=["x"]).RULE_LANGUAGE_BY_EXTENSION.items()
) + " ELSE '' END"


def _rule_sql(rule: bug_rules.Rule) -> str:
    rx = ("(?i)" if rule.ignore_case else "") + rule.pattern
    langs = ", ".join(q(x) for x in rule.languages)
    return (f"SELECT repo, path, line, '{rule.rule_id}' AS rule_id, '{rule.category}' AS category, '{rule.severity}' AS severity, text "
            f"FROM lang_lines WHERE lang IN ({langs}) AND regexp_matches(text, {q(rx)})")


# the multi-line rule can never match a single line, and its look-around has no RE2 form
_ACTIVE = [r for r in bug_rules.RULES if r.active and r.rule_id != "async-missing-await"]
define("lang_lines", f"""
SELECT repo, path, line, text, doc_id, {LANG_SQL} AS lang
FROM (SELECT *, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS e FROM code_lines)""", ("code_lines",))
define("findings", " UNION ALL ".join(_rule_sql(r) for r in _ACTIVE), ("lang_lines",))


def findings(t, suppressed=()):
    return M.bug_findings(to_lines(with_language(B.code_files(t)), "lang"), suppressed=suppressed)


@query("bug_findings", with_sql("findings", r"""
SELECT repo, path, line, rule_id, category, severity, regexp_replace(text, '^\s+|\s+$', '', 'g') AS content FROM findings"""))
def bug_findings(t):
    return findings(t)


@query("bug_findings_suppressed", with_sql("findings", """
SELECT repo, path, line, rule_id FROM findings WHERE rule_id NOT IN ('sec-eval-usage', 'err-empty-catch')"""))
def bug_findings_suppressed(t):
    return findings(t, ("sec-eval-usage", "err-empty-catch")).select("repo", "path", "line", "rule_id")


@query("findings_by_rule_table", with_sql("findings", r"""
SELECT repo, path, line, rule_id, severity FROM findings WHERE rule_id NOT IN ('sec-eval-usage', 'err-empty-catch')"""))
def findings_by_rule_table(t):
    """The rules as a table instead of expressions, with a table of suppressed ones."""
    spark = t.spark
    off = spark.createDataFrame([("sec-eval-usage",), ("err-empty-catch",)], "rule_id string")
    found = M.findings_by_table(to_lines(with_language(B.code_files(t)), "lang"), M.rule_table(spark, M.RULES), off)
    return found.select("repo", "path", "line", "rule_id", "severity")


@query("finding_rollup", with_sql("findings", """
SELECT 'severity' AS dim, NULL AS repo, severity AS key, count(*) AS n FROM findings GROUP BY 3 UNION ALL
SELECT 'category', NULL, category, count(*) FROM findings GROUP BY 3 UNION ALL SELECT 'rule_id', NULL, rule_id, count(*) FROM findings GROUP BY 3
UNION ALL SELECT 'path', repo, path, count(*) FROM findings GROUP BY 2, 3"""))
def finding_rollup(t):
    return M.finding_rollup(findings(t))


@query("finding_stats", with_sql("findings", """
SELECT count(*) AS total_findings, count(DISTINCT (repo, path)) AS files, count(*) FILTER (severity IN ('critical', 'high')) AS unresolved FROM findings"""))
def finding_stats(t):
    return M.finding_stats(findings(t))


@query("stored_critical_findings", with_sql("findings", """
SELECT repo, path, line, category FROM findings WHERE severity = 'critical' AND category = 'security'"""))
def stored_critical_findings(t):
    """Category looked up again from the rule id, as for findings stored without one."""
    stored = M.with_category(findings(t).drop("category")).withColumn("ts", F.col("line"))
    return M.select_findings(stored, "critical", "security").select("repo", "path", "line", "category")


_SPOKEN = lambda r: "true" if "*" in r.languages else f"lang IN ({', '.join(q(x) for x in r.languages)})"


@query("bug_findings_in_diff", with_sql("code_files lang_lines", f"""
, e AS (SELECT f.repo || ':' || f.path || ':' || f.doc_id AS repo, f.path, d.line * 3 + 1 AS line, d.lang, regexp_replace(d.text, '^\\s+|\\s+$', '', 'g') AS text FROM lang_lines d JOIN code_files f USING (doc_id))
{" UNION ALL ".join(f"SELECT repo, path, line::INT AS line, '{r.rule_id}' AS rule_id FROM e WHERE {_SPOKEN(r)} AND regexp_matches(text, {q(('(?i)' if r.ignore_case else '') + r.pattern)})" for r in _ACTIVE)}"""))
def bug_findings_in_diff(t):
    """Every code file as a diff: one header, then every line removed, added and kept."""
    files = with_language(B.code_files(t))
    marked = F.transform(F.split("content", "\n"), lambda x: F.concat(F.lit("-x\n "), F.lit("kept"), F.lit("\n+"), x))
    diffs = files.select(
        F.concat_ws(":", "repo", "path", F.col("doc_id").cast("string")).alias("diff_id"), "lang",
        F.concat(F.lit("+++ b/"), "path", F.lit("\n"), F.array_join(marked, "\n")).alias("content"))
    return M.bug_findings_diff(diffs).select("repo", "path", "line", "rule_id")


# --- scanners ------------------------------------------------------------------------

define("flag_rows", r"""
SELECT repo, path, line, row_number() OVER (PARTITION BY repo, path, line ORDER BY kind, pos) AS seq, flag,
  NOT regexp_matches(text, '(?i)false|disabled|off|0') AND regexp_matches(text, '(?i)true|enabled|on|1') AS enabled
FROM (
 SELECT *, unnest(fs) AS flag, unnest(generate_series(1, len(fs))) AS pos FROM (
  SELECT repo, path, line, text, 0 AS kind, regexp_extract_all(text, '(?i)(?:feature|flag|toggle|experiment|FF)_[A-Z0-9_]+') AS fs FROM code_lines
  UNION ALL SELECT repo, path, line, text, 1, regexp_extract_all(text, 'featureFlag\[[''"]?([^''"\]]+)[''"]?\]', 1) FROM code_lines
  UNION ALL SELECT repo, path, line, text, 2, regexp_extract_all(text, 'flags?\.(?:isEnabled|isActive|getValue)\([''"]([^''"]+)[''"]\)', 1) FROM code_lines
  UNION ALL SELECT repo, path, line, text, 3, regexp_extract_all(text, 'process\.env\.(?:NEXT_PUBLIC_)?FF_') FROM code_lines
  UNION ALL SELECT repo, path, line, text, 4, regexp_extract_all(text, '(?i)LaunchDarkly|Unleash|Flagsmith|splitio') FROM code_lines))""", ("code_lines",))


@query("feature_flags", with_sql("flag_rows", """
, o AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY repo, path, line, seq) AS rn FROM flag_rows)
SELECT flag, count(*) AS mentions, count(DISTINCT (repo, path)) AS files, bool_or(enabled) FILTER (rn = 1) AS enabled FROM o GROUP BY 1"""))
def feature_flags(t):
    return S.feature_flags(lines(t))


@query("nplus1_risks", with_sql("code_lines", r"""
SELECT repo, path, line, p.name AS pattern FROM code_lines,
 (VALUES ('findMany', '\.findMany\s*\('), ('find', '\.find\w*\s*\('), ('query', '\.query\s*\('), ('aggregate', '\.aggregate\s*\(')) p(name, rx)
WHERE regexp_matches(text, rx) AND regexp_matches(text, '(?i)(?:for|while|forEach|\.map\s*\(|Promise\.all)')"""))
def nplus1_risks(t):
    return S.nplus1_risks(lines(t))


@query("async_risks", with_sql("code_lines", r"""
, a AS (SELECT *, string_agg(text, chr(10)) OVER (PARTITION BY repo, path ORDER BY line ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS ahead FROM code_lines),
h AS (SELECT repo, path, line,
  CASE WHEN contains(text, '{}') OR regexp_matches(text, 'catch\s*\)') THEN regexp_matches(text, 'catch\s*\(')::INT + regexp_matches(text, '\.catch\s*\(')::INT ELSE 0 END AS c,
  CASE WHEN NOT contains(text, '.catch') AND NOT contains(text, 'await') AND NOT contains(ahead, '.catch')
       THEN regexp_matches(text, 'Promise\s*\(')::INT + regexp_matches(text, 'new Promise')::INT + regexp_matches(text, '\.then\s*\(')::INT ELSE 0 END AS p FROM a)
SELECT repo, path, line, 'risky_catch' AS risk, c AS hits FROM h WHERE c > 0 UNION ALL SELECT repo, path, line, 'unhandled_promise', p FROM h WHERE p > 0"""))
def async_risks(t):
    return S.async_risks(B.code_files(t))


@query("event_map", with_sql("code_lines", r"""
, s AS (SELECT repo, path, regexp_extract(text, '[''"]([^''"]+)[''"]', 1) AS event,
  regexp_matches(text, '\.emit\s*\(')::INT + regexp_matches(text, '\.publish\s*\(')::INT + regexp_matches(text, 'EventEmitter')::INT AS e,
  regexp_matches(text, '\.on\s*\(')::INT + regexp_matches(text, '\.subscribe\s*\(')::INT + regexp_matches(text, '\.addListener\s*\(')::INT + regexp_matches(text, '\.once\s*\(')::INT AS l FROM code_lines)
SELECT event, sum(e)::BIGINT AS emitters, sum(l)::BIGINT AS listeners, count(DISTINCT (repo, path)) AS files FROM s WHERE event <> '' AND (e > 0 OR l > 0) GROUP BY 1"""))
def event_map(t):
    return S.event_map(lines(t))


@query("permission_audit", with_sql("code_files", r"""
, p AS (SELECT DISTINCT unnest(list_concat(regexp_extract_all(content, '(?i)(?:permission|scope|role)[s:]?\s*[:=]\s*["'']([^"'']+)["'']', 1),
   regexp_extract_all(content, '(?i)(?:can|allow|grant|access)\s*[:=]\s*["'']([^"'']+)["'']', 1))) AS permission, repo, path
  FROM code_files WHERE regexp_matches(path, '(?i)\.(ts|js|json|yaml|yml|toml)$'))
SELECT permission, count(*) AS files, CASE WHEN regexp_matches(lower(permission), 'admin|root|superuser|\*') OR lower(permission) = 'all' THEN 'high'
  WHEN regexp_matches(lower(permission), 'write|delete|manage') THEN 'medium' ELSE 'low' END AS risk FROM p GROUP BY 1"""))
def permission_audit(t):
    return S.permission_audit(B.code_files(t))


@query("widest_permissions", with_sql("code_files", r"""
, p AS (SELECT DISTINCT unnest(list_concat(regexp_extract_all(content, '(?i)(?:permission|scope|role)[s:]?\s*[:=]\s*["'']([^"'']+)["'']', 1),
   regexp_extract_all(content, '(?i)(?:can|allow|grant|access)\s*[:=]\s*["'']([^"'']+)["'']', 1))) AS permission, repo, path
  FROM code_files WHERE regexp_matches(path, '(?i)\.(ts|js|json|yaml|yml|toml)$'))
SELECT permission, count(*) AS files FROM p GROUP BY 1"""))
def widest_permissions(t):
    return S.permission_audit(B.code_files(t)).select("permission", "files")


@query("migration_complexity", with_sql("code_files", r"""
, s AS (SELECT repo, path, length(content)::INT AS size,
   len(regexp_extract_all(regexp_replace(regexp_replace(content, '''(?:[^''\\]|\\.)*''', '', 'g'), '"(?:[^"\\]|\\.)*"', '', 'g'), ';'))::INT AS statements,
   len(regexp_extract_all(content, '(?i)ALTER\s+TABLE')) * 2 + len(regexp_extract_all(content, '(?i)CREATE\s+(?:INDEX|TRIGGER|FUNCTION|PROCEDURE)')) * 3
   + len(regexp_extract_all(content, '(?i)DROP\s+(?:TABLE|INDEX|COLUMN)')) * 2 + len(regexp_extract_all(content, '(?i)FOREIGN\s+KEY')) AS w
  FROM code_files WHERE regexp_matches(path, '(?i)\.sql$'))
SELECT repo, path, size, statements, (statements + w)::INT AS score, CASE WHEN statements + w <= 5 AND size <= 2000 THEN 'low'
  WHEN statements + w <= 15 AND size <= 10000 THEN 'medium' ELSE 'high' END AS complexity FROM s"""))
def migration_complexity(t):
    return S.migration_complexity(B.code_files(t))


@query("keyword_search", with_sql("code_lines", r"""
SELECT repo, path, line, left(regexp_replace(text, '^\s+|\s+$', '', 'g'), 200) AS content FROM code_lines
WHERE contains(lower(text), 'token')"""))
def keyword_search(t):
    return S.keyword_search(lines(t), "Token")


def _strings_sql(source: str) -> str:
    skip = " OR ".join(f"regexp_matches(value, {q(p)})" for p in S.SKIP_STRINGS)
    spoken = (r"(?:console\.(?:log|message|warn|error|info|debug)|throw)\s*\(?\s*"
              r"(?:\"([A-Z][\s\S]*?)\"|'([A-Z][\s\S]*?)'|`([A-Z][\s\S]*?)`)")
    quoted = r"\"([A-Z][a-zA-Z\s,;:!?']{10,})\"|'([A-Z][a-zA-Z\s,;:!?']{10,})'|`([A-Z][a-zA-Z\s,;:!?']{10,})`"
    strip = r"regexp_replace(%s, '^\s+|\s+$', '', 'g')"
    return f"""
, l AS (SELECT repo, path, unnest(generate_series(1, len(ls))) AS line, unnest(ls) AS text FROM (SELECT repo, path, string_split(content, chr(10)) AS ls FROM {source})),
m AS (SELECT *, CASE WHEN contains(text, '</code>') THEN 0 WHEN regexp_matches(text, '<code[\\s>]') THEN 1 END AS mark FROM l),
s AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY repo, path ORDER BY line ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) = 1
        OR mark IS NOT NULL AS code, regexp_matches(text, {q(spoken)}) AS spoken FROM m),
c AS (
 SELECT repo, path, line, text, 0 AS kind, list_filter(list_transform(regexp_extract_all(text, '>([^<]+)<', 1), lambda v: {strip % 'v'}), lambda v: v <> '') AS vs
   FROM s WHERE NOT code AND regexp_matches(text, {q(S.MARKUP_LINE)})
 UNION ALL SELECT repo, path, line, text, 1, [regexp_extract(text, {q(spoken)}, 1) || regexp_extract(text, {q(spoken)}, 2) || regexp_extract(text, {q(spoken)}, 3)] FROM s WHERE spoken
 UNION ALL SELECT repo, path, line, text, 2, list_transform(regexp_extract_all(text, {q(quoted)}), lambda v: v[2:-2]) FROM s WHERE NOT spoken),
e AS (SELECT repo, path, line, kind, unnest(vs) AS raw, unnest(generate_series(1, len(vs))) AS seq, left({strip % 'text'}, 120) AS context FROM c),
v AS (SELECT * EXCLUDE (raw), {strip % 'raw'} AS value FROM e),
k AS (SELECT *, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(value), '[^a-zA-Z0-9\\s-]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')) AS key
      FROM v WHERE length(value) > 15 AND NOT ({skip})),
r AS (SELECT *, row_number() OVER (PARTITION BY repo, key ORDER BY path, line, kind, seq) AS rn FROM k)
SELECT repo, path, line, value, context, key FROM r WHERE rn = 1"""


@query("hardcoded_page_strings", with_sql("page_files", _strings_sql("page_files")))
def hardcoded_page_strings(t):
    return S.hardcoded_strings(B.page_files(t)).select("repo", "path", "line", "value", "context", "key")


@query("hardcoded_code_strings", with_sql("code_files", _strings_sql("code_files")))
def hardcoded_code_strings(t):
    return S.hardcoded_strings(B.code_files(t)).select("repo", "path", "line", "value", "context", "key")


# --- secrets -------------------------------------------------------------------------

_H = """list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_sort(list_distinct(string_split({x}, ''))),
 lambda c: -((length({x}) - length(replace({x}, c, '')))::DOUBLE / length({x})) * log2((length({x}) - length(replace({x}, c, '')))::DOUBLE / length({x})))), lambda a, b: a + b)"""


def entropy_sql(x: str) -> str:
    return f"CASE WHEN length({x}) > 0 THEN {_H.format(x=x)} ELSE 0.0 END"


_TOKENS = {
    "aws_key": r"\bAKIA[0-9A-Z]{16}\b", "github_token": r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{36}\b",
    "jwt": r"eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*", "ssh_key": r"-----BEGIN\s[A-Z]+\sPRIVATE\sKEY-----",
    "slack_token": r"xox[baprs]-[0-9A-Za-z-]{10,72}", "pypi_token": r"pypi-AgEIcHlwaS5vcm[0-9A-Za-z_-]{50,150}",
}
_KV = r"(?i)(?:api[_-]?key|apikey|secret|password|token|credential)\s*[:=]\s*['\"]([A-Za-z0-9_\-]{16,})['\"]"


def _secrets_sql(source: str) -> str:
    cands = " UNION ALL ".join(
        [f"SELECT repo, path, line, text, '{n}' AS type, unnest(regexp_extract_all(text, {q(p)})) AS token FROM {source}" for n, p in _TOKENS.items()]
        + [f"SELECT repo, path, line, text, 'generic_secret', unnest(regexp_extract_all(text, {q(_KV)}, 1)) FROM {source}"])
    known = " OR ".join(f"regexp_matches(plain, {q(p)})" for p in _TOKENS.values())
    return f"""
, c AS ({cands}),
k AS (SELECT *, {entropy_sql('token')} AS bits,
   CASE WHEN regexp_matches(token, '^[A-Za-z0-9+/]{{16,}}={{0,2}}$') AND length(token) % 4 = 0 THEN TRY(decode(from_base64(token))) END AS plain FROM c
  WHERE NOT regexp_matches(token, '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}$')
    AND NOT (regexp_matches(token, '^[0-9a-fA-F]{{40,64}}$') AND contains(lower(text), 'commit'))),
h AS (SELECT *, coalesce(({entropy_sql('plain')} > 4.2)::INT, 0) + coalesce(contains(plain, ':')::INT, 0) + coalesce(({known})::INT, 0) >= 2 AS hidden FROM k),
s AS (SELECT *, floor((CASE WHEN bits > 5.5 THEN 1.0::DOUBLE WHEN bits > 4.5 THEN 0.8::DOUBLE WHEN bits > 4.2 THEN 0.6::DOUBLE ELSE bits / 4.2::DOUBLE * 0.5::DOUBLE END * 0.4::DOUBLE
   + CASE WHEN type <> 'generic_secret' OR hidden THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * 0.3::DOUBLE
   + CASE WHEN regexp_matches(path, '(^|/)(dist|node_modules|vendor|generated)/|\\.min\\.') THEN 0.1::DOUBLE
          WHEN regexp_matches(path, '(^|/)\\.env|(^|/)config/.*prod|credentials') THEN 1.0::DOUBLE
          WHEN regexp_matches(path, '\\.(test|spec)\\.|(^|/)(test|tests|fixtures?)/') THEN 0.5::DOUBLE
          WHEN regexp_matches(path, '\\.md$|(^|/)docs/|README') THEN 0.3::DOUBLE
          WHEN regexp_matches(path, '\\.(ts|tsx|py|js|jsx|go|rs|java|rb|php)$') THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END * 0.3::DOUBLE) * 10000::DOUBLE + 0.5::DOUBLE)::DOUBLE / 10000::DOUBLE AS score FROM h)
"""


_SECRET_COLS = """SELECT repo, path, line, type, token, floor(bits * 10000::DOUBLE + 0.5::DOUBLE)::DOUBLE / 10000::DOUBLE AS entropy, hidden, score,
 CASE WHEN score >= 0.7 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM s"""
define("doc_lines", """
SELECT repo, path, unnest(generate_series(1, len(ls))) AS line, unnest(ls) AS text FROM (SELECT repo, path, string_split(content, chr(10)) AS ls FROM doc_files)""", ("doc_files",))


@query("secret_findings", with_sql("code_lines", _secrets_sql("code_lines") + _SECRET_COLS))
def secret_findings(t):
    return Z.secret_findings(lines(t))


@query("secret_findings_in_documents", with_sql("doc_lines", _secrets_sql("doc_lines") + _SECRET_COLS))
def secret_findings_in_documents(t):
    return Z.secret_findings(to_lines(B.doc_files(t)))


@query("secret_summary", with_sql("code_lines", _secrets_sql("code_lines") + f"""
, f AS ({_SECRET_COLS}) SELECT v.s AS severity, count(f.path) AS n, count(DISTINCT f.repo || '|' || f.path) AS files
FROM (VALUES ('HIGH'), ('MEDIUM'), ('LOW')) v(s) LEFT JOIN f ON f.severity = v.s GROUP BY 1"""))
def secret_summary(t):
    return Z.secret_summary(Z.secret_findings(lines(t)))


@query("token_entropy", f"""
, w AS (SELECT 1) SELECT 1""".replace(", w AS (SELECT 1) SELECT 1", f"""
WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[0-9A-Za-z]{{20,}}'))) AS token FROM documents)
SELECT doc_id, token, floor(({entropy_sql('token')}) * 10000::DOUBLE + 0.5::DOUBLE)::DOUBLE / 10000::DOUBLE AS entropy FROM w"""))
def token_entropy(t):
    words = F.array_distinct(X.captures(F.col("text"), "([0-9A-Za-z]{20,})"))
    from ..functions.maths import half_up

    return t.documents.select("doc_id", F.explode(words).alias("token")).withColumn(
        "entropy", half_up(X.shannon_entropy(F.col("token")), 4))


# --- statistics ----------------------------------------------------------------------

_LANGS = __import__("tallyforge.rules.words", fromlist=["x"]).LANGUAGE_BY_EXTENSION
define("lang_files", f"""
SELECT *, CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LANGS.items())} END AS language,
  CASE WHEN length(content) = 0 THEN 0 ELSE len(string_split(content, chr(10))) END AS n_lines FROM code_files""", ("code_files",))


@query("language_stats", with_sql("lang_files", """
, a AS (SELECT language, count(*) AS files, sum(n_lines)::BIGINT AS lines, sum(strlen(content))::BIGINT AS bytes FROM lang_files WHERE language IS NOT NULL GROUP BY 1)
SELECT *, floor(lines::DOUBLE / (SELECT sum(lines) FROM a)::DOUBLE * 100::DOUBLE * 100::DOUBLE + 0.5::DOUBLE)::DOUBLE / 100::DOUBLE AS percent FROM a"""))
def language_stats(t):
    return C.language_stats(B.code_files(t))


@query("language_stats_by_repo", with_sql("lang_files", """
, a AS (SELECT repo, language, count(*) AS files, sum(n_lines)::BIGINT AS lines, sum(strlen(content))::BIGINT AS bytes FROM lang_files WHERE language IS NOT NULL GROUP BY 1, 2)
SELECT *, floor(lines::DOUBLE / (sum(lines) OVER (PARTITION BY repo))::DOUBLE * 100::DOUBLE * 100::DOUBLE + 0.5::DOUBLE)::DOUBLE / 100::DOUBLE AS percent FROM a"""))
def language_stats_by_repo(t):
    return C.language_stats(B.code_files(t), ("repo",))


@query("language_changes", with_sql("lang_files", """
, b AS (SELECT language, sum(n_lines)::BIGINT AS n FROM lang_files WHERE language IS NOT NULL AND doc_id % 3 <> 0 GROUP BY 1),
a AS (SELECT language, sum(n_lines)::BIGINT AS n FROM lang_files WHERE language IS NOT NULL AND doc_id % 4 <> 1 GROUP BY 1)
SELECT language, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after, coalesce(a.n, 0) - coalesce(b.n, 0) AS change
FROM b FULL JOIN a USING (language) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)"""))
def language_changes(t):
    """Two snapshots of the tree, each lacking other files."""
    f = B.code_files(t)
    return C.language_changes(C.language_stats(f.where("doc_id % 3 <> 0")), C.language_stats(f.where("doc_id % 4 <> 1")))


@query("path_changes", with_sql("code_files", """
, b AS (SELECT DISTINCT repo, path FROM code_files WHERE doc_id % 3 <> 0), a AS (SELECT DISTINCT repo, path FROM code_files WHERE doc_id % 4 <> 1)
SELECT repo, path, 'added' AS change FROM (FROM a EXCEPT FROM b) UNION ALL SELECT repo, path, 'removed' FROM (FROM b EXCEPT FROM a)"""))
def path_changes(t):
    f = B.code_files(t)
    return C.key_changes(f.where("doc_id % 3 <> 0"), f.where("doc_id % 4 <> 1"), ["repo", "path"])


@query("paths_only_before", with_sql("code_files", """
SELECT DISTINCT repo, path FROM code_files WHERE doc_id % 3 <> 0 EXCEPT SELECT repo, path FROM code_files WHERE doc_id % 4 <> 1"""))
def paths_only_before(t):
    f = B.code_files(t)
    return C.only_in(f.where("doc_id % 3 <> 0"), f.where("doc_id % 4 <> 1"), ["repo", "path"])


@query("dir_rollup", with_sql("code_files", """
, d AS (SELECT repo, strlen(content) AS b, string_split(regexp_extract(path, '^(.*)/[^/]*$', 1), '/') AS s FROM code_files WHERE contains(path, '/')),
e AS (SELECT repo, b, unnest(list_transform(generate_series(1, least(len(s), 5)), lambda n: array_to_string(s[1:n], '/'))) AS dir FROM d)
SELECT repo, dir, count(*) AS files, sum(b)::BIGINT AS bytes FROM e GROUP BY 1, 2"""))
def dir_rollup(t):
    return C.dir_rollup(B.code_files(t))


@query("document_identity", """
SELECT left(sha256(text), 12) AS short_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1""")
def document_identity(t):
    keyed = t.documents.select("doc_id", hashing.content_hash(F.col("text"), 12).alias("short_hash"))
    return keyed.groupBy("short_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))


@query("first_document_copies", """
SELECT sha256(text) AS hash, min(doc_id) AS doc_id FROM documents GROUP BY 1""")
def first_document_copies(t):
    keyed = t.documents.select(F.sha2("text", 256).alias("hash"), "doc_id")
    return distinct_first(keyed, ["hash"], [F.col("doc_id")])
