"""Profile, consistency and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P, quality as Q
from ..rules import style as S, words
from ..sources.files import to_lines
from . import bindings as B
from .bindings import define, with_sql
from .registry import query
from .scans import NOW_US, now, q


def _cnt(pats) -> str:
    return " + ".join(f"len(regexp_extract_all(content, {q(p)}))" for p in pats)


_LIBS = r"""list_filter(list_concat(regexp_extract_all(content, 'from\s+[''"]([^''"/]+)[''"]', 1), regexp_extract_all(content, 'require\s*\(\s*[''"]([^''"/]+)[''"]', 1)), lambda x: NOT starts_with(x, '.') AND NOT starts_with(x, '/'))"""
define("features", f"""
SELECT repo, path, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS ext, {", ".join(f"{_cnt(p)} AS {n}" for n, p in S.COUNTS.items())},
 CASE WHEN lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ('.tsx', '.jsx') THEN {_cnt((S.ARROW_COMPONENT,))} ELSE 0 END AS arrow_components, {_LIBS} AS libs FROM code_files""", ("code_files",))
_SUMS = [*S.COUNTS, "arrow_components"]
define("pref_libs", """
SELECT repo, list(lib ORDER BY n DESC, lib) AS preferred_libs FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, lib) AS rn FROM
 (SELECT repo, lib, count(*) AS n FROM (SELECT repo, unnest(libs) AS lib FROM features) GROUP BY ALL)) WHERE rn <= 5 GROUP BY 1""", ("features",))
define("style_profile", f"""
SELECT s.repo, CASE WHEN default_imports + named_imports = 0 THEN 'mixed' WHEN default_imports / (default_imports + named_imports) > 0.7 THEN 'default' WHEN default_imports / (default_imports + named_imports) < 0.3 THEN 'named' ELSE 'mixed' END AS import_style,
 CASE WHEN e = 0 THEN 'mixed' WHEN try_catch / e > 0.7 THEN 'try-catch' WHEN callback > result_type AND callback / e > 0.5 THEN 'callback' WHEN result_type > callback AND result_type / e > 0.5 THEN 'result-type' ELSE 'mixed' END AS error_handling,
 CASE WHEN d.n = 0 THEN 'mixed' WHEN d.f / d.n > 0.5 THEN 'feature-based' WHEN d.y / d.n > 0.5 THEN 'type-based' WHEN d.n < 3 THEN 'flat' ELSE 'mixed' END AS file_organization,
 CASE WHEN c = 0 THEN 'mixed' WHEN function_components / c > 0.6 THEN 'function' WHEN class_components / c > 0.6 THEN 'class' WHEN arrow_components / c > 0.6 THEN 'arrow-function' ELSE 'mixed' END AS component_structure,
 CASE WHEN describe_it > test_global AND describe_it > asserts THEN 'describe-it' WHEN test_global > describe_it AND test_global > asserts THEN 'test' WHEN asserts > describe_it AND asserts > test_global THEN 'assert' ELSE 'mixed' END AS test_pattern,
 preferred_libs
FROM (SELECT *, try_catch + callback + result_type AS e, function_components + class_components + arrow_components AS c FROM (SELECT repo, {", ".join(f"sum({c})::BIGINT AS {c}" for c in _SUMS)} FROM features GROUP BY 1)) s
LEFT JOIN (SELECT repo, count(*) AS n, count(*) FILTER (regexp_matches(d, {q(S.FEATURE_DIR)})) AS f, count(*) FILTER (regexp_matches(d, {q(S.TYPE_DIR)})) AS y
  FROM (SELECT DISTINCT repo, split_part(path, '/', 1) AS d FROM code_files WHERE contains(path, '/')) GROUP BY 1) d USING (repo)
LEFT JOIN pref_libs USING (repo)""", ("features", "code_files", "pref_libs"))


@query("pattern_profile", with_sql("style_profile", """
SELECT repo, import_style, error_handling, file_organization, component_structure, test_pattern, coalesce(array_to_string(preferred_libs, ','), '') AS libs FROM style_profile"""))
def pattern_profile(t):
    p = P.pattern_profile(B.code_files(t))
    return p.withColumn("libs", F.array_join("preferred_libs", ",")).drop("preferred_libs")


_STYLE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(v, {q(p)}) THEN '{s}'" for s, p in words.NAMING_STYLES.items()) + " ELSE 'unknown' END"
_NAMES = "list_concat(" + ", ".join(f"regexp_extract_all(content, {q(p)}, 1)" for p in S.NAME_PATTERNS) + ")"
_POS = "CASE style " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(S.STYLES)) + " END"
define("naming", f"""
SELECT repo, language, arg_max(style, (n, -({_POS}))) AS style FROM (
 SELECT repo, language, style, sum(n)::BIGINT AS n FROM (
  SELECT repo, language, {_STYLE_SQL} AS style, 1 AS n FROM (SELECT repo, language, unnest({_NAMES}) AS v FROM lang_files WHERE language IS NOT NULL)
  UNION ALL SELECT repo, language, 'PascalCase', len(regexp_extract_all(content, {q(S.CLASS_NAME)})) FROM lang_files WHERE language IS NOT NULL) GROUP BY ALL)
WHERE n > 0 GROUP BY ALL""", ("lang_files",))


@query("naming_profile", with_sql("naming", "SELECT repo, language, style FROM naming"))
def naming_profile(t):
    return P.naming_profile(B.code_files(t))


def _alt_sql() -> str:
    out = "NULL"
    for pref, alts in reversed(list(S.ALTERNATIVES.items())):
        out = f"CASE WHEN lib IN ({', '.join(q(a) for a in alts)}) AND list_contains(preferred_libs, {q(pref)}) THEN {q(pref)} ELSE {out} END"
    return out


define("style_rows", f"""
WITH j AS (SELECT * FROM features JOIN style_profile USING (repo)),
l AS (SELECT repo, path, preferred_libs, unnest(list_filter(libs, lambda x: NOT list_contains(preferred_libs, x))) AS lib FROM j WHERE preferred_libs IS NOT NULL)
SELECT repo, path, 'import-style' AS category, 'warning' AS severity, default_imports || ' default imports' AS actual, 'named imports' AS expected FROM j WHERE import_style = 'named' AND default_imports > named_imports
UNION ALL SELECT repo, path, 'import-style', 'warning', named_imports || ' named imports', 'default imports' FROM j WHERE import_style = 'default' AND named_imports > default_imports
UNION ALL SELECT repo, path, 'error-handling', 'warning', callback || ' callback patterns', 'try/catch' FROM j WHERE error_handling = 'try-catch' AND callback > try_catch
UNION ALL SELECT repo, path, 'error-handling', 'info', try_catch || ' try/catch blocks', 'Result type' FROM j WHERE error_handling = 'result-type' AND try_catch > result_type
UNION ALL SELECT repo, path, 'component-structure', 'warning', class_components || ' class declarations', 'function declarations' FROM j WHERE ext IN ('.tsx', '.jsx') AND component_structure = 'function' AND class_components > function_components
UNION ALL SELECT repo, path, 'component-structure', 'info', function_components || ' function declarations', 'arrow functions' FROM j WHERE ext IN ('.tsx', '.jsx') AND component_structure = 'arrow-function' AND function_components > arrow_components
UNION ALL SELECT repo, path, 'test-pattern', 'warning', test_global || ' test() calls', 'describe/it pattern' FROM j WHERE regexp_matches(regexp_extract(path, '([^/]*)$', 1), {q(S.TEST_FILE)}) AND test_pattern = 'describe-it' AND test_global > describe_it
UNION ALL SELECT repo, path, 'lib-preference', 'info', lib, {_alt_sql()} FROM l WHERE {_alt_sql()} IS NOT NULL
UNION ALL SELECT repo, path, 'lib-preference', 'info', lib, array_to_string(preferred_libs, ' or ') FROM l""", ("features", "style_profile"))


def style_rows(t):
    files = B.code_files(t)
    features = P.file_features(files)
    return P.style_violations(features, P.pattern_profile(files, features))


@query("style_violations", with_sql("style_rows", "SELECT * FROM style_rows"))
def style_violations(t):
    return style_rows(t).drop("line")


define("naming_rows", r"""
WITH l AS (SELECT c.repo, path, line, text, style FROM (SELECT *, lower(regexp_extract(path, '(\.[^./]+)$', 1)) AS e FROM code_lines) c
  JOIN (SELECT DISTINCT repo, path, language FROM lang_files) f USING (repo, path) JOIN naming n ON n.repo = c.repo AND n.language = f.language),
a AS (SELECT repo, path, line, unnest(regexp_extract_all(text, '\bclass\s+([a-zA-Z_$][\w$]*)', 1)) AS n FROM l WHERE style = 'PascalCase'),
b AS (SELECT repo, path, line, unnest(regexp_extract_all(text, '\bconst\s+([A-Z][a-zA-Z0-9]+)\s*[=:]', 1)) AS n FROM l WHERE style = 'camelCase')
SELECT repo, path, line, 'naming' AS category, 'error' AS severity, n AS actual, upper(n[1]) || n[2:] AS expected FROM a WHERE NOT regexp_matches(n, '^[A-Z]')
UNION ALL SELECT repo, path, line, 'naming', 'warning', n, lower(n[1]) || n[2:] FROM b WHERE NOT regexp_matches(n, '^[A-Z0-9_]+$')""", ("code_lines", "lang_files", "naming"))


def naming_rows(t):
    files = B.code_files(t)
    return P.naming_violations(to_lines(files), P.naming_profile(files))


@query("naming_violations", with_sql("naming_rows", "SELECT * FROM naming_rows"))
def naming_violations(t):
    return naming_rows(t)


@query("violation_fixes", with_sql("style_rows", """
SELECT repo, path, actual, CASE WHEN category = 'lib-preference' THEN 'import "' || expected || '" instead of "' || actual || '"' ELSE 'use ' || expected || ' here' END AS fix FROM style_rows"""))
def violation_fixes(t):
    return P.suggest_fix(style_rows(t)).select("repo", "path", "actual", "fix")


define("all_violations", """
SELECT repo, category, severity FROM style_rows UNION ALL SELECT repo, category, severity FROM naming_rows""", ("style_rows", "naming_rows"))


def all_violations(t):
    return style_rows(t).select("repo", "category", "severity").unionByName(naming_rows(t).select("repo", "category", "severity"))


@query("violation_rollup", with_sql("all_violations", """
SELECT repo, 'category' AS dim, category AS key, count(*) AS n FROM all_violations GROUP BY ALL UNION ALL SELECT repo, 'severity', severity, count(*) FROM all_violations GROUP BY ALL"""))
def violation_rollup(t):
    return P.violation_rollup(all_violations(t))


@query("consistency_score", with_sql("all_violations", f"""
, d AS (SELECT repo, count(*) AS n, sum(CASE severity WHEN 'error' THEN 15 WHEN 'warning' THEN 5 ELSE 1 END)::BIGINT AS d FROM all_violations GROUP BY 1),
p AS (SELECT source AS repo, least(floor(({NOW_US} - ({NOW_US} - (min(doc_id) % 3) * 86400000000)) / 86400000000) / 7.0::DOUBLE, 1.0::DOUBLE) AS f FROM documents GROUP BY 1)
SELECT repo, coalesce(n, 0) AS violations, greatest(0, least(100, floor(100.0::DOUBLE - coalesce(d, 0) * f + 0.5::DOUBLE)))::BIGINT AS score FROM p LEFT JOIN d USING (repo)"""))
def consistency_score(t):
    profiles = t.documents.groupBy(F.col("source").alias("repo")).agg(
        F.timestamp_micros(F.lit(NOW_US) - (F.min("doc_id") % 3) * F.lit(86400000000)).alias("created_at"))
    return P.consistency_score(all_violations(t), profiles, now())


@query("source_consistency", with_sql("code_files", r"""
, f AS (SELECT repo, contains(content, 'export ') AS e, contains(content, 'interface ') OR contains(content, 'type ')
  OR regexp_matches(content, ':\s*(string|number|boolean|void|never|any|unknown|Record|Partial|Pick|Omit|Promise|Array|Map|Set)<') AS y,
  contains(content, '/**') OR contains(content, '// ') OR contains(content, ' * @') AS d FROM code_files WHERE regexp_matches(path, '\.(ts|js|tsx|jsx)$'))
SELECT repo, count(*) AS files, floor(count(*) FILTER (e)::DOUBLE / count(*)::DOUBLE * 40 + count(*) FILTER (y)::DOUBLE / count(*)::DOUBLE * 35 + count(*) FILTER (d)::DOUBLE / count(*)::DOUBLE * 25 + 0.5::DOUBLE)::BIGINT AS score FROM f GROUP BY 1"""))
def source_consistency(t):
    return P.source_consistency(B.code_files(t))


_IDENT = "list_concat(" + ", ".join(f"regexp_extract_all({{x}}, {q(p)}, 1)" for p in words.DECLARATION_PATTERNS) + ")"
_IMPORTS = r"list_transform(regexp_extract_all({x}, '(?m)(^import\s+[\s\S]*?from\s+[''\"][^''\"]+[''\"];?)', 1), lambda v: trim(v))"


def _delta(k: str) -> str:
    pats = S.COUNTS[k]
    return " + ".join(f"len(regexp_extract_all(after, {q(p)})) - len(regexp_extract_all(before, {q(p)}))" for p in pats)


@query("learned_edits", with_sql("code_files", f"""
, p AS (SELECT repo || path AS id, content AS before, CASE doc_id % 5 WHEN 0 THEN content WHEN 1 THEN content || chr(10) || 'const newName = 1; class Widget {{ }} function doIt() {{}}'
   WHEN 2 THEN content || chr(10) || 'import { '{' } A { '}' } from ''zz'';' WHEN 3 THEN content || chr(10) || 'try {{ x(); }}' ELSE content || ' plain' END AS after FROM code_files),
n AS (SELECT *, list_filter({_IDENT.format(x="after")}, lambda v: NOT list_contains({_IDENT.format(x="before")}, v)) AS raw,
  list_filter({_IMPORTS.format(x="after")}, lambda v: NOT list_contains({_IMPORTS.format(x="before")}, v)) AS imp, {_delta("try_catch")} AS t, {_delta("callback")} AS c, {_delta("result_type")} AS r FROM p),
d AS (SELECT *, list_filter(raw, lambda v, i: list_position(raw, v) = i) AS new FROM n),
s AS (SELECT *, list_transform(new, lambda v: {_STYLE_SQL}) AS st FROM d),
m AS (SELECT *, len(list_filter(imp, lambda v: regexp_matches(v, '^import\\s+[A-Za-z_$][\\w$]*\\s+from'))) AS nd, len(list_filter(imp, lambda v: contains(v, '{{'))) AS nn FROM s),
k AS (SELECT id, arg_max(style, (n, -pos)) AS style, max(n) AS n FROM (SELECT id, style, count(*) AS n, min(pos) AS pos FROM (SELECT id, unnest(st) AS style, unnest(generate_series(1, len(st))) AS pos FROM s) GROUP BY ALL) GROUP BY 1)
SELECT m.id, CASE WHEN before = after OR before = '' THEN 'no-change' WHEN style <> 'unknown' THEN 'naming:' || style WHEN nd + nn > 0 THEN 'import:' || CASE WHEN nd > nn THEN 'default' ELSE 'named' END
  WHEN t > 0 AND t >= c AND t >= r THEN 'error-handling:try-catch' WHEN c > 0 AND c >= t AND c >= r THEN 'error-handling:callback' WHEN r > 0 AND r >= t AND r >= c THEN 'error-handling:result-type' ELSE 'generic-edit' END AS pattern,
 CASE WHEN before = after OR before = '' THEN 0.0 WHEN style <> 'unknown' THEN floor(least(0.5 + k.n::DOUBLE / len(new)::DOUBLE * 0.5, 1.0::DOUBLE) * 10000 + 0.5) / 10000.0 WHEN nd + nn > 0 THEN floor(greatest(nd, nn)::DOUBLE / (nd + nn) * 100 + 0.5) / 100.0
  WHEN t > 0 AND t >= c AND t >= r THEN 0.7 WHEN (c > 0 AND c >= t AND c >= r) OR (r > 0 AND r >= t AND r >= c) THEN 0.6 ELSE 0.3 END::DOUBLE AS confidence FROM m LEFT JOIN k ON k.id = m.id"""))
def learned_edits(t):
    f = B.code_files(t)
    k = F.col("doc_id") % 5
    c = F.col("content")
    add = (F.when(k == 1, "\nconst newName = 1; class Widget { } function doIt() {}").when(k == 2, "\nimport { A } from 'zz';")
           .when(k == 3, "\ntry { x(); }").otherwise(" plain"))
    return P.learn_edits(f.select(F.concat("repo", "path").alias("id"), c.alias("before"), F.when(k == 0, c).otherwise(F.concat(c, add)).alias("after")))


# --- snapshots -----------------------------------------------------------------------


def snapshots(t):
    k = F.col("o_orderkey")
    return t.orders.select(
        F.concat(F.lit("m"), (F.col("o_custkey") % 60).cast("string")).alias("module"), F.col("o_orderdate").alias("ts"), k.alias("seq"),
        (k % 4).alias("typecheck_errors"), (k % 30).alias("lint_warnings"), ((F.floor("o_totalprice") % 101) / 100).alias("test_pass_rate"),
        F.when(k % 6 != 0, (k % 101).cast("double")).alias("test_coverage"), (k % 15).alias("debt_items"), (k % 100).cast("double").alias("consistency_score"))


define("snapshots", """
SELECT *, floor(greatest(0, 100.0::DOUBLE - typecheck_errors * 10) * 0.25::DOUBLE + greatest(0, 100.0::DOUBLE - lint_warnings * 2) * 0.15::DOUBLE + test_pass_rate * 100::DOUBLE * 0.3::DOUBLE
 + coalesce(test_coverage, 0)::DOUBLE * 0.15::DOUBLE + greatest(0, 100.0::DOUBLE - debt_items * 5) * 0.1::DOUBLE + consistency_score * 0.05::DOUBLE + 0.5::DOUBLE)::BIGINT AS score FROM (
SELECT 'm' || (o_custkey % 60) AS module, o_orderdate AS ts, o_orderkey AS seq, o_orderkey % 4 AS typecheck_errors, o_orderkey % 30 AS lint_warnings, (floor(o_totalprice)::BIGINT % 101)::DOUBLE / 100::DOUBLE AS test_pass_rate,
 CASE WHEN o_orderkey % 6 <> 0 THEN (o_orderkey % 101)::DOUBLE END AS test_coverage, o_orderkey % 15 AS debt_items, (o_orderkey % 100)::DOUBLE AS consistency_score FROM orders)""")
define("steps", f"""
SELECT module, seq, u.metric, u.before, u.after, u.after - u.before AS change, (u.after - u.before) * u.dir > 0 AS regression, score, score_before FROM (
 SELECT *, unnest([{", ".join(f"struct_pack(metric := '{m}', before := coalesce(p_{m}, 0)::DOUBLE, after := coalesce({m}, 0)::DOUBLE, dir := {d})" for m, d in Q.METRICS.items())}]) AS u FROM (
  SELECT *, {", ".join(f"lag({m}) OVER w AS p_{m}" for m in Q.METRICS)}, lag(score) OVER w AS score_before FROM snapshots WINDOW w AS (PARTITION BY module ORDER BY ts, seq)) WHERE score_before IS NOT NULL)""", ("snapshots",))


@query("quality_regressions", with_sql("steps", "SELECT module, seq, metric, before, after, change, regression FROM steps"))
def quality_regressions(t):
    return Q.quality_regressions(snapshots(t)).drop("ts")


@query("quality_verdicts", with_sql("steps", """
SELECT module, seq, sum(regression::INT)::INT AS regressed, any_value(score_before) AS score_before, any_value(score) AS score,
 CASE WHEN bool_or(regression) THEN 'FAIL' WHEN any_value(score) >= any_value(score_before) THEN 'PASS_STABLE' ELSE 'PASS' END AS verdict FROM steps GROUP BY ALL"""))
def quality_verdicts(t):
    return Q.quality_verdicts(snapshots(t))


@query("latest_snapshots", with_sql("snapshots", """
SELECT module, seq, typecheck_errors, debt_items, test_coverage FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY ts DESC, seq DESC) AS rn FROM snapshots) WHERE rn = 1"""))
def latest_snapshots(t):
    return Q.latest_per_module(snapshots(t)).select("module", "seq", "typecheck_errors", "debt_items", "test_coverage")


@query("quality_trend", with_sql("snapshots", "SELECT module, seq FROM snapshots WHERE ts >= TIMESTAMP '2000-01-01' - INTERVAL 30 DAY"))
def quality_trend(t):
    return Q.quality_trend(snapshots(t), F.lit("2000-01-01").cast("timestamp"), 30).select("module", "seq")


@query("quality_gate", with_sql("snapshots", """
, g AS (SELECT module, seq, score, list_filter([CASE WHEN typecheck_errors > 0 THEN 'typecheck' END, CASE WHEN test_pass_rate < 0.9::DOUBLE THEN 'pass_rate' END, CASE WHEN test_coverage < 50 THEN 'coverage' END, CASE WHEN score < 70 THEN 'score' END], lambda x: x IS NOT NULL) AS f FROM snapshots)
SELECT module, seq, score, array_to_string(f, ',') AS failures, len(f) = 0 AS passed FROM g"""))
def quality_gate(t):
    return Q.quality_gate(snapshots(t))


@query("gate_score", """
SELECT o_orderpriority AS run, count(*) AS checks, floor(avg((o_orderstatus <> 'P')::INT)::DOUBLE * 100::DOUBLE + 0.5::DOUBLE)::BIGINT AS score, bool_and(o_orderstatus <> 'P') AS all_pass FROM orders GROUP BY 1""")
def gate_score(t):
    return Q.gate_score(t.orders.select(F.col("o_orderpriority").alias("run"), (F.col("o_orderstatus") != "P").alias("passed")))


@query("quality_snapshot", with_sql("todo_rows lang_files", r"""
, d AS (SELECT split_part(path, '/', 1) AS module, count(*) AS n FROM todo_rows GROUP BY 1),
f AS (SELECT split_part(path, '/', 1) AS module, floor(avg(contains(content, 'export ')::INT)::DOUBLE * 40 + avg(contains(content, 'type ')::INT)::DOUBLE * 35 + avg(contains(content, '// ')::INT)::DOUBLE * 25 + 0.5::DOUBLE)::BIGINT AS s FROM lang_files GROUP BY 1),
o AS (SELECT CASE o_custkey % 6 WHEN 0 THEN 'src' WHEN 1 THEN 'lib' WHEN 2 THEN 'auth' WHEN 3 THEN 'docs' ELSE 'other' END AS module, * FROM orders),
a AS (SELECT module, count(*) FILTER (o_orderkey % 50 = 0) AS tc, count(*) FILTER (o_orderkey % 20 = 0) AS lw, avg((o_orderstatus = 'F')::INT)::DOUBLE AS pr,
  floor(sum(o_orderkey % 90)::DOUBLE / sum(100)::DOUBLE * 100::DOUBLE * 100::DOUBLE + 0.5::DOUBLE)::DOUBLE / 100::DOUBLE AS cv FROM o GROUP BY 1)
SELECT coalesce(a.module, f.module) AS module, coalesce(tc, 0) AS typecheck_errors, coalesce(lw, 0) AS lint_warnings, floor(coalesce(pr, 1.0::DOUBLE) * 10000::DOUBLE + 0.5::DOUBLE)::DOUBLE / 10000::DOUBLE AS test_pass_rate, cv AS test_coverage,
 coalesce(d.n, 0) AS debt_items, coalesce(s, 50) AS consistency_score FROM a FULL JOIN f USING (module) LEFT JOIN d ON d.module = coalesce(a.module, f.module)"""))
def quality_snapshot(t):
    """Tool results per order module, debt and source features per top folder."""
    from ..functions.maths import half_up
    from ..operators.debt import comment_items
    from ..sources.files import module_of

    k = F.col("o_custkey") % 6
    o = t.orders.withColumn("module", F.when(k == 0, "src").when(k == 1, "lib").when(k == 2, "auth").when(k == 3, "docs").otherwise("other"))
    files = B.code_files(t)
    c = F.col("content")
    snap = Q.quality_snapshot(
        o.where("o_orderkey % 50 = 0"), o.where("o_orderkey % 20 = 0"), o.select("module", (F.col("o_orderstatus") == "F").alias("passed")),
        o.select("module", (F.col("o_orderkey") % 90).alias("covered"), F.lit(100).alias("total")),
        comment_items(to_lines(files), "todo").select(module_of(F.col("path")).alias("module")),
        files.select(module_of(F.col("path")).alias("module"), c.contains("export ").alias("exported"), c.contains("type ").alias("typed"), c.contains("// ").alias("documented")))
    return snap.withColumn("test_pass_rate", half_up(F.col("test_pass_rate"), 4))


def stat_history(t):
    k = F.col("o_orderkey")
    return t.orders.select(F.concat(F.lit("m"), (F.col("o_custkey") % 60).cast("string")).alias("module"), F.col("o_orderdate").alias("ts"), k.alias("seq"),
                           (k % 97).alias("files"), (k % 9973).alias("lines"), (k % 41).alias("deps"))


@query("stats_trend", """
SELECT 'm' || (o_custkey % 60) AS module, o_orderkey AS seq, o_orderkey % 97 AS files, o_orderkey % 9973 AS lines, o_orderkey % 41 AS deps,
 o_orderkey % 97 - lag(o_orderkey % 97) OVER w AS files_step, o_orderkey % 9973 - lag(o_orderkey % 9973) OVER w AS lines_step, o_orderkey % 41 - lag(o_orderkey % 41) OVER w AS deps_step
FROM orders WINDOW w AS (PARTITION BY o_custkey % 60 ORDER BY o_orderdate, o_orderkey)""")
def stats_trend(t):
    return Q.stats_trend(stat_history(t))


@query("stats_overall", """
SELECT 'm' || (o_custkey % 60) AS module, arg_max(o_orderkey % 97, (o_orderdate, o_orderkey)) - arg_min(o_orderkey % 97, (o_orderdate, o_orderkey)) AS files_change,
 arg_max(o_orderkey % 9973, (o_orderdate, o_orderkey)) - arg_min(o_orderkey % 9973, (o_orderdate, o_orderkey)) AS lines_change,
 arg_max(o_orderkey % 41, (o_orderdate, o_orderkey)) - arg_min(o_orderkey % 41, (o_orderdate, o_orderkey)) AS deps_change, count(*) AS snapshots FROM orders GROUP BY o_custkey % 60""")
def stats_overall(t):
    return Q.stats_overall(stat_history(t))
