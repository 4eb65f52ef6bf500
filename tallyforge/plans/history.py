"""Git-history queries over ``orders`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gitstats as G
from . import bindings as B
from .bindings import define, pick, with_sql
from .registry import query


@query("recent_commits", with_sql("commits", """
SELECT repo, left(hash, 8) AS hash, author, epoch(ts)::BIGINT AS at, message FROM commits WHERE ts >= TIMESTAMP '2001-01-01' - INTERVAL 400 DAY"""))
def recent_commits(t):
    rows = G.recent_commits(B.commits(t), 400, F.lit("2001-01-01").cast("timestamp"))
    return rows.select("repo", "hash", "author", F.unix_seconds("ts").alias("at"), "message")


@query("sprint_report", with_sql("commits commit_files", """
, s AS (SELECT hash, count(*) AS f, sum(additions) AS a, sum(deletions) AS d FROM commit_files GROUP BY 1),
j AS (SELECT author, f, a, d FROM commits LEFT JOIN s USING (hash) WHERE ts >= TIMESTAMP '1997-06-01')
SELECT CASE WHEN grouping(author) = 1 THEN '(total)' ELSE author END AS author, count(*) AS commits, coalesce(sum(f), 0)::BIGINT AS files_changed,
 coalesce(sum(a), 0)::BIGINT AS insertions, coalesce(sum(d), 0)::BIGINT AS deletions FROM j GROUP BY ROLLUP (author)"""))
def sprint_report(t):
    return G.sprint_report(B.commits(t), B.commit_files(t), F.lit("1997-06-01").cast("timestamp"))


def pull_requests(t):
    key = F.col("o_custkey")
    status = F.col("o_orderstatus")
    return t.orders.select(
        F.col("o_orderkey").alias("pr"),
        F.when(status == "O", "open").when(status == "F", "merged").otherwise("closed").alias("state"),
        F.col("o_orderdate").alias("created_at"),
        F.when(key % 5 != 0, F.col("o_orderdate") + F.make_dt_interval(hours=(key % 72).cast("int"))).alias("first_review_at"),
        pick(["MERGEABLE", "CONFLICTING", "UNKNOWN"], key % 3).alias("mergeable"))


@query("team_metrics", """
SELECT count(*) FILTER (o_orderstatus = 'O') AS open_prs, count(*) FILTER (o_orderstatus = 'O' AND o_custkey % 5 = 0) AS unreviewed_prs,
 floor((avg((o_custkey % 72)::DOUBLE) FILTER (o_custkey % 5 <> 0)) * 10::DOUBLE + 0.5::DOUBLE)::DOUBLE / 10::DOUBLE AS avg_review_hours,
 (SELECT count(*) FROM customer WHERE c_nationkey % 3 = 0) AS stale_branches FROM orders""")
def team_metrics(t):
    branches = t.customer.select((F.col("c_nationkey") % 3 == 0).alias("merged"))
    return G.team_metrics(pull_requests(t), branches)


@query("pr_readiness", """
WITH c AS (SELECT l_orderkey AS pr, bool_and(l_returnflag IN ('A', 'N')) AS ok, bool_or(l_linestatus = 'F' AND l_linenumber = 1) AS yes FROM lineitem GROUP BY 1),
p AS (SELECT o_orderkey AS pr, coalesce(ok, true) AS checks_pass, coalesce(yes, false) AS approved, o_custkey % 3 = 0 AS up_to_date, o_custkey % 3 <> 1 AS no_conflict
  FROM orders LEFT JOIN c ON c.pr = o_orderkey)
SELECT *, checks_pass AND approved AND no_conflict AS can_merge FROM p""")
def pr_readiness(t):
    li = t.lineitem
    checks = li.select(F.col("l_orderkey").alias("pr"), F.when(F.col("l_returnflag") == "A", "SUCCESS")
                       .when(F.col("l_returnflag") == "N", "PASS").otherwise("FAILURE").alias("state"))
    reviews = li.select(F.col("l_orderkey").alias("pr"), F.when(
        (F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1), "APPROVED").otherwise("COMMENTED").alias("state"))
    return G.pr_readiness(pull_requests(t), checks, reviews)


@query("bus_factor", with_sql("commit_files", """
, a AS (SELECT repo, path, string_agg(author, ',' ORDER BY author) AS authors, count(*)::INT AS n_authors FROM (SELECT DISTINCT repo, path, author FROM commit_files) GROUP BY ALL)
SELECT repo, path, authors, n_authors, CASE WHEN n_authors <= 1 THEN 'high' ELSE 'medium' END AS risk FROM a WHERE n_authors <= 20"""))
def bus_factor(t):
    return G.bus_factor(B.commit_files(t), 20)


@query("review_fatigue", with_sql("commits", """
SELECT author, count(*) AS commits, floor(count(*)::DOUBLE / (SELECT count(*) FROM commits)::DOUBLE * 10000::DOUBLE + 0.5::DOUBLE)::DOUBLE / 10000::DOUBLE AS share,
 count(*) > 0.5 * (SELECT count(*) FROM commits) AS fatigue_risk FROM commits GROUP BY 1"""))
def review_fatigue(t):
    return G.review_fatigue(B.commits(t))


@query("review_fatigue_by_repo", with_sql("commits", """
, n AS (SELECT repo, count(*) AS n FROM commits GROUP BY 1)
SELECT repo, author, count(*) AS commits, floor(count(*)::DOUBLE / any_value(n)::DOUBLE * 10000::DOUBLE + 0.5::DOUBLE)::DOUBLE / 10000::DOUBLE AS share,
 count(*) > 0.5 * any_value(n) AS fatigue_risk FROM commits JOIN n USING (repo) GROUP BY 1, 2"""))
def review_fatigue_by_repo(t):
    return G.review_fatigue(B.commits(t), ("repo",))


_TYPE = r"coalesce(nullif(regexp_extract(message, '^(\w+)(?:\(.+\))?:', 1), ''), 'other')"


@query("standup", with_sql("commits", f"""
SELECT {_TYPE} AS type, left(hash, 7) AS hash, author, message FROM commits WHERE ts >= TIMESTAMP '2000-01-01'"""))
def standup(t):
    return G.standup(B.commits(t).where(F.col("ts") >= F.lit("2000-01-01").cast("timestamp")))


@query("standup_counts", with_sql("commits", f"SELECT {_TYPE} AS type, count(*) AS n FROM commits GROUP BY 1"))
def standup_counts(t):
    return G.standup(B.commits(t)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("change_summary", with_sql("commit_files", """
SELECT repo, path, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions FROM commit_files GROUP BY ALL"""))
def change_summary(t):
    return G.change_summary(B.commit_files(t))


def tags(t):
    """Quarterly releases per repo, derived from the commits: the last commit time of each quarter
    but the latest one."""
    commits = B.commits(t)
    quarter = F.concat(F.lit("v"), F.year("ts").cast("string"), F.lit("."), F.quarter("ts").cast("string"))
    return commits.where(F.year("ts") < 2000).groupBy("repo", quarter.alias("version")).agg(F.max("ts").alias("ts"))


define("tags", """
SELECT repo, 'v' || year(ts) || '.' || quarter(ts) AS version, max(ts) AS ts FROM commits WHERE year(ts) < 2000 GROUP BY ALL""", ("commits",))
define("released", """
SELECT c.*, coalesce((SELECT min_by(g.version, g.ts) FROM tags g WHERE g.repo = c.repo AND g.ts >= c.ts), 'Unreleased') AS version FROM commits c""", ("commits", "tags"))
_KIND = r"""CASE WHEN regexp_matches(message, '(?i)^feat') THEN 'features' WHEN regexp_matches(message, '(?i)^fix') THEN 'fixes'
 WHEN regexp_matches(message, '(?i)^breaking|!:') THEN 'breaking' WHEN regexp_matches(message, '(?i)^refactor') THEN 'refactors'
 WHEN regexp_matches(message, '(?i)^(?:chore|docs|test|build)') THEN 'chores' END"""


@query("changelog", with_sql("released", rf"""
, k AS (SELECT repo, version, {_KIND} AS kind, hash, message FROM released)
SELECT repo, version, kind, hash, CASE WHEN kind = 'breaking' THEN regexp_replace(message, '^[^(]*\)?!?:\s*', '')
 ELSE regexp_replace(message, '(?i)^(feat|fix|refactor|chore|docs|test|build)(\([^)]+\))?:\s*', '') END AS entry FROM k WHERE kind IS NOT NULL"""))
def changelog(t):
    return G.changelog(B.commits(t), tags(t))


@query("changelog_counts", with_sql("released", f"""
SELECT repo, version, kind, count(*) AS n FROM (SELECT repo, version, {_KIND} AS kind FROM released) WHERE kind IS NOT NULL GROUP BY ALL"""))
def changelog_counts(t):
    return G.changelog(B.commits(t), tags(t)).groupBy("repo", "version", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("pull_request_buckets", with_sql("commits", """
SELECT repo, CASE WHEN regexp_matches(message, '(?i)^feat') THEN 'features' WHEN regexp_matches(message, '(?i)^fix') THEN 'fixes'
 WHEN regexp_matches(message, '(?i)^breaking|!:') THEN 'breaking' WHEN regexp_matches(message, '(?i)^(?:chore|docs|test)') THEN 'chores' ELSE 'features' END AS kind,
 count(*) AS n FROM commits GROUP BY ALL"""))
def pull_request_buckets(t):
    return B.commits(t).groupBy("repo", G.pull_request_kind(F.col("message")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


define("path_sizes", """
SELECT repo, path, max(additions * 3000)::BIGINT AS n_bytes FROM commit_files GROUP BY ALL""", ("commit_files",))
define("scored_changes", r"""
, p AS (SELECT repo, path, count(DISTINCT hash) AS commits, max(ts) AS last FROM commit_files GROUP BY ALL),
s AS (SELECT repo, path, commits, CASE WHEN regexp_matches(path, '\.(ts|tsx|js|jsx)$') THEN 10 WHEN regexp_matches(path, '\.(json|yaml|yml|toml)$') THEN 5 ELSE 0 END
 + CASE WHEN len(string_split(path, '/')) >= 4 THEN 10 WHEN len(string_split(path, '/')) >= 3 THEN 5 ELSE 0 END
 + CASE WHEN commits >= 3 THEN 15 WHEN commits = 2 THEN 8 ELSE 0 END
 + CASE WHEN epoch(TIMESTAMP '2001-06-01') - epoch(last) <= 86400 THEN 10 WHEN epoch(TIMESTAMP '2001-06-01') - epoch(last) <= 7 * 86400 THEN 5 ELSE 0 END
 + CASE WHEN n_bytes > 100000 THEN 10 WHEN n_bytes > 50000 THEN 5 ELSE 0 END AS score FROM p JOIN path_sizes USING (repo, path))
""".lstrip(), ("path_sizes",))
_SCORED = __import__("tallyforge.plans.bindings", fromlist=["x"])._SQL.pop("scored_changes")[1]


def scored(t):
    files = B.commit_files(t)
    sizes = files.groupBy("repo", "path").agg((F.max("additions") * 3000).alias("n_bytes"))
    return G.change_risk(files, sizes, F.lit("2001-06-01").cast("timestamp"))


_BAND = "CASE WHEN score >= 20 THEN 'high' WHEN score >= 10 THEN 'medium' ELSE 'low' END"


@query("change_risk", with_sql("path_sizes", _SCORED + f"SELECT repo, path, commits, score, {_BAND} AS band FROM s"))
def change_risk(t):
    return scored(t)


@query("high_risk_changes", with_sql("path_sizes", _SCORED + "SELECT repo, path, score FROM s WHERE score >= 20 ORDER BY score DESC, repo, path LIMIT 50"))
def high_risk_changes(t):
    return G.high_risk(scored(t)).select("repo", "path", "score")


@query("change_risk_counts", with_sql("path_sizes", _SCORED + f"SELECT {_BAND} AS band, count(*) AS n FROM s GROUP BY 1"))
def change_risk_counts(t):
    return scored(t).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query("inferred_commit_types", with_sql("commits commit_files", r"""
, t AS (SELECT hash, split_part(path, '/', 1) AS top, count(*) AS n FROM commit_files GROUP BY ALL),
m AS (SELECT hash, top, row_number() OVER (PARTITION BY hash ORDER BY n DESC, top DESC) AS rn FROM t),
f AS (SELECT hash, bool_or(regexp_matches(path, '^src/|^lib/|^app/')) AS code, bool_or(regexp_matches(path, 'test/|\.spec\.|\.test\.')) AS tst,
  bool_or(regexp_matches(path, '\.md$|docs/')) AS doc, bool_or(regexp_matches(path, 'Dockerfile|\.github/|\.gitlab|Makefile')) AS ci FROM commit_files GROUP BY 1)
SELECT hash, CASE WHEN code THEN CASE WHEN regexp_matches(message, '(?i)refactor|cleanup|architect') THEN 'refactor' WHEN regexp_matches(message, '(?i)fix|bug|resolve|patch') THEN 'fix' ELSE 'feat' END
  WHEN tst THEN 'test' WHEN doc THEN 'docs' WHEN ci THEN 'ci' ELSE 'chore' END AS type,
  CASE WHEN top NOT IN ('', '.', 'src') THEN top END AS scope
FROM f JOIN m USING (hash) JOIN commits USING (hash) WHERE rn = 1"""))
def inferred_commit_types(t):
    return G.infer_commit_type(B.commit_files(t), B.commits(t))


@query("commit_parts", with_sql("commits", r"""
SELECT repo, hash, regexp_matches(message, '^(feat|fix|chore|docs|refactor|test|style|perf|ci|build|revert)(\(.+\))?!?:\s.+') AS valid,
 nullif(regexp_extract(message, '^(feat|fix|chore|docs|refactor|test|style|perf|ci|build|revert)(?:\(.+\))?!?:\s.+', 1), '') AS type,
 nullif(regexp_extract(message, '^(?:feat|fix|chore|docs|refactor|test|style|perf|ci|build|revert)\((.+)\)!?:\s.+', 1), '') AS scope,
 regexp_matches(message, '^(?:feat|fix|chore|docs|refactor|test|style|perf|ci|build|revert)(?:\(.+\))?!:\s.+') AS breaking,
 regexp_replace(message, '^(?:feat|fix|chore|docs|refactor|test|style|perf|ci|build|revert)(?:\(.+\))?!?:\s', '') AS subject FROM commits"""))
def commit_parts(t):
    return G.commit_table(B.commits(t))


# --- benchmark runs ------------------------------------------------------------------


def bench_runs(t):
    return t.lineitem.select(
        F.concat(F.lit("b"), (F.col("l_partkey") % 50).cast("string")).alias("name"), F.col("l_shipdate").alias("ts"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"), F.floor("l_extendedprice").cast("double").alias("duration"))


define("bench_runs", """
SELECT 'b' || (l_partkey % 50) AS name, l_shipdate AS ts, l_orderkey * 100 + l_linenumber AS seq, floor(l_extendedprice)::DOUBLE AS duration FROM lineitem""")


@query("bench_regression", with_sql("bench_runs", """
, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts DESC, seq DESC, duration DESC) AS rn FROM bench_runs),
a AS (SELECT name, max(duration) FILTER (rn = 1) AS cur, avg(duration) FILTER (rn BETWEEN 2 AND 10) AS p FROM r WHERE rn <= 10 GROUP BY 1 HAVING count(*) >= 2)
SELECT name, (cur - p) / p * 100::DOUBLE > 10 AS regressed, floor((cur - p) / p * 100::DOUBLE * 10::DOUBLE + 0.5::DOUBLE)::DOUBLE / 10::DOUBLE AS change, cur AS current,
 floor(p * 10::DOUBLE + 0.5::DOUBLE)::DOUBLE / 10::DOUBLE AS previous FROM a"""))
def bench_regression(t):
    return G.bench_regression(bench_runs(t))


@query("bench_history", with_sql("bench_runs", """
SELECT name, seq, duration, floor(avg(duration) OVER (PARTITION BY name ORDER BY ts, seq, duration ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING) * 1000::DOUBLE + 0.5::DOUBLE)::DOUBLE / 1000::DOUBLE AS baseline FROM bench_runs"""))
def bench_history(t):
    from ..functions.maths import half_up

    return G.bench_history(bench_runs(t)).select("name", "seq", "duration", half_up(F.col("baseline"), 3).alias("baseline"))
