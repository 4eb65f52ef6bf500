"""Commit history: sprints, bus factor, fatigue, changelogs, risk, benchmarks, pull requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates
from ..functions.maths import half_up
from ..functions.text import commit_parts
from ..sources.files import extension
from .history import first_rows, lookback, sharded, with_history


def recent_commits(commits: DataFrame, days: int, now: Column, repo: str | None = None) -> DataFrame:
    """Commits of the last ``days`` days; the cut is a plain column filter and can be pushed down."""
    rows = commits.where(F.col("ts") >= now - F.make_dt_interval(F.lit(days)))
    if repo:
        rows = rows.where(F.col("repo") == repo)
    return rows.select("repo", F.left("hash", F.lit(8)).alias("hash"), "author", "ts", "message")


def sprint_report(commits: DataFrame, files: DataFrame, since: Column) -> DataFrame:
    """Commits, files changed, insertions and deletions per author plus a ``(total)`` row.

    Files of earlier commits are left out before they are summed.
    """
    recent = commits.where(F.col("ts") >= since).select("hash")
    sizes = files.join(recent, "hash", "left_semi").groupBy("hash").agg(
        F.count(F.lit(1)).alias("_f"), F.sum("additions").alias("_a"), F.sum("deletions").alias("_d"))
    return (
        commits.where(F.col("ts") >= since).select("hash", "author")
        .join(sizes, "hash", "left")
        .rollup("author")
        .agg(F.count(F.lit(1)).alias("commits"),
             F.coalesce(F.sum("_f"), F.lit(0)).alias("files_changed"),
             F.coalesce(F.sum("_a"), F.lit(0)).alias("insertions"),
             F.coalesce(F.sum("_d"), F.lit(0)).alias("deletions"),
             F.grouping("author").alias("_g"))
        .select(F.when(F.col("_g") == 1, "(total)").otherwise(F.col("author")).alias("author"),
                "commits", "files_changed", "insertions", "deletions")
    )


def team_metrics(prs: DataFrame, branches: DataFrame) -> DataFrame:
    """Open and unreviewed pull requests, measured review hours, merged leftover branches."""
    hours = (F.unix_seconds("first_review_at") - F.unix_seconds("created_at")) / F.lit(3600.0)
    is_open = F.col("state") == "open"
    counts = prs.agg(
        F.count_if(is_open).alias("open_prs"),
        F.count_if(is_open & F.col("first_review_at").isNull()).alias("unreviewed_prs"),
        half_up(F.avg(hours), 1).alias("avg_review_hours"))
    stale = branches.agg(F.count_if("merged").alias("_n")).scalar()
    return counts.withColumn("stale_branches", stale)


def pr_readiness(prs: DataFrame, checks: DataFrame, reviews: DataFrame) -> DataFrame:
    """Merge readiness per pull request; no check counts as passing, no review as not approved."""
    ok = checks.groupBy("pr").agg(F.every(F.col("state").isin("SUCCESS", "PASS")).alias("_ok"))
    yes = reviews.groupBy("pr").agg(F.bool_or(F.col("state") == "APPROVED").alias("_yes"))
    return (
        prs.join(ok, "pr", "left").join(yes, "pr", "left")
        .select("pr", F.coalesce("_ok", F.lit(True)).alias("checks_pass"),
                F.coalesce("_yes", F.lit(False)).alias("approved"),
                (F.col("mergeable") == "MERGEABLE").alias("up_to_date"),
                (F.col("mergeable") != "CONFLICTING").alias("no_conflict"))
        .withColumn("can_merge", F.col("checks_pass") & F.col("approved") & F.col("no_conflict"))
    )


def bus_factor(blame: DataFrame, threshold: int = 2) -> DataFrame:
    """Files of a repo written by at most ``threshold`` authors, with those authors and a risk label.

    At most threshold + 1 authors per file are ever brought together.
    """
    authors = blame.where(F.length(F.trim("author")) > 0).select("repo", "path", "author").distinct()
    few = first_rows(authors, ["repo", "path"], [F.col("author")], threshold + 1)
    return (
        few.groupBy("repo", "path").agg(F.sort_array(F.collect_list("author")).alias("_a"))
        .where(F.size("_a") <= threshold)
        .select("repo", "path", F.array_join("_a", ",").alias("authors"), F.size("_a").alias("n_authors"),
                F.when(F.size("_a") <= 1, "high").otherwise("medium").alias("risk"))
    )


def review_fatigue(commits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Commits per author (of each ``by`` group, such as the repo), share of all commits there, and whether the share
    exceeds one half."""
    counts = commits.where(F.trim("author") != "").groupBy(*by, "author").agg(F.count(F.lit(1)).alias("commits"))
    if by:
        # authors per group are few rows; their sum needs no second reading of the commits
        total = counts.groupBy(*by).agg(F.sum("commits").alias("_n"))
        shared = counts.join(total, list(by)).withColumn("_share", F.col("commits") / F.col("_n"))
    else:
        total = commits.where(F.trim("author") != "").agg(F.count(F.lit(1)).alias("_n")).scalar()
        shared = counts.withColumn("_share", F.col("commits") / total)
    return shared.select(*by, "author", "commits", half_up(F.col("_share"), 4).alias("share"), (F.col("_share") > 0.5).alias("fatigue_risk"))


def commit_type(message: Column) -> Column:
    """Leading conventional word, ``other`` when there is none."""
    kind = F.regexp_extract(message, r"^(\w+)(?:\(.+\))?:", 1)
    return F.when(kind == "", "other").otherwise(kind)


def standup(commits: DataFrame) -> DataFrame:
    """Commits labelled by type: rows, never lists, so a busy type stays distributed."""
    return commits.select(
        commit_type(F.col("message")).alias("type"), F.left("hash", F.lit(7)).alias("hash"), "author",
        F.trim("message").alias("message"))


def change_summary(files: DataFrame) -> DataFrame:
    """Lines added and deleted per file of a repo."""
    return files.groupBy("repo", "path").agg(
        F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))


def changelog_kind(message: Column) -> Column:
    """features, fixes, breaking, refactors or chores; null for messages in no bucket."""
    return (
        F.when(message.rlike("(?i)^feat"), "features").when(message.rlike("(?i)^fix"), "fixes")
        .when(message.rlike("(?i)^breaking|!:"), "breaking").when(message.rlike("(?i)^refactor"), "refactors")
        .when(message.rlike("(?i)^(?:chore|docs|test|build)"), "chores")
    )


def pull_request_kind(message: Column) -> Column:
    """Buckets of a pull-request description: everything unknown counts as a feature."""
    kind = changelog_kind(message)
    return F.when(kind.isin("features", "fixes", "breaking"), kind).when(
        message.rlike("(?i)^(?:chore|docs|test)"), "chores").otherwise("features")


def changelog_entry(message: Column) -> Column:
    """Message without its type prefix."""
    typed = F.regexp_replace(message, r"(?i)^(feat|fix|refactor|chore|docs|test|build)(\([^)]+\))?:\s*", "")
    broken = F.regexp_replace(message, r"^[^(]*\)?!?:\s*", "")
    return F.when(changelog_kind(message) == "breaking", broken).otherwise(typed)


def with_release(commits: DataFrame, tags: DataFrame) -> DataFrame:
    """Adds the first release at or after each commit; later commits are ``Unreleased``. tags(repo, version, ts).

    Commits and tags lie in one order, a tag after the commits of its own time; the next tag is the last one seen from
    behind, within a shard and, where a shard ends without one, the first of the shards after it.
    """
    from pyspark.sql import Window as W

    both = commits.select("repo", "ts", F.lit(0).alias("_tag"), F.lit(None).cast("string").alias("version"), "hash", "author", "message").unionByName(
        tags.select("repo", "ts", F.lit(1).alias("_tag"), "version"), allowMissingColumns=True)
    rows = sharded(both, ["repo"], ["ts", "_tag", "version", "hash"])
    behind = W.partitionBy("repo", "_shard").orderBy(F.desc("ts"), F.desc("_tag"), F.desc("version"))
    seen = rows.withColumn("_next", F.last("version", ignorenulls=True).over(behind.rowsBetween(W.unboundedPreceding, W.currentRow)))
    first = rows.groupBy("repo", "_shard").agg(F.min(F.when(F.col("_tag") == 1, F.struct("ts", "version"))).alias("_first"))
    later = W.partitionBy("repo").orderBy(F.desc("_shard")).rowsBetween(W.unboundedPreceding, -1)
    carried = first.select("repo", "_shard", F.last("_first", ignorenulls=True).over(later)["version"].alias("_carried"))
    return seen.where("_tag = 0").join(carried, ["repo", "_shard"]).select(
        "repo", "hash", "author", "ts", "message", F.coalesce("_next", "_carried", F.lit("Unreleased")).alias("version"))


def changelog(commits: DataFrame, tags: DataFrame) -> DataFrame:
    """(repo, version, kind, hash, entry) rows of every bucketed commit."""
    return (
        with_release(commits, tags)
        .select("repo", "version", changelog_kind(F.col("message")).alias("kind"), "hash",
                changelog_entry(F.col("message")).alias("entry"))
        .where(F.col("kind").isNotNull())
    )


def change_risk(changes: DataFrame, sizes: DataFrame, now: Column) -> DataFrame:
    """Regression risk per changed file of a repo: type, depth, commits, recency and size points.

    changes(repo, path, hash, ts), sizes(repo, path, n_bytes).
    """
    per = changes.groupBy("repo", "path").agg(F.countDistinct("hash").alias("commits"), F.max("ts").alias("_last"))
    ext = extension(F.col("path"))
    depth = F.size(F.split("path", "/"))
    n = F.col("commits")
    points = (
        F.when(ext.isin(".ts", ".tsx", ".js", ".jsx"), 10).when(ext.isin(".json", ".yaml", ".yml", ".toml"), 5).otherwise(0)
        + F.when(depth >= 4, 10).when(depth >= 3, 5).otherwise(0)
        + F.when(n >= 3, 15).when(n == 2, 8).otherwise(0)
        + dates.recency_points(F.col("_last"), now)
        + F.when(F.col("n_bytes") > 100_000, 10).when(F.col("n_bytes") > 50_000, 5).otherwise(0)
    )
    return (
        per.join(sizes.select("repo", "path", "n_bytes"), ["repo", "path"], "left")
        .select("repo", "path", "commits", points.alias("score"))
        .withColumn("band", F.when(F.col("score") >= 20, "high").when(F.col("score") >= 10, "medium").otherwise("low"))
    )


def high_risk(scored: DataFrame, k: int = 50) -> DataFrame:
    return scored.where(F.col("band") == "high").orderBy(F.col("score").desc(), "repo", "path").limit(k)


def infer_commit_type(files: DataFrame, commits: DataFrame) -> DataFrame:
    """Commit type and scope from the changed paths and the title.

    The scope is the most frequent first path segment (largest name on a tie) unless it is src.
    """
    p = F.col("path")
    flags = files.groupBy("hash", F.substring_index("path", "/", 1).alias("_top")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.bool_or(p.rlike("^src/|^lib/|^app/")).alias("_code"),
        F.bool_or(p.rlike(r"test/|\.spec\.|\.test\.")).alias("_test"),
        F.bool_or(p.rlike(r"\.md$|docs/")).alias("_docs"),
        F.bool_or(p.rlike(r"Dockerfile|\.github/|\.gitlab|Makefile")).alias("_ci"),
        F.bool_or(p.contains("package.json")).alias("_pkg"))
    per = flags.groupBy("hash").agg(
        F.max(F.struct("_n", "_top")).alias("_m"),
        *[F.bool_or(c).alias(c) for c in ("_code", "_test", "_docs", "_ci", "_pkg")])
    title = F.col("message")
    kind = (
        F.when(F.col("_code"), F.when(title.rlike("(?i)refactor|cleanup|architect"), "refactor")
               .when(title.rlike("(?i)fix|bug|resolve|patch"), "fix").otherwise("feat"))
        .when(F.col("_test"), "test").when(F.col("_docs"), "docs").when(F.col("_ci"), "ci").otherwise("chore")
    )
    top = F.col("_m._top")
    scope = F.when((top != "") & ~top.isin(".", "src"), top).when(F.col("_pkg"), "deps")
    return per.join(commits.select("hash", "message"), "hash").select(
        "hash", kind.alias("type"), scope.alias("scope"))


def bench_regression(runs: DataFrame) -> DataFrame:
    """Latest run per benchmark against the mean of up to nine before it.

    Only ten runs per name reach the exchange's final side: the rank limit also runs per task.
    """
    last = first_rows(runs, ["name"], [F.col("ts").desc(), F.col("seq").desc()], 10)
    key = F.struct("ts", "seq")
    per = last.groupBy("name").agg(
        F.count(F.lit(1)).alias("_n"), F.max_by("duration", key).alias("current"),
        F.sum("duration").alias("_sum"))
    prev = (F.col("_sum") - F.col("current")) / (F.col("_n") - 1)
    return (
        per.where(F.col("_n") >= 2).withColumn("_p", prev)
        .withColumn("_c", (F.col("current") - F.col("_p")) / F.col("_p") * 100)
        .select("name", (F.col("_c") > 10).alias("regressed"), half_up(F.col("_c"), 1).alias("change"), "current",
                half_up(F.col("_p"), 1).alias("previous"))
    )


def bench_history(runs: DataFrame) -> DataFrame:
    """Every run with the mean of up to nine runs before it; a shard gets the last nine rows of those before it."""
    order = ["ts", "seq"]
    placed = sharded(runs.select("name", "ts", "seq", "duration"), ["name"], order)
    frame = lookback(["name"], "_shard", order).rowsBetween(-9, -1)
    return (
        with_history(placed, ["name"], "_shard", order, 9)
        .withColumn("baseline", F.avg("duration").over(frame))
        .where(~F.col("carried"))
        .select("name", "ts", "seq", "duration", "baseline")
    )


def commit_table(commits: DataFrame) -> DataFrame:
    """Parsed conventional parts per commit."""
    return commits.withColumn("_p", commit_parts(F.col("message"))).select("repo", "hash", "_p.*")
