"""Rules over lines. A short rule list becomes expressions: every rule is a predicate of one projection, so n rules cost
one pass and no join. A rule table, or a longer list, goes through the literal index of ``contain``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.errors import PySparkException

from ..functions.arrays import present
from ..functions.rx import ascii_bounds
from ..rules.bugs import RULES, Rule
from .contain import matching

#: Rules that become expressions; more are looked up through their literals.
INLINE_RULES = 200


def _accepted(spark: SparkSession, patterns: list[str]) -> bool:
    tests = ", ".join(f"rlike('', :p{i})" for i in range(len(patterns)))
    try:
        spark.sql(f"SELECT {tests}", args={f"p{i}": p for i, p in enumerate(patterns)}).head()
        return True
    except PySparkException:
        return False


def usable(spark: SparkSession, rules: Sequence[Rule]) -> list[Rule]:
    """Rules whose regex the JVM accepts; a broken one is left out, the others still run.

    All patterns are tried together; a failing set is halved until the broken ones are alone.
    """
    rules = list(rules)
    if not rules or _accepted(spark, [ascii_bounds(r.pattern) for r in rules]):
        return rules
    if len(rules) == 1:
        return []
    half = len(rules) // 2
    return usable(spark, rules[:half]) + usable(spark, rules[half:])


def active_rules(rules: Iterable[Rule] = RULES, suppressed: Iterable[str] = ()) -> list[Rule]:
    off = set(suppressed)
    return [r for r in rules if r.active and r.rule_id not in off]


def rule_hits(text: Column, lang: Column, rules: Sequence[Rule]) -> Column:
    """Array of struct(rule_id, category, severity, fix) of the rules matching the text."""
    options = []
    for r in rules:
        pattern = ("(?i)" if r.ignore_case else "") + ascii_bounds(r.pattern)
        hit = text.rlike(pattern)
        if "*" not in r.languages:
            hit = lang.isin(*r.languages) & hit
        options.append(
            F.when(hit, F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.category).alias("category"),
                                 F.lit(r.severity).alias("severity"), F.lit(r.fix).alias("fix")))
        )
    return present(options)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def rule_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """Rules as rows(rule_id, category, severity, fix, pattern, languages, ignore_case, active)."""
    return spark.createDataFrame(
        [(r.rule_id, r.category, r.severity, r.fix, r.pattern, list(r.languages), r.ignore_case, r.active) for r in rules],
        "rule_id string, category string, severity string, fix string, pattern string, languages array<string>, ignore_case boolean, active boolean")


def findings_by_table(lines: DataFrame, rules: DataFrame, suppressed: DataFrame | None = None) -> DataFrame:
    """Findings of a rule table of any size, see ``rule_table``; suppressed(rule_id) are left out.

    Each line meets only the rules one of whose literals it holds; unusable patterns are skipped.
    """
    book = rules.where("active").select("rule_id", "category", "severity", "pattern", "languages", "ignore_case")
    if suppressed is not None:
        book = book.join(suppressed.select("rule_id"), "rule_id", "left_anti")
    spoken = F.array_contains("languages", F.lit("*")) | F.array_contains("languages", F.col("lang"))
    hits = matching(lines.select("repo", "path", "line", "text", "lang"), F.col("text"), book, spoken)
    return hits.select("repo", "path", "line", "rule_id", "category", "severity", strip(F.col("text")).alias("content"))


def bug_findings(
    lines: DataFrame, rules: Sequence[Rule] = RULES, suppressed: Iterable[str] = ()
) -> DataFrame:
    """Findings of active rules on lines(repo, path, line, text, lang); one row per rule and line."""
    chosen = active_rules(rules, suppressed)
    if len(chosen) > INLINE_RULES:
        return findings_by_table(lines, rule_table(lines.sparkSession, chosen))
    return (
        lines.withColumn("_hit", F.explode(rule_hits(F.col("text"), F.col("lang"), chosen)))
        .select("repo", "path", "line", "_hit.rule_id", "_hit.category", "_hit.severity",
                strip(F.col("text")).alias("content"))
    )


def diff_lines(diffs: DataFrame) -> DataFrame:
    """Added lines of unified diffs(diff_id, lang, content) with the file they belong to.

    A text is cut before its file headers; each part carries its path and the number of lines before it, so no line leaves its
    row's task.
    """
    header = r"(?<![^\n])\+\+\+[^\S\n]+(?:b/)?([^\n]+)"
    parts = F.split("content", r"(?=(?<![^\n])\+\+\+[^\S\n])")
    said = F.array().cast("array<struct<path:string,before:int,body:string>>")

    def step(acc: Column, part: Column) -> Column:
        named = F.regexp_extract(part, "^" + header, 1)
        path = F.when(named != "", named).otherwise(acc["path"])
        return F.struct(
            path.alias("path"), (acc["n"] + F.length(part) - F.length(F.replace(part, F.lit("\n"), F.lit("")))).alias("n"),
            F.concat(acc["out"], F.array(F.struct(path.alias("path"), acc["n"].alias("before"), part.alias("body")))).alias("out"))

    start = F.struct(F.lit("").alias("path"), F.lit(0).alias("n"), said.alias("out"))
    rows = diffs.select("diff_id", "lang", F.explode(F.aggregate(parts, start, step)["out"]).alias("_p"))
    lines = rows.select("diff_id", "lang", "_p.path", "_p.before", F.posexplode(F.split("_p.body", "\n")).alias("_pos", "raw"))
    return (
        lines.where(F.col("raw").startswith("+") & ~F.col("raw").startswith("+++"))
        .select(F.col("diff_id").alias("repo"), "path", (F.col("before") + F.col("_pos") + 1).alias("line"), "lang",
                strip(F.substring("raw", 2, 2147483647)).alias("text"))
        .where(F.col("text") != "")
    )


def bug_findings_diff(diffs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    return bug_findings(diff_lines(diffs), rules)


def finding_rollup(findings: DataFrame) -> DataFrame:
    """Counts by severity, category, rule and file of a repo in one pass: (dim, repo, key, n)."""
    dims = ["severity", "category", "rule_id", "path"]
    sets = [[d] if d != "path" else ["repo", "path"] for d in dims]
    grouped = findings.groupingSets(sets, *dims, "repo").agg(
        F.count(F.lit(1)).alias("n"), *(F.grouping(d).alias(f"_{d}") for d in dims))
    dim, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in dims:
        dim = F.when(F.col(f"_{d}") == 0, d).otherwise(dim)
        key = F.when(F.col(f"_{d}") == 0, F.col(d)).otherwise(key)
    return grouped.select(dim.alias("dim"), "repo", key.alias("key"), "n")


def finding_stats(findings: DataFrame) -> DataFrame:
    """Totals: findings, distinct files, and those critical or high."""
    return findings.agg(
        F.count(F.lit(1)).alias("total_findings"),
        F.countDistinct("repo", "path").alias("files"),
        F.count_if(F.col("severity").isin("critical", "high")).alias("unresolved"),
    )


def with_category(findings: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Category of a stored finding by rule id, ``unknown`` when the rule is gone."""
    from ..functions.arrays import lookup

    table = {r.rule_id: r.category for r in rules}
    return findings.withColumn("category", lookup(table, F.col("rule_id"), "unknown"))


def select_findings(
    findings: DataFrame, severity: str | None = None, category: str | None = None, limit: int | None = None
) -> DataFrame:
    """Stored findings, newest first, by severity and category."""
    if severity:
        findings = findings.where(F.col("severity") == severity)
    if category:
        findings = findings.where(F.col("category") == category)
    if limit:
        ordered = [F.col("ts").desc(), "repo", "path", "line"]
        return findings.orderBy(*ordered).limit(limit)
    return findings
