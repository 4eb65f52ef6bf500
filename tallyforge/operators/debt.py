"""Debt comments: extraction, classification, roll-ups, scores, budgets, ageing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates
from ..functions.maths import half_up
from ..functions.rx import ascii_bounds
from ..functions.text import clean_comment
from ..rules import debt as R
from ..sources.files import module_of
from .history import distinct_first

_MARKERS = {
    "todo": r"//|#|<!--|\{/\*|/\*|\*",
    "debt": r"//|#|<!--?|/\*+|\*",
}
_TAGS = {"todo": R.TODO_TAGS, "debt": R.DEBT_TAGS, "inline": R.INLINE_TAGS}


def comment_pattern(dialect: str, compat: bool = False) -> str:
    """Regex with the tag and the message as captures 1 and 2.

    todo/debt: comment opens the line, leading blanks allowed; ``compat`` wants it in column 0.
    inline: ``//`` anywhere in the line.
    """
    tags = "|".join(_TAGS[dialect])
    if dialect == "inline":
        return ascii_bounds(rf"(?i)//\s*({tags})\b\s*:?\s*(.*?)$")
    lead = "" if compat else r"\s*"
    return ascii_bounds(
        rf"(?i)^{lead}(?:{_MARKERS[dialect]})\s*({tags})\b\s*:?\s*(.*?)(?:\*/|-->)?\s*$"
    )


def comment_items(lines: DataFrame, dialect: str = "todo", compat: bool = False) -> DataFrame:
    """Tagged comments of lines(repo, path, line, text, ...): adds tag and message.

    The literal tests run first, so most lines never reach the regex.
    """
    text = F.col("text")
    pattern = comment_pattern(dialect, compat)
    if dialect == "inline":
        marked = text.contains("//")
    else:
        marked = text.contains("//") | text.contains("#") | text.contains("<!-")
        marked = marked | (text.contains("/*") if compat else text.contains("*"))
    tag = F.upper(F.regexp_extract(text, pattern, 1))
    body = F.regexp_extract(text, pattern, 2)
    keep = [c for c in lines.columns if c != "text"]
    found = lines.where(marked & text.rlike(pattern)).select(*keep, tag.alias("tag"), body.alias("_body"))
    said = F.when(F.col("_body") == "", F.col("tag")).otherwise(F.col("_body"))
    message = F.trim(said) if dialect == "inline" else clean_comment(said)
    return found.select(*keep, "tag", message.alias("message"))


def items_since(items: DataFrame, changed: DataFrame) -> DataFrame:
    """Items of changed files only."""
    return items.join(changed.select("repo", "path"), ["repo", "path"], "left_semi")


def _points(text: Column, patterns: tuple[str, ...], each: int) -> Column:
    total = F.lit(0)
    for p in patterns:
        total = total + F.when(text.rlike("(?i)" + ascii_bounds(p)), each).otherwise(0)
    return total


def _best(scores: dict[str, Column]) -> Column:
    """struct(score, rank, label) of the highest score; the earlier label wins a tie."""
    ranked = [
        F.struct(s.alias("score"), F.lit(-i).alias("rank"), F.lit(name).alias("label"))
        for i, (name, s) in enumerate(scores.items())
    ]
    return F.array_max(F.array(*ranked))


def classify_debt(text: Column) -> Column:
    """struct(type, severity) of a debt text by keyword scores and tag defaults."""
    lead = F.upper(
        F.regexp_extract(text, ascii_bounds(r"(?i)^(TODO|FIXME|HACK|XXX|SECURITY|PERF|OPTIMIZE|REVIEW)\b"), 1)
    )
    types = {}
    for name, patterns in R.TYPE_PATTERNS.items():
        tags = [tag for tag, kind in R.PREFIX_TYPES.items() if kind == name]
        bonus = F.when(lead.isin(*tags), 3).otherwise(0) if tags else F.lit(0)
        types[name] = _points(text, patterns, 2) + bonus
    top_type = _best(types)
    top_sev = _best({s: _points(text, p, 1) for s, p in R.SEVERITY_PATTERNS.items()})

    kind, level = F.lit("refactor"), F.when(top_sev["score"] > 0, top_sev["label"]).otherwise("minor")
    upper = F.upper(text)
    for prefixes, t, s in reversed(R.PREFIX_DEFAULTS):
        starts = upper.rlike("^(?:" + "|".join(prefixes) + ")")
        kind = F.when(starts, t).otherwise(kind)
        level = F.when(starts, s).otherwise(level)
    scored = top_type["score"] > 0
    return F.struct(
        F.when(scored, top_type["label"]).otherwise(kind).alias("type"),
        F.when(scored, F.when(top_sev["score"] > 0, top_sev["label"]).otherwise("minor"))
        .otherwise(level).alias("severity"),
    )


def with_class(items: DataFrame) -> DataFrame:
    """Adds type and severity from the message."""
    return items.withColumn("_c", classify_debt(F.col("message"))).select(
        *items.columns, F.col("_c.type").alias("type"), F.col("_c.severity").alias("severity")
    )


def enrich_blame(items: DataFrame, blame: DataFrame, now: Column) -> DataFrame:
    """Adds author, last_changed and age_days per (repo, path, line); null without blame."""
    return items.join(
        blame.select("repo", "path", "line", "author", "last_changed"), ["repo", "path", "line"], "left"
    ).withColumn("age_days", dates.age_days(F.col("last_changed"), now))


def todo_rollup(items: DataFrame) -> DataFrame:
    """Counts by tag, file of a repo and author in one pass: (dim, repo, key, n); missing authors are ``unknown``."""
    named = items.select("tag", "repo", "path", F.coalesce("author", F.lit("unknown")).alias("author"))
    grouped = named.groupingSets([["tag"], ["repo", "path"], ["author"]], "tag", "repo", "path", "author").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("tag").alias("_t"), F.grouping("path").alias("_p"))
    is_tag, is_path = F.col("_t") == 0, F.col("_p") == 0
    return grouped.select(
        F.when(is_tag, "tag").when(is_path, "path").otherwise("author").alias("dim"), "repo",
        F.when(is_tag, F.col("tag")).when(is_path, F.col("path")).otherwise(F.col("author")).alias("key"), "n")


def todo_summary(items: DataFrame) -> DataFrame:
    """Total items and mean age (half-up whole days over items with an age)."""
    return items.agg(
        F.count(F.lit(1)).alias("total_items"),
        F.coalesce(half_up(F.sum("age_days") / F.count("age_days")), F.lit(0.0)).cast("bigint").alias("average_age"),
    )


def oldest(items: DataFrame, k: int = 10) -> DataFrame:
    return (
        items.where(F.col("age_days").isNotNull())
        .orderBy(F.col("age_days").desc(), "repo", "path", "line")
        .limit(k)
    )


def open_debts(items: DataFrame) -> DataFrame:
    return items.where(F.col("status") == "open")


def weight(severity: Column) -> Column:
    out = F.lit(1)
    for name, w in R.SEVERITY_WEIGHTS.items():
        out = F.when(severity == name, w).otherwise(out)
    return out


def debt_score(items: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Totals, open/resolved counts, weighted score and mean age of open items."""
    is_open = F.col("status") == "open"
    age = F.when(is_open, F.coalesce("age_days", F.lit(0)))
    return items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(is_open).alias("open"),
        F.count_if(F.col("status") == "resolved").alias("resolved"),
        F.coalesce(F.sum(F.when(is_open, weight(F.col("severity")))), F.lit(0)).cast("bigint").alias("score"),
        F.coalesce(half_up(F.sum(age) / F.count_if(is_open)), F.lit(0.0)).cast("bigint").alias("average_age"),
    )


def debt_breakdown(items: DataFrame) -> DataFrame:
    """Open items by severity, type and module of a repo: (dim, repo, key, n); every severity and type listed."""
    live = open_debts(items).select("severity", "type", "repo", module_of(F.col("path")).alias("module"))
    counts = live.groupingSets([["severity"], ["type"], ["repo", "module"]], "severity", "type", "repo", "module").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("severity").alias("_s"), F.grouping("type").alias("_t")
    ).select(
        F.when(F.col("_s") == 0, "severity").when(F.col("_t") == 0, "type").otherwise("module").alias("dim"), "repo",
        F.coalesce("severity", "type", "module").alias("key"),
        "n",
    )
    fixed = [("severity", s) for s in R.SEVERITY_WEIGHTS] + [("type", k) for k in R.TYPE_PATTERNS]
    zeros = items.sparkSession.createDataFrame(fixed, "dim string, key string").withColumns(
        {"repo": F.lit(None).cast("string"), "n": F.lit(0).cast("bigint")}
    )
    return counts.unionByName(zeros).groupBy("dim", "repo", "key").agg(F.sum("n").alias("n"))


def debt_budget(items: DataFrame, threshold: int = 100) -> DataFrame:
    return debt_score(items).select(
        (F.col("score") > threshold).alias("exceeded"),
        F.col("score").alias("current_score"),
        F.lit(threshold).cast("bigint").alias("threshold"),
        (F.lit(threshold) - F.col("score")).cast("bigint").alias("remaining"),
    )


def merge_debt(existing: DataFrame, scanned: DataFrame) -> DataFrame:
    """Existing rows plus scanned rows at places the store does not know; first scan row wins."""
    keys = ["repo", "path", "line"]
    order = [F.col(c) for c in ("tag", "message") if c in scanned.columns] or [F.lit(0)]
    fresh = distinct_first(scanned, keys, order).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def debt_band(items: DataFrame) -> DataFrame:
    """Ageing band, quadrant, cost ratio advice and escalation.

    Costs are caller columns ``fix_cost`` and ``leave_cost``. Important = critical or major;
    urgent = critical, or major in the last band.
    """
    band = F.lit(R.AGE_LAST)
    for days, name in reversed(R.AGE_BANDS):
        band = F.when(F.col("age_days") < days, name).otherwise(band)
    ratio = F.when(F.col("leave_cost") > 0, F.col("fix_cost") / F.col("leave_cost"))
    important = F.col("severity").isin("critical", "major")
    urgent = (F.col("severity") == "critical") | ((F.col("severity") == "major") & (F.col("band") == R.AGE_LAST))
    return (
        items.withColumn("band", band)
        .withColumn("ratio", ratio)
        .withColumn("advice", F.when(F.col("ratio") < 1, "defer").when(F.col("ratio") <= 2, "monitor")
                    .when(F.col("ratio") > 2, "fix"))
        .withColumn("quadrant", F.when(important & urgent, "fix_now").when(important, "schedule")
                    .when(urgent | (F.col("band") == R.AGE_LAST), "defer_with_deadline").otherwise("drop"))
        .withColumn("must_fix", (F.col("band") == R.AGE_LAST) | F.coalesce(F.col("ratio") > 2, F.lit(False)))
    )
