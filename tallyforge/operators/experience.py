"""Failure and experience logs: filters, insights, suggestions, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.maths import half_up
from ..functions.text import escaped_symptom, failure_key, pattern_name
from .contain import matching
from .history import first_rows

# Advice by words of the error key, first match wins.
ADVICE = (
    ("timeout", ("timeout",), "raise the timeout or split the operation"),
    ("path", ("not found", "enoent"), "check that the path exists first"),
    ("rate_limit", ("rate limit", "429"), "back off exponentially before retrying"),
    ("permission", ("permission", "denied"), "grant the permission or use another tool"),
    ("parse", ("parse", "syntax"), "validate the input before parsing"),
)
ADVICE_OTHER = ("investigate", "look into the recurring error")

# Fixed value: group size.
MIN_GROUP = 2


def select_failures(df: DataFrame, type: str | None = None, unresolved: bool = False, limit: int | None = None) -> DataFrame:
    if type:
        df = df.where(F.col("type") == type)
    if unresolved:
        df = df.where(~F.col("resolved"))
    return df.orderBy(F.col("ts").desc(), "id").limit(limit) if limit else df


def unprocessed(df: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """Rows without a processed stamp and, if given, absent from the processed-id table."""
    rows = df.where(F.col("processed_at").isNull())
    return rows if processed is None else rows.join(processed.select("id"), "id", "left_anti")


def recent(df: DataFrame, task_type: str | None = None, n: int = 10) -> DataFrame:
    if task_type:
        df = df.where(F.lower("task_type") == task_type.lower())
    return df.orderBy(F.col("ts").desc(), "id").limit(n)


def query_decisions(df: DataFrame, text: str | None = None) -> DataFrame:
    if not text:
        return df
    needle = F.lit(text.lower())
    hit = F.exists("options", lambda o: F.contains(F.lower(o), needle))
    for c in ("context", "selected", "rationale"):
        hit = hit | F.contains(F.lower(c), needle)
    return df.where(hit)


def pattern_insights(experiences: DataFrame) -> DataFrame:
    """Frequency and success rate (partial counts one half) per normalised pattern."""
    share = F.when(F.col("outcome") == "success", 1.0).when(F.col("outcome") == "partial", 0.5).otherwise(0.0)
    return (
        experiences.select(share.alias("_s"), F.explode("patterns").alias("_p"))
        .select("_s", F.lower(F.trim("_p")).alias("pattern")).where(F.col("pattern") != "")
        .groupBy("pattern")
        .agg(F.count(F.lit(1)).alias("frequency"), half_up(F.sum("_s") / F.count(F.lit(1)), 2).alias("success_rate"))
    )


def experience_stats(experiences: DataFrame, decisions: DataFrame) -> DataFrame:
    """Entries by outcome (all three kept), the five most frequent patterns and the ten latest
    decisions: (dim, key, n)."""
    outcomes = experiences.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("success", "failure", "partial")])
    rows = outcomes.unpivot([], ["success", "failure", "partial"], "key", "n").select(F.lit("outcome").alias("dim"), "key", "n")
    top = pattern_insights(experiences).orderBy(F.col("frequency").desc(), "pattern").limit(5).select(
        F.lit("pattern").alias("dim"), F.col("pattern").alias("key"), F.col("frequency").alias("n"))
    last = decisions.orderBy(F.col("ts").desc(), "id").limit(10).select(
        F.lit("decision").alias("dim"), F.col("id").cast("string").alias("key"), F.unix_seconds("ts").alias("n"))
    return rows.unionByName(top).unionByName(last)


def advice(key: Column) -> Column:
    """struct(kind, fix) for an error key."""
    low = F.lower(key)
    out = F.struct(F.lit(ADVICE_OTHER[0]).alias("kind"), F.lit(ADVICE_OTHER[1]).alias("fix"))
    for kind, words, fix in reversed(ADVICE):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, F.struct(F.lit(kind).alias("kind"), F.lit(fix).alias("fix"))).otherwise(out)
    return out


def failure_suggestions(failures: DataFrame, since: Column | None = None) -> DataFrame:
    """Recurring error keys among the unprocessed failures (from ``since`` on, if given) with name, symptom and advice.

    The symptom is that of the latest failure, of equal times the least id as text.
    """
    rows = unprocessed(failures)
    rows = rows if since is None else rows.where(F.col("ts") >= since)
    latest = F.min(F.struct((-F.unix_micros("ts")).alias("age"), F.col("id").cast("string").alias("id"), "error"))["error"]
    groups = (
        rows.where(F.col("error").isNotNull() & (F.col("error") != ""))
        .groupBy(failure_key(F.col("error")).alias("error_key"))
        .agg(F.count(F.lit(1)).alias("n"), latest.alias("_e"),
             F.array_join(F.array_sort(F.collect_set("tool")), ", ").alias("tools"))
        .where(F.col("n") >= MIN_GROUP)
    )
    name = pattern_name(F.col("error_key"))
    return groups.withColumn("_a", advice(F.col("error_key"))).select(
        "error_key", "n", F.when(name == "", F.concat(F.lit("recurring_error_"), F.col("n").cast("string"))).otherwise(name).alias("pattern"),
        escaped_symptom(F.col("_e")).alias("symptom"), "tools", "_a.kind", "_a.fix")


def learn_report(failures: DataFrame, corrections: DataFrame) -> DataFrame:
    c = corrections.agg(F.count_if(F.col("source") == "learn").alias("w"), F.count(F.lit(1)).alias("a"))
    return failures.agg(
        F.count(F.lit(1)).alias("total_failures"), F.count_if(~F.col("resolved")).alias("unresolved_failures"),
    ).withColumn("corrections_written", c.select("w").scalar()).withColumn("active_patterns", c.select("a").scalar())


def match_corrections(errors: DataFrame, corrections: DataFrame) -> DataFrame:
    """First correction (local before global, then by seq) whose symptom matches each error.

    Distinct error texts meet the corrections that share a literal with them; the least in rank is kept by a mergeable
    minimum. Unusable patterns are skipped.
    """
    rank = F.struct(F.when(F.col("scope") == "local", 0).otherwise(1).alias("r"), "seq", F.col("id").cast("string").alias("id"))
    book = corrections.select(
        F.col("id").cast("string").alias("rule_id"), F.col("symptom").alias("pattern"), F.lit(True).alias("ignore_case"), rank.alias("_rank"))
    texts = errors.select("error").where(F.col("error").isNotNull()).distinct()
    first = matching(texts, F.col("error"), book).groupBy("error").agg(F.min("_rank")["id"].alias("correction_id"))
    return errors.join(first, "error", "left")


def upsert_corrections(store: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Known patterns take the suggested fix, unknown ones are added."""
    s = first_rows(suggestions, ["pattern"], [F.col("n").desc(), F.col("error_key")]).select(
        "pattern", F.col("symptom").alias("_s"), F.col("fix").alias("_f"))
    return store.join(s, "pattern", "full_outer").select(
        "pattern", F.coalesce("symptom", "_s").alias("symptom"), F.coalesce("_f", "fix").alias("fix"),
        F.coalesce("applied_count", F.lit(0)).alias("applied_count"))


def failure_rows(rows: DataFrame) -> DataFrame:
    """Experience rows recorded for failures(task_type, error, context, ts)."""
    return rows.select(
        F.concat(F.lit("exp-"), F.left(F.sha2(F.concat_ws("|", "task_type", "error", F.col("ts").cast("string")), 256), F.lit(16))).alias("id"),
        "ts", "task_type", F.col("context").alias("task_desc"), F.lit("failure").alias("outcome"),
        F.col("error").alias("root_cause"),
        F.array(F.concat(F.lit("Failure in "), "task_type", F.lit(": "), "error")).alias("lessons"),
        F.array("task_type", F.lit("failure")).alias("tags"))


def decision_rows(completions: DataFrame) -> DataFrame:
    """Decision rows carried by completions(id, decisions array)."""
    return completions.select(F.col("id").alias("experience_id"), F.explode("decisions").alias("_d")).select(
        "experience_id", "_d.*")
