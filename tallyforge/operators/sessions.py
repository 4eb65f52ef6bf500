"""Session logs and thought sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.maths import half_up
from .history import lookback, with_history

# Events counted per session log.
COUNTED = {
    "tasks_created": "TASK+", "tasks_completed": "TASK done", "writes": "WRITE", "commits": "GIT COMMIT", "agents": "AGENT",
    "prompts": "PROMPT", "branch_switches": "BRANCH SWITCH",
}
SEQ_BUCKET = 1000


def counters() -> list[Column]:
    """Aggregates shared by the batch and the streaming metrics."""
    e = F.col("event")
    out = [F.count_if(e == name).alias(k) for k, name in COUNTED.items()]
    return [*out, F.count_if(e.contains("FAIL")).alias("failures")]


def with_rates(df: DataFrame) -> DataFrame:
    def rate(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, half_up(F.col(a) / F.col(b) * 100)).otherwise(0.0).cast("bigint")

    return df.withColumns({
        "completion_rate": rate("tasks_completed", "tasks_created"), "agent_utilization": rate("agents", "prompts")})


def session_metrics(log: DataFrame, by: tuple[str, ...] = ("session",)) -> DataFrame:
    """Counters, rates and first/last prompt clock of log(session, clock, event)."""
    prompt = F.when(F.col("event") == "PROMPT", F.col("clock"))
    return with_rates(log.groupBy(*by).agg(*counters(), F.min(prompt).alias("first_prompt"), F.max(prompt).alias("last_prompt")))


def thought_summary(thoughts: DataFrame) -> DataFrame:
    """Thoughts, revisions, branches, branched thoughts and completion per session."""
    branched = F.col("branch_from").isNotNull() & F.col("branch_id").isNotNull()
    return thoughts.groupBy("session").agg(
        F.count(F.lit(1)).alias("thoughts"), F.count_if("is_revision").alias("revisions"),
        F.countDistinct(F.when(branched, F.col("branch_id"))).alias("branches"), F.count_if(branched).alias("branch_thoughts"),
        (~F.max_by("next_needed", "seq")).alias("completed"))


def thought_edges(thoughts: DataFrame) -> DataFrame:
    """(session, kind, src, dst) edges: next, revision, branch and in-branch steps.

    Predecessors are found within (session, bucket of seq) with one carried row.
    """
    t = thoughts.withColumn("_bucket", F.floor(F.col("seq") / SEQ_BUCKET))
    node = lambda c: F.concat(F.lit("T"), F.col(c).cast("string"))
    main = t.where(F.col("branch_from").isNull())
    cols = ["session", "_bucket", "seq", "thought_number"]
    steps = main.where(~F.col("is_revision")).select(*cols)
    frame = lookback(["session"], "_bucket", ["seq"])
    following = (
        with_history(steps, ["session"], "_bucket", ["seq"], 1)
        .withColumn("_p", F.lag("thought_number").over(frame))
        .where(~F.col("carried") & F.col("_p").isNotNull())
        .select("session", F.lit("next").alias("kind"), F.concat(F.lit("T"), F.col("_p").cast("string")).alias("src"), node("thought_number").alias("dst")))
    revised = main.where(F.col("is_revision") & F.col("revises").isNotNull()).select(
        "session", F.lit("revision").alias("kind"), node("revises").alias("src"), node("thought_number").alias("dst"))
    side = t.where(F.col("branch_from").isNotNull() & F.col("branch_id").isNotNull()).select(*cols, "branch_id", "branch_from")
    name = F.concat(F.lit("B"), F.regexp_replace("branch_id", "[^a-zA-Z0-9]", ""))
    key = ["session", "branch_id"]
    placed = (
        with_history(side, key, "_bucket", ["seq"], 1)
        .withColumn("_p", F.lag("thought_number").over(lookback(key, "_bucket", ["seq"]))).where(~F.col("carried")))
    linked = F.col("_p") == F.col("thought_number") - 1
    inner = placed.select(
        "session", F.lit("step").alias("kind"),
        F.when(linked, F.concat(name, F.lit("_"), F.col("_p").cast("string"))).otherwise(name).alias("src"),
        F.concat(name, F.lit("_"), F.col("thought_number").cast("string")).alias("dst"))
    opened = placed.where(F.col("_p").isNull()).select(
        "session", F.lit("branch").alias("kind"), node("branch_from").alias("src"), name.alias("dst"))
    return following.unionByName(revised).unionByName(inner).unionByName(opened)
