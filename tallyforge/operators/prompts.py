"""Prompts, tasks and commands: intents, complexity, risk, token cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import present
from ..functions.rx import ascii_bounds
from ..functions.text import squeeze
from ..rules import prompts as R

# Characters per token and price per token.
CHARS_PER_TOKEN = 4
COST_PER_TOKEN = 0.000003


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def _bounded(pattern: str) -> str:
    return ascii_bounds(rf"\b(?:{pattern})\b")


def _risk(low: Column) -> Column:
    level = F.lit("low")
    for _, sev, p in reversed(R.RISKS):
        level = F.when(low.rlike(p), sev).otherwise(level)
    return level


def _language(low: Column) -> Column:
    code, pattern = R.SECOND_LANGUAGE
    return F.when(low.rlike(pattern), code).otherwise("en")


def prompt_intents(df: DataFrame, text: str = "text", rules: Sequence[tuple[str, str]] = R.INTENTS) -> DataFrame:
    """Adds intents (comma list in rule order), the primary one, words, complexity, language and risk.

    A prompt with no intent that calls for a skill counts as ``implement`` if it has code words.
    """
    low = F.lower(squeeze(F.col(text)))
    base = df.withColumn("_low", low).withColumn("words", word_count(F.col(text)))
    t = F.col("_low")
    hits = present([F.when(t.rlike(_bounded(p)), F.lit(name)) for name, p in rules])
    idle = ~F.exists("_hits", lambda h: ~h.isin(*R.NO_SKILL)) & t.rlike(_bounded(R.CODE_WORDS))
    n = F.col("words")
    return base.withColumn("_hits", hits).withColumn("_hits", F.when(idle, F.array_append("_hits", F.lit("implement"))).otherwise(F.col("_hits"))).withColumns({
        "intents": F.array_join("_hits", ","), "primary_intent": F.coalesce(F.get("_hits", F.lit(0)), F.lit("unknown")),
        "complexity": F.when(n > R.COMPLEX_WORDS, "complex").when(n > R.STANDARD_WORDS, "standard").otherwise("simple"),
        "language": _language(t), "risk": _risk(t),
    }).drop("_low", "_hits")


def context_intents(df: DataFrame, text: str = "text", rules: Sequence[tuple[str, str, str]] = R.CONTEXT_SKILLS) -> DataFrame:
    """Adds skills and intents (comma lists in rule order, one entry per rule), the primary intent, words, complexity by
    words and length, language and risk. The last rule counts only if no other does; without any the skill is ``none``."""
    base = df.withColumns({"_low": F.lower(squeeze(F.col(text))), "words": word_count(F.col(text))})
    t, n = F.col("_low"), F.col("words")

    def found(skill: str, intent: str, pattern: str) -> Column:
        return F.when(t.rlike(_bounded(pattern)), F.struct(F.lit(skill).alias("skill"), F.lit(intent).alias("intent")))

    first, last = present([found(*r) for r in rules[:-1]]), present([found(*rules[-1])])
    base = base.withColumn("_hits", first).withColumn("_hits", F.when(F.size("_hits") > 0, F.col("_hits")).otherwise(last))
    large, ordinary = t.rlike(_bounded(R.LARGE_WORDS)), t.rlike(_bounded(R.ORDINARY_WORDS)) & (n > R.ORDINARY_LENGTH)
    some = F.size("_hits") > 0
    return base.withColumns({
        "skills": F.when(some, F.array_join("_hits.skill", ",")).otherwise("none"),
        "intents": F.when(some, F.array_join("_hits.intent", ",")).otherwise("unknown"),
        "primary_intent": F.coalesce(F.get("_hits.intent", F.lit(0)), F.lit("unknown")),
        "complexity": F.when(n > R.COMPLEX_WORDS, "complex").when(ordinary, "standard").when(large, "complex")
        .when(n > R.STANDARD_WORDS, "standard").otherwise("simple"),
        "language": _language(t), "risk": _risk(t),
    }).drop("_low", "_hits")


def task_complexity(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds a 0..8 score from length, file mentions and keywords, and its level."""
    t = F.col(text)
    n = word_count(t)
    files = F.regexp_count(t, F.lit(R.FILE_MENTION))
    score = (
        F.when(n > 80, 3).when(n > 40, 2).when(n > 20, 1).otherwise(0)
        + F.when(files >= 5, 3).when(files >= 3, 2).when(files >= 1, 1).otherwise(0)
        + F.when(t.rlike(R.COMPLEX_TASK), 2).otherwise(0) - F.when(t.rlike(R.SIMPLE_TASK), 2).otherwise(0))
    return df.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(8), score))).withColumn(
        "level", F.when(F.col("score") >= 5, "COMPLEX").when(F.col("score") >= 3, "MODERATE").otherwise("SIMPLE"))


def risky_commands(cmds: DataFrame) -> DataFrame:
    """Adds rule and decision (deny, warn, allow) for cmds(command, path, ignored).

    Recursive rm of a root target and a forced push to main/master are denied; another forced
    push and a write to an env file that is not ignored are warned about.
    """
    c = F.coalesce("command", F.lit(""))
    words = F.split(squeeze(c), " ")
    rm = c.rlike(ascii_bounds(r"\brm\b")) & c.rlike(r"\s-[a-zA-Z]*[rR]") & F.arrays_overlap(
        words, F.array(*[F.lit(x) for x in R.ROOT_TARGETS]))
    push = c.rlike(r"git\s+push") & ~c.contains("force-with-lease") & c.rlike(ascii_bounds(r"--force\b|-f\b"))
    main = c.rlike(ascii_bounds(r"\b(?:main|master)\b"))
    env = F.coalesce(F.regexp_extract("path", r"([^/]*)$", 1).startswith(".env"), F.lit(False)) & ~F.coalesce("ignored", F.lit(False))
    rule = F.when(rm, "rm_root").when(push & main, "force_push_main").when(push, "force_push").when(env, "env_write").otherwise("none")
    return cmds.withColumn("rule", rule).withColumn(
        "decision", F.when(F.col("rule").isin("rm_root", "force_push_main"), "deny")
        .when(F.col("rule") == "none", "allow").otherwise("warn"))


def token_cost(logs: DataFrame, now: Column, days: int = 30, by: tuple[str, ...] = ()) -> DataFrame:
    """Sessions, estimated tokens and cost of logs(session, ts, text) of the last days."""
    rows = logs.where(F.col("ts") >= now - F.make_dt_interval(F.lit(days)))
    tokens = F.floor(F.sum(F.length("text")) / F.lit(float(CHARS_PER_TOKEN)) + 0.5)
    return rows.groupBy(*by).agg(
        F.countDistinct("session").alias("sessions"), F.coalesce(tokens, F.lit(0)).cast("bigint").alias("tokens"),
    ).withColumn("cost", F.format_string("$%.6f", F.col("tokens") * F.lit(COST_PER_TOKEN)))


def cache_hits(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
