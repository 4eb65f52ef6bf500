"""Quality snapshots: scores, regressions, trends, gates; history deltas of code statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.maths import half_up
from .history import lookback, with_history

# Weights of the quality score.
WEIGHTS = {"typecheck": 0.25, "lint": 0.15, "test": 0.3, "coverage": 0.15, "debt": 0.1, "consistency": 0.05}

# Metrics, and whether a rise is bad (+1) or a fall is (-1).
METRICS = {
    "typecheck_errors": 1, "lint_warnings": 1, "test_pass_rate": -1, "test_coverage": -1, "debt_items": 1,
    "consistency_score": -1,
}


def quality_score() -> Column:
    """Weighted score of a snapshot row; a missing coverage counts as 0."""
    zero = F.lit(0.0)
    return half_up(
        F.greatest(zero, F.lit(100.0) - F.col("typecheck_errors") * 10) * WEIGHTS["typecheck"]
        + F.greatest(zero, F.lit(100.0) - F.col("lint_warnings") * 2) * WEIGHTS["lint"]
        + F.col("test_pass_rate") * 100 * WEIGHTS["test"]
        + F.coalesce("test_coverage", zero) * WEIGHTS["coverage"]
        + F.greatest(zero, F.lit(100.0) - F.col("debt_items") * 5) * WEIGHTS["debt"]
        + F.col("consistency_score") * WEIGHTS["consistency"]).cast("bigint")


def with_previous(snap: DataFrame) -> DataFrame:
    """Each snapshot with its predecessor in ``prev`` (null for the first of a module).

    Monthly buckets with one carried row keep a module with most snapshots distributed.
    """
    cols = snap.columns
    placed = snap.withColumn("_bucket", F.year("ts") * 12 + F.month("ts"))
    order = ["ts", "seq"]
    frame = lookback(["module"], "_bucket", order)
    return (
        with_history(placed, ["module"], "_bucket", order, 1)
        .withColumn("prev", F.lag(F.struct(*cols)).over(frame))
        .where(~F.col("carried"))
        .select(*cols, "prev")
    )


def quality_regressions(snap: DataFrame) -> DataFrame:
    """Long form: (module, ts, seq, metric, before, after, change, regression) per step."""
    pairs = with_previous(snap).where(F.col("prev").isNotNull())
    rows = F.array(*[
        F.struct(
            F.lit(m).alias("metric"), F.coalesce(F.col(f"prev.{m}").cast("double"), F.lit(0.0)).alias("before"),
            F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias("after"), F.lit(d).alias("dir"))
        for m, d in METRICS.items()])
    change = F.col("after") - F.col("before")
    return (
        pairs.select("module", "ts", "seq", F.explode(rows).alias("_r"))
        .select("module", "ts", "seq", "_r.metric", "_r.before", "_r.after", "_r.dir")
        .select("module", "ts", "seq", "metric", "before", "after", change.alias("change"),
                (change * F.col("dir") > 0).alias("regression"))
    )


def quality_verdicts(snap: DataFrame) -> DataFrame:
    """Per step: number of regressed metrics, scores of both snapshots and the verdict."""
    pairs = with_previous(snap.withColumn("score", quality_score())).where(F.col("prev").isNotNull())
    worse = F.lit(0)
    for m, d in METRICS.items():
        change = F.coalesce(F.col(m).cast("double"), F.lit(0.0)) - F.coalesce(F.col(f"prev.{m}").cast("double"), F.lit(0.0))
        worse = worse + F.when(change * d > 0, 1).otherwise(0)
    return pairs.select("module", "seq", worse.alias("regressed"), F.col("prev.score").alias("score_before"), "score").withColumn(
        "verdict", F.when(F.col("regressed") > 0, "FAIL").when(F.col("score") >= F.col("score_before"), "PASS_STABLE").otherwise("PASS"))


def latest_per_module(snap: DataFrame) -> DataFrame:
    """Newest snapshot per module, merged on the map side."""
    cols = [c for c in snap.columns if c != "module"]
    return snap.groupBy("module").agg(F.max_by(F.struct(*cols), F.struct("ts", "seq")).alias("_s")).select("module", "_s.*")


def quality_trend(snap: DataFrame, now: Column, days: int = 30, module: str | None = None) -> DataFrame:
    rows = snap.where(F.col("ts") >= now - F.make_dt_interval(F.lit(days)))
    return rows.where(F.col("module") == module).orderBy("ts", "seq") if module else rows


def quality_gate(snap: DataFrame, threshold: int = 70) -> DataFrame:
    """Failed gate rules per snapshot and whether it passed."""
    rules = {
        "typecheck": F.col("typecheck_errors") > 0, "pass_rate": F.col("test_pass_rate") < 0.9,
        "coverage": F.coalesce(F.col("test_coverage") < 50, F.lit(False)), "score": quality_score() < threshold}
    failed = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return snap.select("module", "seq", quality_score().alias("score"), F.array_join(failed, ",").alias("failures"),
                       (F.size(failed) == 0).alias("passed"))


def gate_score(checks: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """Share of passed checks in percent and whether all passed."""
    return checks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("checks"), half_up(F.avg(F.col("passed").cast("int")) * 100).cast("bigint").alias("score"),
        F.every("passed").alias("all_pass"))


def quality_snapshot(
    typecheck: DataFrame, lint: DataFrame, tests: DataFrame, coverage: DataFrame, debt: DataFrame, features: DataFrame
) -> DataFrame:
    """Snapshot per module from six result tables; each is aggregated before the joins.

    typecheck/lint/debt: one row per finding (module). tests(module, passed). coverage(module,
    covered, total). features(module, exported, typed, documented).
    """
    parts = [
        typecheck.groupBy("module").agg(F.count(F.lit(1)).alias("typecheck_errors")),
        lint.groupBy("module").agg(F.count(F.lit(1)).alias("lint_warnings")),
        tests.groupBy("module").agg(F.avg(F.col("passed").cast("int")).alias("test_pass_rate")),
        coverage.groupBy("module").agg(F.sum("covered").alias("_c"), F.sum("total").alias("_t")).select(
            "module", F.when(F.col("_t") > 0, half_up(F.col("_c") / F.col("_t") * 100, 2)).alias("test_coverage")),
        debt.groupBy("module").agg(F.count(F.lit(1)).alias("debt_items")),
        features.groupBy("module").agg(half_up(
            F.avg(F.col("exported").cast("int")) * 40 + F.avg(F.col("typed").cast("int")) * 35
            + F.avg(F.col("documented").cast("int")) * 25).cast("bigint").alias("consistency_score")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "module", "full_outer")
    zero = F.lit(0)
    return out.select(
        "module", F.coalesce("typecheck_errors", zero).alias("typecheck_errors"), F.coalesce("lint_warnings", zero).alias("lint_warnings"),
        F.coalesce("test_pass_rate", F.lit(1.0)).alias("test_pass_rate"), "test_coverage",
        F.coalesce("debt_items", zero).alias("debt_items"), F.coalesce("consistency_score", F.lit(50)).alias("consistency_score"))


def stats_trend(history: DataFrame) -> DataFrame:
    """Step deltas of files, lines and dependencies per module."""
    cols = ("files", "lines", "deps")
    return with_previous(history).select(
        "module", "seq", *cols, *[(F.col(c) - F.col(f"prev.{c}")).alias(f"{c}_step") for c in cols])


def stats_overall(history: DataFrame) -> DataFrame:
    """Latest minus first snapshot per module."""
    key = F.struct("ts", "seq")
    cols = ("files", "lines", "deps")
    return history.groupBy("module").agg(*[
        (F.max_by(c, key) - F.min_by(c, key)).alias(f"{c}_change") for c in cols], F.count(F.lit(1)).alias("snapshots"))
