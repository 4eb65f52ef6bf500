"""Coverage: percentages, merging across tools, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.maths import pct

KINDS = ("statements", "branches", "functions", "lines")


def coverage_files(cov: DataFrame) -> DataFrame:
    """Rounded percentages per report row; an empty total counts as 100."""
    return cov.select(
        *[c for c in ("repo", "tool", "path") if c in cov.columns],
        *[pct(F.col(f"covered_{k}"), F.col(f"total_{k}"), 0, 100.0).alias(f"{k}_pct") for k in KINDS], "uncovered_lines")


def coverage_totals(cov: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Summed counts and the overall line percentage; 0 when there is no line."""
    sums = cov.groupBy(*by).agg(*[
        F.sum(f"{s}_{k}").cast("bigint").alias(f"{s}_{k}") for k in KINDS for s in ("total", "covered")])
    return sums.withColumn("overall_percent", pct(F.col("covered_lines"), F.col("total_lines")))


def _run_events(lines: Column) -> Column:
    """(pos, d) of the runs of neighbouring lines: a run opens (1) at its first line and closes (-1) after its last."""
    def before(x: Column, i: Column) -> Column:
        return (i == 0) | (F.get(lines, i - 1) != x - 1)

    def after(x: Column, i: Column) -> Column:
        return (i == F.size(lines) - 1) | (F.get(lines, i + 1) != x + 1)

    def event(pos: Column, d: int) -> Column:
        return F.struct(pos.cast("int").alias("pos"), F.lit(d).alias("d"))

    runs = F.concat(F.transform(F.filter(lines, before), lambda x: event(x, 1)), F.transform(F.filter(lines, after), lambda x: event(x + 1, -1)))
    # lines without a gap need no look at each of them
    first, last = F.get(lines, F.lit(0)), F.get(lines, F.size(lines) - 1)
    return F.when(last - first + 1 == F.size(lines), F.array(event(first, 1), event(last + 1, -1))).otherwise(runs)


def merge_coverage(cov: DataFrame, compat: bool = False) -> DataFrame:
    """One row per file of a repo over all tools.

    Default: largest raw counts, and a line is uncovered if every report of the file misses it. ``compat``: largest rounded
    percentages and the union of uncovered lines. A report's counts go to one aggregate per file; its lines send two events
    per run, of which those of one place are summed in the tasks, and a running sum over a file's places is the number of
    reports that miss the lines from there on.
    """
    per = coverage_files(cov) if compat else cov
    stats = [f"{k}_pct" for k in KINDS] if compat else [f"{s}_{k}" for k in KINDS for s in ("total", "covered")]
    # in structs nulls are equal, so the join keeps a file without a repo or path
    key = ["_repo", "_path"]
    named = per.withColumns({"_repo": F.struct("repo"), "_path": F.struct("path")})
    counts = named.groupBy(*key).agg(F.count(F.lit(1)).alias("_reports"), *(F.max(c).alias(c) for c in stats))
    clean = F.sort_array(F.array_distinct(F.filter(F.coalesce("uncovered_lines", F.array()), lambda x: x.isNotNull())))
    events = named.select(*key, clean.alias("_lines")).select(*key, F.explode(_run_events(F.col("_lines"))).alias("_e"))
    summed = events.groupBy(*key, F.col("_e.pos").alias("_pos")).agg(F.sum("_e.d").alias("_d"))
    sweep = W.partitionBy(*key).orderBy("_pos")
    swept = summed.select(*key, "_pos", F.sum("_d").over(sweep).alias("_depth"), F.lead("_pos").over(sweep).alias("_next"))
    runs = swept.where("_depth > 0").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_pos", "_next", "_depth"))).alias("_runs"))
    files = counts.join(runs, key, "left")
    missed = F.coalesce("_runs", F.array())
    if not compat:
        missed = F.filter(missed, lambda r: r["_depth"] == F.col("_reports"))
    files = files.withColumn("uncovered_lines", F.flatten(F.transform(missed, lambda r: F.sequence(r["_pos"], r["_next"] - 1)))).withColumns(
        {"repo": F.col("_repo.repo"), "path": F.col("_path.path")})
    shares = stats if compat else [pct(F.col(f"covered_{k}"), F.col(f"total_{k}"), 0, 100.0).alias(f"{k}_pct") for k in KINDS]
    return files.select("repo", "path", *shares, "uncovered_lines")


def merged_shares(cov: DataFrame) -> DataFrame:
    """The percentages of ``merge_coverage`` without the lines: one aggregate."""
    stats = [f"{s}_{k}" for k in KINDS for s in ("total", "covered")]
    files = cov.groupBy("repo", "path").agg(*(F.max(c).alias(c) for c in stats))
    return files.select("repo", "path", *[pct(F.col(f"covered_{k}"), F.col(f"total_{k}"), 0, 100.0).alias(f"{k}_pct") for k in KINDS])


def coverage_failures(files: DataFrame, threshold: float) -> DataFrame:
    """Files whose line percentage is below the threshold; the check passes when there is none."""
    return files.where(F.col("lines_pct") < threshold).select(
        *[c for c in ("repo", "path") if c in files.columns], F.col("lines_pct").alias("percent"), F.lit(float(threshold)).alias("threshold"))
