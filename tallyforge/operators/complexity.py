"""Function discovery and cyclomatic complexity.

Brace matching needs a stack, so discovery runs as an Arrow-batched map over files; Spark
partitions the files, and everything after it is ordinary aggregation.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Function shapes and decision points.
FUNCTION = re.compile(r"(?:function\s+\w+|\w+\s*=\s*(?:async\s*)?\(|\w+\s*\([^)]*\)\s*\{)", re.A)
ARROW = re.compile(r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>\s*\{?", re.A)
NAMES = (
    re.compile(r"function\s+(\w+)", re.A), re.compile(r"(\w+)\s*=\s*(?:async\s*)?\(", re.A), re.compile(r"(\w+)\s*\(", re.A),
)
DECISIONS = tuple(
    re.compile(p, re.A | re.M)
    for p in (r"\bif\s*\(", r"\bfor\s*\(", r"\bwhile\s*\(", r"^\s*case\s+.*:", r"\bcatch\s*\(", r"&&|\|\|", r"\?"))

SOLID, STOP = re.compile(r"\S"), re.compile("[;,]")

FUNCTION_SCHEMA = "repo string, path string, name string, line int, complexity int, params int, n_lines int"


def _params(text: str) -> int:
    inner = re.search(r"\(([^)]*)\)", text)
    return len(inner.group(1).split(",")) if inner and inner.group(1).strip() else 0


def functions_of(code: str) -> list[tuple[str, int, int, int, int]]:
    """(name, line, complexity, params, n_lines) of one text; at most one function per line."""
    newlines = [m.start() for m in re.finditer("\n", code)]
    opens, partner, stack = [], {}, []
    for m in re.finditer(r"[{}]", code):
        if m.group() == "{":
            stack.append(m.start())
            opens.append(m.start())
        elif stack:
            partner[stack.pop()] = m.start()
    starts = np.sort(np.array([m.start() for p in DECISIONS for m in p.finditer(code)], dtype=np.int64))
    out, seen = [], set()

    def emit(name: str, line: int, start: int, end: int, params: int) -> None:
        points = int(np.searchsorted(starts, end) - np.searchsorted(starts, start))
        lines = bisect.bisect_left(newlines, end) - bisect.bisect_left(newlines, start) + 1
        out.append((name, line, 1 + points, params, lines))

    for m in FUNCTION.finditer(code):
        line = bisect.bisect_left(newlines, m.start()) + 1
        if line in seen:
            continue
        seen.add(line)
        at = bisect.bisect_left(opens, m.start())
        if at == len(opens) or opens[at] not in partner:
            continue
        found = next((n for n in (p.search(m.group()) for p in NAMES) if n), None)
        emit(found.group(1) if found else "(anonymous)", line, m.start(), partner[opens[at]] + 1, _params(m.group()))
    for m in ARROW.finditer(code):
        line = bisect.bisect_left(newlines, m.start()) + 1
        if line in seen:
            continue
        seen.add(line)
        solid = SOLID.search(code, m.end())
        start = solid.start() if solid else len(code)
        if code.startswith("{", start):
            end = partner.get(start, len(code) - 1) + 1
        else:
            stop = STOP.search(code, start)
            end = stop.start() if stop else len(code)
        emit(m.group(1), line, start, end, _params(m.group()))
    return out


def discover_functions(files: DataFrame) -> DataFrame:
    """functions(repo, path, name, line, complexity, params, n_lines) of files(repo, path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (r, p, *f) for r, p, c in zip(batch["repo"], batch["path"], batch["content"], strict=True)
                for f in functions_of(c or "")]
            yield pd.DataFrame(rows, columns=["repo", "path", "name", "line", "complexity", "params", "n_lines"])

    return files.select("repo", "path", "content").mapInPandas(run, FUNCTION_SCHEMA)


def file_complexity(functions: DataFrame) -> DataFrame:
    """Mean, maximum and number of functions per file."""
    return functions.groupBy("repo", "path").agg(
        (F.sum("complexity") / F.count(F.lit(1))).alias("average"), F.max("complexity").alias("maximum"),
        F.count(F.lit(1)).alias("functions"))


def overall_complexity(functions: DataFrame) -> DataFrame:
    return functions.agg(
        F.countDistinct("repo", "path").alias("files"), (F.sum("complexity") / F.count(F.lit(1))).alias("overall_average"))


def hotspots(files: DataFrame, min_average: float = 10.0, k: int | None = None) -> DataFrame:
    """Files above the average bound, highest first when limited."""
    rows = files.where(F.col("average") > min_average)
    return rows if k is None else rows.orderBy(F.col("average").desc(), "repo", "path").limit(k)


def complexity_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(repo, path, metric, before, after, change) of current files; new files report functions only."""
    p = before.select("repo", "path", *[F.col(c).cast("double").alias(f"_{c}") for c in ("average", "maximum", "functions")])
    j = after.join(p, ["repo", "path"], "left")
    known = F.col("_functions").isNotNull()

    def row(metric: str, need: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), F.coalesce(f"_{metric}", F.lit(0.0)).alias("before"),
                        F.col(metric).cast("double").alias("after"), need.alias("need"))

    rows = F.array(row("average", known), row("maximum", known), row("functions", F.lit(True)))
    out = j.select("repo", "path", F.explode(rows).alias("_r")).select("repo", "path", "_r.*")
    return out.where(F.col("need") & (F.col("after") != F.col("before"))).select(
        "repo", "path", "metric", "before", "after", (F.col("after") - F.col("before")).alias("change"))
