"""Language statistics, totals, comparisons, directory inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import lookup
from ..functions.maths import half_up
from ..rules import words
from ..sources.files import extension


def line_count(content: Column) -> Column:
    """Newline-separated pieces; an empty file has no line."""
    return F.when(F.length(content) == 0, 0).otherwise(
        F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1
    )


def language_of(path: Column) -> Column:
    return lookup(words.LANGUAGE_BY_EXTENSION, extension(path))


def language_stats(files: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Files, lines, bytes per language with the share of lines in percent.

    The total is taken over the handful of language rows, not over the files again.
    """
    from pyspark.sql import Window as W

    per = (
        files.withColumn("language", language_of(F.col("path")))
        .where(F.col("language").isNotNull())
        .groupBy(*by, "language")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum(line_count(F.col("content"))).cast("bigint").alias("lines"),
            F.sum(F.octet_length("content")).cast("bigint").alias("bytes"),
        )
    )
    # at most one row per known language (and key): the window is tiny by construction
    total = F.sum("lines").over(W.partitionBy(*by))
    return per.withColumn(
        "percent", F.when(total > 0, half_up(F.col("lines") / total * 100, 2)).otherwise(0.0)
    )


def codebase_totals(files: DataFrame, deps: DataFrame) -> DataFrame:
    """Per repo: known-language files, lines, bytes and dependency counts by kind."""
    sizes = (
        files.where(language_of(F.col("path")).isNotNull())
        .groupBy("repo")
        .agg(
            F.count(F.lit(1)).alias("total_files"),
            F.sum(line_count(F.col("content"))).cast("bigint").alias("total_lines"),
            F.sum(F.octet_length("content")).cast("bigint").alias("total_bytes"),
        )
    )
    kinds = deps.groupBy("repo").agg(
        F.count_if(F.col("kind") != "devDependencies").alias("dependencies"),
        F.count_if(F.col("kind") == "devDependencies").alias("dev_dependencies"),
    )
    zero = F.lit(0).cast("bigint")
    return sizes.join(kinds, "repo", "full_outer").select(
        "repo", *[F.coalesce(c, zero).alias(c) for c in
                  ("total_files", "total_lines", "total_bytes", "dependencies", "dev_dependencies")])


def language_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Line deltas per language between two statistics tables, changed ones only."""
    b = before.select("language", F.col("lines").alias("before"))
    a = after.select("language", F.col("lines").alias("after"))
    zero = F.lit(0).cast("bigint")
    return (
        b.join(a, "language", "full_outer")
        .select("language", F.coalesce("before", zero).alias("before"), F.coalesce("after", zero).alias("after"))
        .withColumn("change", F.col("after") - F.col("before"))
        .where(F.col("change") != 0)
    )


def only_in(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of a that b does not have."""
    return a.select(*keys).distinct().join(b.select(*keys), keys, "left_anti")


def key_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Added and removed keys: (keys..., change). One exchange per side, both differences at once."""
    b = before.select(*keys, F.lit(1).alias("_b"), F.lit(0).alias("_a"))
    a = after.select(*keys, F.lit(0).alias("_b"), F.lit(1).alias("_a"))
    return (
        b.unionByName(a).groupBy(*keys).agg(F.max("_b").alias("_b"), F.max("_a").alias("_a"))
        .where(F.col("_b") != F.col("_a"))
        .select(*keys, F.when(F.col("_a") == 1, "added").otherwise("removed").alias("change"))
    )


def dir_rollup(files: DataFrame, depth: int = 5) -> DataFrame:
    """Files and bytes below every folder down to ``depth`` levels."""
    steps = F.split(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size("_steps"), F.lit(depth))),
        lambda n: F.array_join(F.slice(F.col("_steps"), F.lit(1), n), "/"),
    )
    return (
        files.where(F.contains("path", F.lit("/")))
        .withColumn("_steps", steps)
        .select("repo", F.octet_length("content").alias("_bytes"), F.explode(prefixes).alias("dir"))
        .groupBy("repo", "dir")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("_bytes").cast("bigint").alias("bytes"))
    )
