"""Source trees: files, lines, path globs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.rx import glob_regex, literal_regex
from ..rules import words


def extension(path: Column) -> Column:
    """Last dot suffix of the base name, lower case, with the dot; empty when there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent_dir(path: Column) -> Column:
    """Text before the last slash; empty at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def module_of(path: Column) -> Column:
    """First folder of a relative path, ``(root)`` when there is none."""
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise("(root)")


def read_files(
    spark: SparkSession,
    root: str,
    exts: Sequence[str] = words.SOURCE_EXTENSIONS,
    skip_dirs: Sequence[str] = words.SKIP_DIRS,
    max_bytes: int | None = None,
) -> DataFrame:
    """files(repo, path, ext, content, n_bytes) below root/<repo>/...

    Extensions prune at listing time (glob filter); folder and size rules use the file
    metadata columns, so excluded contents are never decoded.
    """
    glob = "*{" + ",".join(exts) + "}"
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
    )
    rel = F.regexp_replace("path", f"^.*?{literal_regex(root.rstrip('/'))}/", "")
    skip = "|".join(literal_regex(d) for d in skip_dirs)
    kept = raw.withColumn("_rel", rel).where(~F.col("_rel").rlike(rf"(^|/)(?:{skip}|\.[^/]*)(/|$)"))
    if max_bytes is not None:
        kept = kept.where(F.col("length") <= max_bytes)
    nested = F.contains("_rel", F.lit("/"))
    path = F.when(nested, F.regexp_replace("_rel", "^[^/]+/", "")).otherwise(F.col("_rel"))
    return kept.select(
        F.when(nested, F.substring_index("_rel", "/", 1)).otherwise("(root)").alias("repo"),
        path.alias("path"),
        extension(path).alias("ext"),
        F.decode("content", "UTF-8").alias("content"),
        F.col("length").alias("n_bytes"),
    )


def to_lines(files: DataFrame, *keep: str) -> DataFrame:
    """lines(repo, path, line, text), 1-based; one generator, no shuffle."""
    return files.select(
        "repo", "path", *keep, F.posexplode(F.split("content", "\n")).alias("_pos", "text")
    ).select("repo", "path", (F.col("_pos") + 1).alias("line"), "text", *keep)


def path_glob(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Keep rows whose path matches an include glob (if any) and no exclude glob."""
    if include:
        df = df.where(F.col("path").rlike("|".join(glob_regex(g) for g in include)))
    if exclude:
        df = df.where(~F.col("path").rlike("|".join(glob_regex(g) for g in exclude)))
    return df


def with_language(files: DataFrame) -> DataFrame:
    """Adds ``lang``: the short code used by the rule tables, empty for other extensions."""
    from ..functions.arrays import lookup

    return files.withColumn(
        "lang", lookup(words.RULE_LANGUAGE_BY_EXTENSION, extension(F.col("path")), "")
    )
