"""Import edges: extraction, dead files, dependents, coupling, untested sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.maths import half_up
from ..functions.text import captures
from ..sources.files import base_name
from .contain import containing

# Script files, and how tests are named.
SCRIPT_EXT = r"\.(ts|tsx|js|jsx)$"
SOURCE_EXT = r"\.(ts|tsx|js|jsx|mjs|cjs)$"
TEST_EXT = r"\.(test|spec)\.(ts|tsx)$|\.(test|spec)\.js$"


def read_imports(files: DataFrame) -> DataFrame:
    """imports(repo, src_path, target): every ``from '...'`` clause of script files."""
    return files.where(F.col("path").rlike(SCRIPT_EXT)).select(
        "repo", F.col("path").alias("src_path"),
        F.explode(captures(F.col("content"), r"from\s+['\"]([^'\"]+)['\"]")).alias("target"))


def dead_files(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Files no import names, neither by path without extension nor by last segment.

    Two hash anti joins on (repo, name) over distinct targets.
    """
    name = F.regexp_replace("path", SCRIPT_EXT, "")
    f = files.select("repo", "path", name.alias("_full"), base_name(name).alias("_base"))
    targets = imports.select("repo", "target").distinct()
    full = targets.select("repo", F.col("target").alias("_full"))
    base = targets.where(F.contains("target", F.lit("/"))).select("repo", base_name(F.col("target")).alias("_base")).distinct()
    return f.join(full, ["repo", "_full"], "left_anti").join(base, ["repo", "_base"], "left_anti").select("repo", "path")


def dependents(imports: DataFrame, module: str) -> DataFrame:
    return imports.where(F.col("target") == module).select("repo", "src_path").distinct()


def coupling(imports: DataFrame, modules: Sequence[str] | DataFrame) -> DataFrame:
    """Importing files per module name; a module is hit when an import contains its name. Modules may be a table(module).

    Distinct targets are looked up in the gram index of the names; an empty name is in no target.
    """
    if not isinstance(modules, DataFrame):
        modules = imports.sparkSession.createDataFrame([(m,) for m in modules], "module string")
    targets = imports.select("target").distinct()
    hits = containing(targets, F.col("target"), modules.select(F.col("module").alias("needle")))
    return (
        imports.select("repo", "src_path", "target").join(hits, "target")
        .groupBy(F.col("needle").alias("module")).agg(F.countDistinct("repo", "src_path").alias("imported_by")))


def untested(files: DataFrame) -> DataFrame:
    """Source files without a test by naming convention (beside it or in ``__tests__``).

    Tests are mapped to the stems they cover, so one anti join on (repo, stem) is enough.
    """
    path = F.col("path")
    is_test = path.rlike(TEST_EXT)
    stem = F.regexp_replace(path, r"\.[^./]+$", "")
    covered = F.regexp_replace(stem, r"\.(test|spec)$", "")
    outside = F.regexp_replace(covered, r"(^|/)__tests__/([^/]*)$", "$1$2")
    stems = files.where(is_test).select("repo", F.explode(F.array(covered, outside)).alias("_stem")).distinct()
    sources = files.where(path.rlike(SOURCE_EXT) & ~is_test & ~base_name(path).startswith("index.")).select(
        "repo", "path", stem.alias("_stem"))
    return sources.join(stems, ["repo", "_stem"], "left_anti").select("repo", "path")


def tested_ratio(files: DataFrame) -> DataFrame:
    """Per repo: source files, untested ones, tested share in percent."""
    path = F.col("path")
    total = files.where(path.rlike(SOURCE_EXT) & ~path.rlike(TEST_EXT)).groupBy("repo").agg(F.count(F.lit(1)).alias("sources"))
    bare = untested(files).groupBy("repo").agg(F.count(F.lit(1)).alias("_u"))
    n = F.coalesce("_u", F.lit(0))
    return total.join(bare, "repo", "left").select(
        "repo", "sources", n.alias("untested"), half_up((F.col("sources") - n) / F.col("sources") * 100, 2).alias("tested_ratio"))


