"""Translation gaps and untranslated strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _state(locales: DataFrame) -> DataFrame:
    """(repo, key, have, langs): languages with a text for the key, and all of the repo.

    Both arrays are bounded by the number of languages; keys are never multiplied with languages
    before the gaps are known.
    """
    langs = locales.groupBy("repo").agg(F.collect_set("lang").alias("langs"))
    have = locales.groupBy("repo", "key").agg(
        F.collect_set(F.when(F.trim("value") != "", F.col("lang"))).alias("have"))
    return have.join(langs, "repo")


def missing_translations(locales: DataFrame) -> DataFrame:
    """(repo, key, lang) without a non-blank text."""
    return _state(locales).select("repo", "key", F.explode(F.array_except("langs", "have")).alias("lang"))


def untranslated_keys(locales: DataFrame) -> DataFrame:
    """Keys translated in fewer than half of the repo's languages."""
    return _state(locales).where(F.size("have") * 2 < F.size("langs")).select("repo", "key")


def untranslated_strings(strings: DataFrame, locales: DataFrame) -> DataFrame:
    """(repo, key, lang, path) gaps of hard-coded strings: all languages for keys under half,
    else the missing ones; keys unknown to every locale are not reported."""
    state = _state(locales)
    gaps = F.when(F.size("have") * 2 < F.size("langs"), F.col("langs")).otherwise(F.array_except("langs", "have"))
    return strings.select("repo", "key", "path").join(state, ["repo", "key"]).select(
        "repo", "key", F.explode(gaps).alias("lang"), "path")


def strings_with_gaps(strings: DataFrame, locales: DataFrame) -> DataFrame:
    """The report variant that lists every language for any key with at least one gap."""
    state = _state(locales).where(F.size(F.array_except("langs", "have")) > 0)
    return strings.select("repo", "key", "path").join(state, ["repo", "key"]).select(
        "repo", "key", F.explode("langs").alias("lang"), "path")
