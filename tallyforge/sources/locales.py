"""Locale files: nested JSON as dot keys, JS objects by pattern; language from the file name."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.jsons import flatten_keys
from ..operators.history import first_rows
from .files import base_name

# Locale file names and properties of a JS export.
LOCALE_FILE = r"^([a-z]{2}(?:-[A-Z]{2})?)\.(json|js|cjs|mjs)$"
JS_PROPERTY = r"[\"']?([a-zA-Z0-9_-]+)[\"']?\s*:\s*[\"']([^\"']*)[\"']"
# Levels opened before the data is asked for deeper ones.
DEPTH = 8


def read_locales(files: DataFrame, depth: int = DEPTH) -> DataFrame:
    """locales(repo, lang, key, value) of locale files(repo, path, content), keys of every nesting depth."""
    name = base_name(F.col("path"))
    found = files.withColumn("lang", F.regexp_extract(name, LOCALE_FILE, 1)).withColumn(
        "_kind", F.regexp_extract(name, LOCALE_FILE, 2)).where(F.col("lang") != "")
    docs = found.where(F.col("_kind") == "json").select("repo", "lang", F.try_parse_json("content").alias("_doc"))
    nested = flatten_keys(docs.where(F.col("_doc").isNotNull()), "_doc", ["repo", "lang"], depth)
    body = F.regexp_extract("content", r"(\{[\s\S]*\})", 1)
    pairs = F.arrays_zip(
        F.regexp_extract_all(body, F.lit(JS_PROPERTY), F.lit(1)).alias("key"),
        F.regexp_extract_all(body, F.lit(JS_PROPERTY), F.lit(2)).alias("value"))
    flat = found.where(F.col("_kind") != "json").select("repo", "lang", F.posexplode(pairs).alias("_pos", "_kv")).select(
        "repo", "lang", F.col("_kv.key").alias("key"), F.col("_kv.value").alias("value"), "_pos")
    last = first_rows(flat, ["repo", "lang", "key"], [F.col("_pos").desc()]).drop("_pos")
    return nested.unionByName(last)
