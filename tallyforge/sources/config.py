"""Environment files and JSON config documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.history import first_rows
from ..operators.match import strip
from .files import to_lines


def read_env(files: DataFrame) -> DataFrame:
    """config_kv(service, key, value) of env files(repo, path, content); repo is the service.

    Blank lines, comments and lines without ``=`` are dropped, matching outer quotes removed, and
    the last assignment of a key wins.
    """
    text = strip(F.col("text"))
    rows = to_lines(files).withColumn("_t", text).where(
        (F.col("_t") != "") & ~F.col("_t").startswith("#") & F.contains("_t", F.lit("=")))
    raw = strip(F.regexp_extract("_t", r"^[^=]*=(.*)$", 1))
    quoted = raw.rlike("^\".*\"$|^'.*'$") & (F.length(raw) >= 2)
    parsed = rows.select(
        F.col("repo").alias("service"), "path", "line", strip(F.substring_index("_t", "=", 1)).alias("key"),
        F.when(quoted, F.regexp_replace(raw, "^.|.$", "")).otherwise(raw).alias("value"),
    ).where(F.col("key") != "")
    return first_rows(parsed, ["service", "path", "key"], [F.col("line").desc()]).select("service", "path", "key", "value")
