"""Safe JSON parsing, dot-path access and structural compaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def safe_json(raw: Column) -> Column:
    """VARIANT of the text, null when it is not JSON."""
    return F.try_parse_json(raw)


def is_json(raw: Column) -> Column:
    return F.try_parse_json(raw).isNotNull()


def dot_get(doc: Column, path: str, as_type: str = "string") -> Column:
    """Value at a dot path of a VARIANT, null when absent or not convertible."""
    return F.try_variant_get(doc, "$." + path, as_type)


def json_type(doc: Column, path: str) -> Column:
    """object, array, string, number, boolean or null; SQL null when the path is absent."""
    at = F.try_variant_get(doc, "$." + path, "variant")
    name = F.schema_of_variant(at)
    return (
        F.when(at.isNull(), F.lit(None).cast("string"))
        .when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when(name == "VOID", "null")
        .otherwise("number")
    )


def flatten_keys(df: DataFrame, doc: str, keep: Sequence[str], depth: int = 4) -> DataFrame:
    """Leaf strings of a nested JSON object as (keep..., key, value) rows with dot keys.

    Lateral explodes, ``depth`` at a time: objects open up, leaves pass through. They are repeated until no row holds an
    object, which is asked of the data, so every level is reached and ``depth`` only sets how often it is asked.
    """
    spark = df.sparkSession
    v, prefix = F.col("_v"), F.col("_prefix")
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    rows = df.select(*keep, F.lit("").alias("_prefix"), F.col(doc).alias("_v"))
    while True:
        for _ in range(max(depth, 1)):
            rows = rows.withColumn("_open", is_object)
            nested = spark.tvf.variant_explode_outer(F.when(F.col("_open"), v).outer())
            path = F.when(prefix == "", F.col("key")).otherwise(F.concat_ws(".", prefix, "key"))
            rows = rows.lateralJoin(nested).select(
                *keep, F.when(F.col("_open"), path).otherwise(prefix).alias("_prefix"),
                F.when(F.col("_open"), F.col("value")).otherwise(v).alias("_v"))
        if rows.where(is_object).isEmpty():
            break
    return rows.where(F.schema_of_variant(v) == "STRING").select(
        *keep, prefix.alias("key"), F.variant_get(v, "$", "string").alias("value"))
