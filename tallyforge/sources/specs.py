"""Versioned specs: schema model text, OpenAPI JSON, route strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import captures
from ..operators.history import first_rows

# Methods kept, response codes compared.
METHODS = ("get", "post", "put", "patch", "delete", "head", "options", "trace")
CODES = ("200", "201", "default")


def read_schema_models(files: DataFrame) -> DataFrame:
    """(repo, path, entity, field, type) of ``model X {`` blocks; a repeated field keeps its last line.

    A text is cut before its block headers and closing lines, so a line finds its block in its own part; only field rows
    are exchanged, for the last of a repeated one.
    """
    head = r"[^\S\n]*(?i:model|table|entity)[^\S\n]+(\w+)[^\S\n]*\{"
    parts = F.split("content", rf"(?<![^\n])(?={head}|[^\S\n]*\}}[^\S\n]*(?:\n|\z))")
    blocks = files.select("repo", "path", F.posexplode(parts).alias("_at", "_block")).select(
        "repo", "path", "_at", F.regexp_extract("_block", rf"^{head}", 1).alias("entity"), "_block").where(F.col("entity") != "")
    rows = blocks.select("repo", "path", "entity", "_at", F.posexplode(F.split("_block", "\n")).alias("_pos", "_text")).where("_pos > 0")
    field = r"^\s+(\w+)\s+(\S+)"
    found = rows.where(F.col("_text").rlike(field) & ~F.ltrim("_text").startswith("@@")).select(
        "repo", "path", "entity", "_at", "_pos", F.regexp_extract("_text", field, 1).alias("field"), F.regexp_extract("_text", field, 2).alias("type"))
    return first_rows(found, ["repo", "path", "entity", "field"], [F.col("_at").desc(), F.col("_pos").desc()]).drop("_at", "_pos")


def _variants(df: DataFrame, col: str, keep: list[str], key: str, value: str) -> DataFrame:
    """Explode a VARIANT object into (keep..., key, value)."""
    exploded = df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(col).outer()))
    return exploded.where(F.col("key").isNotNull()).select(
        *keep, F.col("key").alias(key), F.col("value").alias(value))


def _operations(specs: DataFrame) -> DataFrame:
    docs = specs.select("version", F.try_variant_get(F.try_parse_json("content"), "$.paths", "variant").alias("_paths"))
    paths = _variants(docs, "_paths", ["version"], "path", "_ops")
    ops = _variants(paths, "_ops", ["version", "path"], "method", "_op")
    return ops.withColumn("method", F.lower("method")).where(F.col("method").isin(*METHODS))


def read_openapi(specs: DataFrame) -> DataFrame:
    """(version, path, method, params, responses) of specs(version, content), one row per operation; a spec is parsed once.

    params: structs of name, location, required. responses: of the compared codes, structs of code, type, ref, props (type
    by property) and required; the schema is the response's own or that of its JSON media type.
    """
    def param(p: Column) -> Column:
        return F.struct(
            F.coalesce(F.try_variant_get(p, "$.name", "string"), F.lit("")).alias("name"),
            F.coalesce(F.try_variant_get(p, "$.in", "string"), F.lit("query")).alias("location"),
            F.coalesce(F.try_variant_get(p, "$.required", "boolean"), F.lit(False)).alias("required"))

    def response(r: Column) -> Column:
        s = F.coalesce(F.try_variant_get(r["r"], "$.schema", "variant"),
                       F.try_variant_get(r["r"], "$.content['application/json'].schema", "variant"))
        props = F.transform_values(
            F.coalesce(F.try_variant_get(s, "$.properties", "map<string,variant>"), F.create_map().cast("map<string,variant>")),
            lambda k, v: F.coalesce(F.try_variant_get(v, "$.type", "string"), F.lit("")))
        return F.struct(
            r["code"].alias("code"), F.coalesce(F.try_variant_get(s, "$.type", "string"), F.lit("object")).alias("type"),
            F.try_variant_get(s, "$['$ref']", "string").alias("ref"), props.alias("props"),
            F.coalesce(F.try_variant_get(s, "$.required", "array<string>"), F.array().cast("array<string>")).alias("required"))

    ps = F.coalesce(F.try_variant_get("_op", "$.parameters", "array<variant>"), F.array().cast("array<variant>"))
    rs = F.filter(F.array(*[
        F.struct(F.lit(c).alias("code"), F.try_variant_get("_op", f"$.responses['{c}']", "variant").alias("r")) for c in CODES]),
        lambda r: r["r"].isNotNull())
    return _operations(specs).select(
        "version", "path", "method", F.transform(ps, param).alias("params"), F.transform(rs, response).alias("responses"))


def read_openapi_endpoints(specs: DataFrame) -> DataFrame:
    """api_endpoints(version, path, method) of specs(version, content)."""
    return _operations(specs).select("version", "path", "method")


def read_openapi_params(specs: DataFrame) -> DataFrame:
    """api_params(version, path, method, name, location, required)."""
    return read_openapi(specs).select("version", "path", "method", F.inline("params"))


def read_openapi_responses(specs: DataFrame) -> DataFrame:
    """(version, path, method, code, type, ref, props, required) of the compared responses."""
    return read_openapi(specs).select("version", "path", "method", F.inline("responses"))


def route_strings(files: DataFrame) -> DataFrame:
    """Distinct quoted ``method path`` strings per repo."""
    found = captures(F.col("content"), r"((?i)['\"](?:get|post|put|delete|patch)\s+[^'\"]+['\"])")
    return files.select("repo", F.explode(found).alias("route")).distinct()
