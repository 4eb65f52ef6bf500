"""Config checks: env drift, key checks, typed rules, JSON document rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import present
from ..functions.jsons import json_type

# Accepted booleans, and the shapes of a number and a web address.
BOOLEANS = ("true", "false", "1", "0")
NUMBER = r"^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|Infinity)\s*$|^\s*0[xX][0-9a-fA-F]+\s*$"
URL = r"^https?://[^\s/?#]+"


def env_drift(env: DataFrame, reference: DataFrame, compat: bool = False) -> DataFrame:
    """(service, key, state): missing, extra or drifted against the reference values.

    ``compat`` reports drifted values only for services that also miss or add keys.
    """
    e = env.select("service", "key", F.col("value").alias("_e"))
    r = reference.select("service", "key", F.col("value").alias("_r"))
    rows = e.join(r, ["service", "key"], "full_outer").select(
        "service", "key",
        F.when(F.col("_e").isNull(), "missing").when(F.col("_r").isNull(), "extra")
        .when(F.col("_e") != F.col("_r"), "drifted").alias("state")).where(F.col("state").isNotNull())
    if compat:
        moved = rows.where(F.col("state") != "drifted").select("service").distinct()
        rows = rows.join(moved, "service", "left_semi")
    return rows


def env_key_check(env: DataFrame, expected: DataFrame) -> DataFrame:
    """(service, key, problem): keys missing from or extra to the expected ones."""
    e = env.select("service", "key", F.lit(1).alias("_e"))
    x = expected.select("service", "key", F.lit(1).alias("_x"))
    return e.join(x, ["service", "key"], "full_outer").where(F.col("_e").isNull() | F.col("_x").isNull()).select(
        "service", "key", F.when(F.col("_e").isNull(), "missing").otherwise("extra (not in schema)").alias("problem"))


@dataclass(frozen=True)
class ConfigRule:
    key: str
    type: str = "string"
    required: bool = False
    pattern: str = ""


def validate_config(kv: DataFrame, rules: Sequence[ConfigRule]) -> DataFrame:
    """(service, key, expected, actual, severity) issues of every service against every rule.

    The rules meet a service's values in one row: values are pivoted by the rule keys with one
    aggregation, so neither a service x rule product nor a join is needed.
    """
    wide = kv.groupBy("service").agg(*[
        F.max(F.when(F.col("key") == r.key, F.col("value"))).alias(f"_v{i}") for i, r in enumerate(rules)])
    issues: list[Column] = []

    def issue(cond: Column, r: ConfigRule, expected: str, actual: Column, severity: str) -> Column:
        return F.when(cond, F.struct(F.lit(r.key).alias("key"), F.lit(expected).alias("expected"), actual.alias("actual"),
                                     F.lit(severity).alias("severity")))

    for i, r in enumerate(rules):
        v = F.col(f"_v{i}")
        empty = v.isNull() | (v == "")
        actual = F.coalesce(v, F.lit("(missing)"))
        if r.required:
            issues.append(issue(empty, r, f"required {r.type}", actual, "error"))
        else:
            issues.append(issue(empty, r, "optional", actual, "notice"))
        bad = {
            "number": ~v.rlike(NUMBER), "boolean": ~F.lower(v).isin(*BOOLEANS), "url": ~v.rlike(URL),
        }.get(r.type)
        if bad is not None:
            issues.append(issue(~empty & bad, r, r.type, actual, "error"))
        if r.pattern:
            issues.append(issue(~empty & ~v.rlike(r.pattern), r, f"match pattern {r.pattern}", actual, "warning"))
    return wide.select("service", F.explode(present(issues)).alias("_i")).select("service", "_i.*")


def missing_variables(kv: DataFrame, names: Sequence[str]) -> DataFrame:
    """(service, key, actual) of required variables that are missing or blank."""
    wide = kv.groupBy("service").agg(*[
        F.max(F.when(F.col("key") == n, F.col("value"))).alias(f"_v{i}") for i, n in enumerate(names)])
    rows = [
        F.when(F.coalesce(F.trim(f"_v{i}"), F.lit("")) == "", F.struct(
            F.lit(n).alias("key"), F.when(F.col(f"_v{i}").isNull(), "(missing)").otherwise("(empty)").alias("actual")))
        for i, n in enumerate(names)]
    return wide.select("service", F.explode(present(rows)).alias("_i")).select("service", "_i.*")


def validate_json(docs: DataFrame, rules: Sequence[ConfigRule], required_by_default: bool = True) -> DataFrame:
    """(id, key, expected, actual) type issues of JSON documents(id, content) by dot path.

    Unparsable text and roots that are no object or list give one issue each.
    """
    doc = F.col("_doc")
    root = F.schema_of_variant(doc)

    def issue(cond: Column, key: str, expected: str, actual: Column) -> Column:
        return F.when(cond, F.struct(F.lit(key).alias("key"), F.lit(expected).alias("expected"), actual.alias("actual")))

    parsed = doc.isNotNull()
    nested = parsed & (root.startswith("OBJECT") | root.startswith("ARRAY"))
    kind = F.when(root == "STRING", "string").when(root == "BOOLEAN", "boolean").when(root == "VOID", "object").otherwise("number")
    issues = [issue(~parsed, "(parse)", "valid JSON", F.lit("invalid")), issue(parsed & ~nested, "(root)", "object", kind)]
    for r in rules:
        found = json_type(doc, r.key)
        if r.required or required_by_default:
            issues.append(issue(nested & found.isNull(), r.key, r.type, F.lit("(missing)")))
        shown = F.when(found == "null", "object").otherwise(found)
        issues.append(issue(nested & (found != r.type.lower()), r.key, r.type, shown))
    return docs.withColumn("_doc", F.try_parse_json("content")).select("id", F.explode(present(issues)).alias("_i")).select("id", "_i.*")
