"""Coverage report readers: Istanbul JSON, LCOV records, and a reader that picks by file name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.maths import pct
from .files import base_name

_COUNTERS = "map<string,int>"
_ISTANBUL = (
    f"map<string,struct<s:{_COUNTERS},f:{_COUNTERS},b:map<string,array<int>>,l:{_COUNTERS}>>"
)


def _hit(values: Column) -> Column:
    return F.size(F.filter(values, lambda v: v > 0))


def read_istanbul(files: DataFrame, tool: str = "istanbul") -> DataFrame:
    """coverage rows of Istanbul-style JSON; entries lacking one of s, f, b, l are left out."""
    rows = files.select("repo", F.explode(F.from_json("content", _ISTANBUL)).alias("path", "c")).where(
        F.col("c.s").isNotNull() & F.col("c.f").isNotNull() & F.col("c.b").isNotNull() & F.col("c.l").isNotNull())
    branches = F.flatten(F.map_values("c.b"))
    zero_lines = F.transform(
        F.filter(F.map_entries("c.l"), lambda e: e["value"] == 0), lambda e: e["key"].try_cast("int"))
    return rows.select(
        "repo", F.lit(tool).alias("tool"), "path",
        F.size(F.map_values("c.s")).alias("total_statements"), _hit(F.map_values("c.s")).alias("covered_statements"),
        F.size(branches).alias("total_branches"), _hit(branches).alias("covered_branches"),
        F.size(F.map_values("c.f")).alias("total_functions"), _hit(F.map_values("c.f")).alias("covered_functions"),
        F.size(F.map_values("c.l")).alias("total_lines"), _hit(F.map_values("c.l")).alias("covered_lines"),
        F.sort_array(zero_lines).alias("uncovered_lines"))


def read_lcov(files: DataFrame, tool: str = "lcov") -> DataFrame:
    """coverage rows of LCOV text; records are cut and counted inside the file's own row."""
    record = F.filter(F.transform(F.split("_rec", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = (
        files.select("repo", F.explode(F.split("content", "end_of_record")).alias("_rec"))
        .select("repo", record.alias("_l"))
    )

    def fields(tag: str, least: int) -> Column:
        own = F.filter("_l", lambda x: x.startswith(tag))
        cut = F.transform(own, lambda x: F.split(F.substring(x, len(tag) + 1, 2147483647), ","))
        return F.filter(cut, lambda p: F.size(p) >= least)

    da, fn, fnda, brda = fields("DA:", 2), fields("FN:", 2), fields("FNDA:", 2), fields("BRDA:", 4)
    names = F.array_distinct(F.transform("_fnda", lambda p: F.trim(F.array_join(F.slice(p, 2, 99999), ","))))
    # the last count of a name wins
    called = F.filter(names, lambda n: F.element_at(
        F.filter("_fnda", lambda p: F.trim(F.array_join(F.slice(p, 2, 99999), ",")) == n), -1)[0].try_cast("double") > 0)
    sf = F.element_at(F.concat(F.array(F.lit("")), F.transform(
        F.filter("_l", lambda x: x.startswith("SF:")), lambda x: F.trim(F.substring(x, 4, 2147483647)))), -1)
    taken = F.filter("_brda", lambda p: (p[3] != "-") & (p[3].try_cast("double") > 0))
    return (
        rows.select("repo", sf.alias("path"), da.alias("_da"), fn.alias("_fn"), fnda.alias("_fnda"), brda.alias("_brda"))
        .where((F.col("path") != "") & (F.size("_da") > 0))
        .select(
            "repo", F.lit(tool).alias("tool"), "path",
            F.size("_da").alias("total_statements"),
            F.size(F.filter("_da", lambda p: p[1].try_cast("double") > 0)).alias("covered_statements"),
            F.size("_brda").alias("total_branches"), F.size(taken).alias("covered_branches"),
            F.when(F.size("_fn") > 0, F.size("_fn")).otherwise(F.size(names)).alias("total_functions"),
            F.size(called).alias("covered_functions"),
            F.size("_da").alias("total_lines"),
            F.size(F.filter("_da", lambda p: p[1].try_cast("double") > 0)).alias("covered_lines"),
            F.sort_array(F.transform(F.filter("_da", lambda p: p[1].try_cast("double") == 0), lambda p: p[0].try_cast("int"))).alias("uncovered_lines"))
    )


def read_coverage(files: DataFrame) -> DataFrame:
    """(repo, format, path, covered, total, pct) of whatever report a file name announces.

    lcov.info and coverage-final.json give one row per source file; clover and cobertura XML
    only their overall line rate.
    """
    name = base_name(F.col("path"))
    lcov = read_lcov(files.where(name == "lcov.info")).select(
        "repo", F.lit("lcov").alias("format"), "path", F.col("covered_lines").alias("covered"), F.col("total_lines").alias("total"))
    doc = F.from_json("content", f"map<string,struct<s:{_COUNTERS}>>")
    hits = F.coalesce(F.map_values("c.s"), F.array().cast("array<int>"))
    js = (
        files.where(name == "coverage-final.json").select("repo", F.explode(doc).alias("path", "c"))
        .select("repo", F.lit("istanbul-json").alias("format"), "path", _hit(hits).alias("covered"), F.size(hits).alias("total"))
        .where(F.col("total") > 0))
    rate = F.regexp_extract("content", r'line-rate="([\d.]+)"', 1).try_cast("double")
    xml = files.where(name.isin("clover.xml", "cobertura-coverage.xml")).select(
        "repo", F.when(name == "clover.xml", "clover").otherwise("cobertura").alias("format"), "path",
        F.lit(None).cast("int").alias("covered"), F.lit(None).cast("int").alias("total"),
        (F.floor(rate * 10000.0 + 0.5).cast("double") / 100.0).alias("pct"))
    counted = lcov.unionByName(js).withColumn("pct", pct(F.col("covered"), F.col("total"), 2))
    return counted.unionByName(xml)
