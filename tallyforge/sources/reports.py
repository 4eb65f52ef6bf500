"""Build and document readers: bundle statistics, page audits, decision records, memory notes,
deferred bugs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.maths import half_up
from ..operators.deps import gzip_size
from ..operators.match import strip
from .files import base_name

# Audits reported besides the categories.
AUDITS = (
    "first-contentful-paint", "largest-contentful-paint", "total-blocking-time", "cumulative-layout-shift", "speed-index",
    "interactive",
)

# Decision record names, fields and status prefixes.
ADR_FILE = r"^\d{4}-.+\.md$"
ADR_STATUS = (("accept", "accepted"), ("propos", "proposed"), ("deprec", "deprecated"), ("supers", "superseded"))


def read_bundles(files: DataFrame) -> DataFrame:
    """bundle_modules(build, name, size, gzip_size) of ``assets`` and ``output`` lists; repo is the build."""
    doc = F.from_json("content", (
        "struct<assets:array<struct<name:string,filename:string,size:double>>,"
        "output:array<struct<fileName:string,name:string,size:double>>>"))
    none = F.array().cast("array<struct<name:string,size:double>>")
    assets = F.transform(F.col("_d.assets"), lambda a: F.struct(F.coalesce(a["name"], a["filename"]).alias("name"), a["size"].alias("size")))
    output = F.transform(F.col("_d.output"), lambda a: F.struct(F.coalesce(a["fileName"], a["name"]).alias("name"), a["size"].alias("size")))
    rows = files.withColumn("_d", doc).select(
        F.col("repo").alias("build"), F.explode(F.concat(F.coalesce(assets, none), F.coalesce(output, none))).alias("_m"))
    size = F.coalesce("_m.size", F.lit(0.0)).cast("bigint")
    return rows.where(F.coalesce("_m.name", F.lit("")) != "").select("build", F.col("_m.name").alias("name"), size.alias("size")).withColumn(
        "gzip_size", gzip_size(F.col("size")))


def read_lighthouse(files: DataFrame) -> DataFrame:
    """(repo, name, score, display) of all categories and the listed audits of page reports."""
    item = "map<string,struct<title:string,score:double,displayValue:string>>"
    doc = files.select("repo", F.from_json("content", f"struct<categories:{item},audits:{item}>").alias("_d")).where(
        F.col("_d.categories").isNotNull() & F.col("_d.audits").isNotNull())
    cats = doc.select("repo", F.explode("_d.categories").alias("key", "v")).where(F.col("v.score").isNotNull()).select(
        "repo", F.coalesce("v.title", "key").alias("name"), F.col("v.score").alias("score"),
        half_up(F.col("v.score") * 100).cast("bigint").cast("string").alias("display"))
    audits = doc.select("repo", F.explode("_d.audits").alias("key", "v")).where(
        F.col("key").isin(*AUDITS) & F.col("v.score").isNotNull()).select(
        "repo", F.coalesce("v.title", "key").alias("name"), F.col("v.score").alias("score"), F.coalesce("v.displayValue", F.lit("")).alias("display"))
    return cats.unionByName(audits)


def read_adrs(files: DataFrame) -> DataFrame:
    """(repo, id, title, status, date, supersedes) of decision records ``NNNN-name.md``."""
    name = base_name(F.col("path"))
    c = F.col("content")
    heading = strip(F.regexp_extract(c, r"(?m)^#\s+\d+\.\s+(.+)", 1))
    fallback = F.replace(F.regexp_replace(F.regexp_replace(name, r"^\d+-", ""), r"\.md$", ""), F.lit("-"), F.lit(" "))
    said = F.lower(strip(F.regexp_extract(c, r"(?i)\*\*Status:\*\*\s+(.+)", 1)))
    status = F.lit("proposed")
    for prefix, label in ADR_STATUS:
        status = F.when(said.startswith(prefix), label).otherwise(status)
    sup = F.regexp_extract(c, r"(?i)supersedes.*?ADR[-\s]*(\d+)", 1)
    date = strip(F.regexp_extract(c, r"(?i)\*\*Date:\*\*\s+(.+)", 1))
    return files.where(name.rlike(ADR_FILE)).select(
        "repo", F.regexp_extract(name, r"^(\d+)", 1).cast("int").alias("id"),
        F.when(heading != "", heading).otherwise(fallback).alias("title"), status.alias("status"),
        F.nullif(date, F.lit("")).alias("date"), F.nullif(sup, F.lit("")).cast("int").alias("supersedes"))


def adr_edges(adrs: DataFrame) -> DataFrame:
    """(repo, id, supersedes) edges between records."""
    return adrs.where(F.col("supersedes").isNotNull()).select("repo", "id", "supersedes")


def read_memory_docs(files: DataFrame) -> DataFrame:
    """(repo, name, description, content) of note files; the first heading, else the first line."""
    c = F.col("content")
    head = F.regexp_extract(c, r"(?m)^#\s+(.+)", 1)
    line = F.regexp_extract(c, r"^(.+)", 1)
    name = F.regexp_replace(base_name(F.col("path")), r"\.md$", "")
    said = F.when(head != "", head).when(line != "", line).otherwise(name)
    return files.select("repo", name.alias("name"), F.left(strip(said), F.lit(200)).alias("description"), "content")


def search_docs(docs: DataFrame, text: str) -> DataFrame:
    needle = F.lit(text.lower())
    return docs.where(F.contains(F.lower(F.concat_ws(" ", "name", "description", "content")), needle))


def read_deferred_bugs(files: DataFrame) -> DataFrame:
    """(repo, pos, item) of deferred-bug files: a list, or an object's ``bugs`` or ``items`` list."""
    doc = F.col("_doc")
    rows = files.withColumn("_doc", F.try_parse_json("content"))
    items = F.coalesce(
        F.try_variant_get(doc, "$", "array<variant>"), F.try_variant_get(doc, "$.bugs", "array<variant>"),
        F.try_variant_get(doc, "$.items", "array<variant>"))
    return rows.select("repo", F.posexplode(items).alias("pos", "_i")).select("repo", "pos", F.to_json("_i").alias("item"))
