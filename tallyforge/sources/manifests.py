"""Dependency manifests, lockfiles and licence fields, parsed from files(repo, path, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import lookup
from ..functions.jsons import json_type
from ..functions.versions import strip_range
from ..operators.history import distinct_first
from ..rules import packages as P
from .files import base_name, to_lines

_NPM = (
    "struct<dependencies:map<string,string>,devDependencies:map<string,string>,"
    "peerDependencies:map<string,string>>"
)
_EMPTY = "map<string,string>"


def _named(files: DataFrame, name: str) -> DataFrame:
    return files.where(base_name(F.col("path")) == name)


def _npm_maps(files: DataFrame) -> DataFrame:
    """package.json files with their three maps; unreadable JSON gives empty maps."""
    doc = F.from_json("content", _NPM)

    def part(name: str) -> Column:
        return F.coalesce(doc[name], F.create_map().cast(_EMPTY)).alias(name)

    return _named(files, "package.json").select(
        "repo", F.col("path").alias("manifest"),
        part("dependencies"), part("devDependencies"), part("peerDependencies"))


def read_npm(files: DataFrame) -> DataFrame:
    """Runtime and development packages; a name in both keeps its development version."""
    dev = F.col("devDependencies")
    merged = F.map_concat(
        F.map_filter("dependencies", lambda k, v: ~F.map_contains_key(dev, k)), dev
    )
    return (
        _npm_maps(files).select("repo", "manifest", F.explode(merged).alias("name", "_v"))
        .select("repo", "name", strip_range(F.col("_v")).alias("version"), F.lit("npm").alias("ecosystem"), "manifest")
    )


def read_pip(files: DataFrame) -> DataFrame:
    shape = r"^([a-zA-Z0-9_.-]+)\s*(?:[=~><]+\s*([0-9a-zA-Z.*]+))?"
    text = F.trim("text")
    rows = to_lines(_named(files, "requirements.txt")).where(
        (text != "") & ~text.startswith("#") & ~text.startswith("-") & text.rlike(shape))
    version = F.regexp_extract(text, shape, 2)
    return rows.select(
        "repo", F.regexp_extract(text, shape, 1).alias("name"),
        F.when(version == "", "*").otherwise(version).alias("version"),
        F.lit("pip").alias("ecosystem"), F.col("path").alias("manifest"))


def read_go(files: DataFrame) -> DataFrame:
    shape = r"^require\s+(\S+)\s+(\S+)"
    text = F.trim("text")
    return to_lines(_named(files, "go.mod")).where(text.rlike(shape)).select(
        "repo", F.regexp_extract(text, shape, 1).alias("name"),
        F.regexp_extract(text, shape, 2).alias("version"),
        F.lit("go").alias("ecosystem"), F.col("path").alias("manifest"))


def read_cargo(files: DataFrame) -> DataFrame:
    """Entries of ``[dependencies]`` sections; sections are cut inside the file's own row."""
    shape = r"^(\S+)\s*=\s*\"([^\"]+)\""
    sections = F.filter(
        F.split(F.concat(F.lit("\n"), "content"), r"\n\s*(?=\[)"),
        lambda s: s.startswith("[dependencies]"))
    rows = (
        _named(files, "Cargo.toml")
        .select("repo", "path", F.explode(sections).alias("_s"))
        .select("repo", "path", F.explode(F.split("_s", "\n")).alias("text"))
    )
    text = F.trim("text")
    return rows.where(text.rlike(shape)).select(
        "repo", F.regexp_extract(text, shape, 1).alias("name"),
        F.regexp_extract(text, shape, 2).alias("version"),
        F.lit("cargo").alias("ecosystem"), F.col("path").alias("manifest"))


def union_all(*dfs: DataFrame) -> DataFrame:
    """Union by name; columns missing on one side become null."""
    out = dfs[0]
    for more in dfs[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def read_dependencies(files: DataFrame) -> DataFrame:
    """dependencies(repo, name, version, ecosystem, manifest) of all four ecosystems."""
    return union_all(read_npm(files), read_pip(files), read_go(files), read_cargo(files))


def read_dependency_kinds(files: DataFrame) -> DataFrame:
    """(repo, name, version, kind) of package.json, versions as written."""
    maps = _npm_maps(files)
    kinds = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(k).alias("deps"))
        for k in ("dependencies", "devDependencies", "peerDependencies")])
    return (
        maps.select("repo", F.explode(kinds).alias("_k"))
        .select("repo", "_k.kind", F.explode("_k.deps").alias("name", "version"))
        .select("repo", "name", "version", "kind")
    )


def license_field(doc: Column) -> Column:
    """Licence of a package object: a string, an object's type, or the first list entry's type."""

    def text_at(path: str) -> Column:
        return F.when(json_type(doc, path) == "string", F.try_variant_get(doc, f"$.{path}", "string"))

    return F.coalesce(
        text_at("license"), text_at("license.type"), text_at("licenses[0].type"), F.lit("UNKNOWN"))


def read_licenses(files: DataFrame) -> DataFrame:
    """licenses(repo, package, version, license, path) of npm lockfiles and installed packages.

    One row per (repo, package, version): lockfile ``packages`` before ``dependencies``.
    """
    lock = F.from_json("content", "struct<packages:map<string,string>,dependencies:map<string,string>>")
    parts = F.array(*[
        F.struct(F.lit(i).alias("src"), F.coalesce(lock[k], F.create_map().cast(_EMPTY)).alias("m"))
        for i, k in enumerate(("packages", "dependencies"))])
    locked = (
        _named(files, "package-lock.json")
        .select("repo", F.explode(parts).alias("_p"))
        .select("repo", "_p.src", F.explode("_p.m").alias("path", "_raw"))
        .where((F.col("path") != "") & F.col("_raw").startswith("{"))
        .select("repo", "src", "path", F.try_parse_json("_raw").alias("_doc"),
                F.regexp_extract(F.regexp_replace("path", "^node_modules/", ""), "([^/]*)$", 1).alias("package"))
    )
    installed = (
        _named(files, "package.json").where(F.col("path").rlike("(^|/)node_modules/"))
        .select("repo", F.lit(2).alias("src"), "path", F.try_parse_json("content").alias("_doc"))
        .where(F.col("_doc").isNotNull())
        .withColumn("package", F.coalesce(
            F.try_variant_get("_doc", "$.name", "string"),
            F.regexp_extract("path", r"([^/]+)/package\.json$", 1)))
    )
    rows = locked.unionByName(installed).select(
        "repo", "package",
        F.coalesce(F.try_variant_get("_doc", "$.version", "string"), F.lit("")).alias("version"),
        license_field(F.col("_doc")).alias("license"), "path", "src")
    return distinct_first(rows, ["repo", "package", "version"], [F.col("src"), F.col("path")]).drop("src")


def read_pip_licenses(files: DataFrame, known: dict[str, str] = P.PIP_LICENSES) -> DataFrame:
    """Requirement names with the licence of the known-package table, else UNKNOWN."""
    reqs = files.where(
        (base_name(F.col("path")) == "requirements.txt") | F.col("path").rlike(r"(^|/)requirements/[^/]+\.txt$"))
    text = F.trim("text")
    name = F.regexp_extract(text, r"^([a-zA-Z0-9_.-]+)", 1)
    rows = to_lines(reqs).where(
        (text != "") & ~text.startswith("#") & ~text.startswith("-") & ~text.startswith("git+"))
    return rows.select(
        "repo", F.when(name == "", text).otherwise(name).alias("package"),
        F.lit("").alias("version"), "path",
    ).withColumn("license", lookup(known, F.lower("package"), "UNKNOWN"))
