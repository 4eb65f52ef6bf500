"""Dependency inventories: advisories, risk classes, licences, SBOM lines, size estimates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.arrays import lookup, rank_of
from ..functions.maths import half_up
from ..functions.versions import version_lt
from ..rules import packages as P
from .history import numbered


def advisories(spark: SparkSession, rows: Sequence[tuple] = P.ADVISORIES) -> DataFrame:
    return spark.createDataFrame(list(rows), P.ADVISORY_SCHEMA)


def vuln_match(deps: DataFrame, known: DataFrame) -> DataFrame:
    """Dependencies below an advisory's fixed version.

    The package name is an equality key, so this stays a hash join with the version test as
    residual; no hint is given, the optimizer broadcasts the advisories only while their size
    statistics allow it and otherwise shuffles with skew splitting.
    """
    return (
        deps.join(known, deps["name"] == known["package"])
        .where(version_lt(F.col("version"), F.col("fixed_in")))
        .select("repo", "package", "version", "ecosystem", "id", "severity", "title", "fixed_in", "cvss")
    )


def merge_advisories(found: DataFrame, external: DataFrame) -> DataFrame:
    """Found matches plus external audit rows whose (repo, package, id) is not known yet."""
    keys = ["repo", "package", "id"]
    fresh = external.join(found.select(*keys), keys, "left_anti").withColumn(
        "severity", lookup(P.AUDIT_SEVERITY, F.col("severity"), "MEDIUM"))
    return found.unionByName(fresh, allowMissingColumns=True)


def vuln_rollup(vulns: DataFrame) -> DataFrame:
    """Count per severity; severities without a match stay with 0."""
    levels = vulns.sparkSession.createDataFrame([(s,) for s in P.SEVERITIES], "severity string")
    counts = vulns.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return levels.join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def rank_sort(df: DataFrame, column: str, order: Sequence[str], *ties: str) -> DataFrame:
    """Order by the position of a label in ``order``; unknown labels last."""
    return df.orderBy(rank_of(order, F.col(column)), *ties)


def pin_risk(version: Column) -> Column:
    """low when pinned, medium for ``~``, high for other ranges."""
    return F.when(~version.rlike(r"^[\^~>=<*]"), "low").when(version.startswith("~"), "medium").otherwise("high")


def trust_risk(name: Column) -> Column:
    return F.when(name.rlike(P.TRUST_HIGH), "high").when(name.rlike(P.TRUST_MEDIUM), "medium").otherwise("low")


# --- licences ------------------------------------------------------------------------


def license_category(license_name: Column, compat: bool = False) -> Column:
    """permissive, restrictive, copyleft or unknown.

    Exact lists first (copyleft, restrictive, permissive), then SPDX-like prefixes. By default
    LGPL and MPL variants outside the lists are restrictive; ``compat`` tests GPL first and so
    counts every LGPL variant as copyleft.
    """
    n = F.trim(F.coalesce(license_name, F.lit("")))
    out = F.when(n.isin("", "UNKNOWN", "UNLICENSED"), "unknown")
    for name, members in P.LICENSES.items():
        out = out.when(n.isin(*members), name)
    like = n.rlike(P.SPDX_LIKE)
    out = out.when(n.rlike("(?i)^LicenseRef-(.+)"), "unknown")
    if compat:
        out = out.when(like & n.contains("GPL"), "copyleft").when(like & n.contains("MPL"), "restrictive")
    else:
        out = out.when(like & n.rlike("LGPL|MPL"), "restrictive").when(like & n.contains("GPL"), "copyleft")
    return out.when(like, "permissive").otherwise("unknown")


def license_rollup(lic: DataFrame) -> DataFrame:
    """Packages per licence and per category: (dim, key, n)."""
    rows = lic.select(
        F.coalesce(F.nullif("license", F.lit("")), F.lit("UNKNOWN")).alias("license"),
        license_category(F.col("license")).alias("category"))
    return (
        rows.groupingSets([["license"], ["category"]], "license", "category")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping("license").alias("_g"))
        .select(F.when(F.col("_g") == 0, "license").otherwise("category").alias("dim"),
                F.coalesce("license", "category").alias("key"), "n")
    )


def _sides(lic: DataFrame) -> DataFrame:
    return lic.select("repo", "package", "license", license_category(F.col("license")).alias("category"))


def license_conflicts(lic: DataFrame) -> DataFrame:
    """Conflicting licence pairs per repo with the number of package pairs behind them.

    Copyleft or restrictive against permissive, a package never against itself. The count is
    n1 x n2 minus the same-package combinations, so no package pair is ever produced.
    """
    rows = _sides(lic)
    hard = F.col("category").isin("copyleft", "restrictive")
    soft = F.col("category") == "permissive"
    per_pkg = rows.groupBy("repo", "package", "license", "category").agg(F.count(F.lit(1)).alias("n"))
    per_lic = per_pkg.groupBy("repo", "license", "category").agg(F.sum("n").alias("n"))

    def named(df: DataFrame, cond: Column, i: int) -> DataFrame:
        keys = [c for c in ("repo", "package") if c in df.columns]
        picked = df.where(cond).select(*keys, F.col("license").alias(f"license{i}"), F.col("n").alias(f"n{i}"),
                                       *([F.col("category").alias("kind")] if i == 1 else []))
        return picked

    pairs = named(per_lic, hard, 1).join(named(per_lic, soft, 2), "repo")
    same = (
        named(per_pkg, hard, 1).join(named(per_pkg, soft, 2), ["repo", "package"])
        .groupBy("repo", "kind", "license1", "license2")
        .agg(F.sum(F.col("n1") * F.col("n2")).alias("own"))
    )
    return (
        pairs.join(same, ["repo", "kind", "license1", "license2"], "left")
        .select("repo", "kind", "license1", "license2",
                (F.col("n1") * F.col("n2") - F.coalesce("own", F.lit(0))).cast("bigint").alias("package_pairs"))
        .where(F.col("package_pairs") > 0)
    )


def conflicting_packages(lic: DataFrame) -> DataFrame:
    """Each copyleft/restrictive package with the number of permissive packages it conflicts with."""
    rows = _sides(lic)
    soft = F.col("category") == "permissive"
    totals = rows.where(soft).groupBy("repo").agg(F.count(F.lit(1)).alias("all"))
    own = rows.where(soft).groupBy("repo", "package").agg(F.count(F.lit(1)).alias("own"))
    return (
        rows.where(F.col("category").isin("copyleft", "restrictive"))
        .join(totals, "repo").join(own, ["repo", "package"], "left")
        .select("repo", "package", "license", F.col("category").alias("kind"),
                (F.col("all") - F.coalesce("own", F.lit(0))).alias("conflicts"))
        .where(F.col("conflicts") > 0)
    )


# --- SBOM ----------------------------------------------------------------------------


def sbom(deps: DataFrame, fmt: str = "spdx", tool: str = "tallyforge", created: str = "") -> DataFrame:
    """Document lines (repo, seq, text): concatenating a repo's lines by seq gives its document.

    spdx: SPDX 2.3 tag/value blocks. cyclonedx: CycloneDX 1.5 JSON, one component per line.
    """
    rows = numbered(deps, "repo", ["name", "version", "ecosystem", "manifest"])
    version = F.when(F.col("version") == "*", "0.0.0").otherwise(F.col("version"))
    repos = deps.select("repo").distinct()
    last = F.lit(9223372036854775807)
    if fmt == "spdx":
        head = F.concat_ws(
            "\n", F.lit("SPDXVersion: SPDX-2.3"), F.lit("DataLicense: CC0-1.0"), F.lit("SPDXID: SPDXRef-DOCUMENT"),
            F.concat(F.lit("DocumentName: "), "repo"),
            F.concat(F.lit("DocumentNamespace: https://spdx.org/spdxdocs/"), "repo", F.lit("-" + created[:10])),
            F.lit(f"Created: {created}"), F.lit(f"Creator: Tool: {tool}"), F.lit("\n## Packages\n"))
        none = [f"{k}: NOASSERTION" for k in
                ("PackageLicenseConcluded", "PackageLicenseDeclared", "PackageCopyrightText")]
        body = F.concat_ws(
            "\n", F.concat(F.lit("PackageName: "), "name"),
            F.concat(F.lit("SPDXID: SPDXRef-Package-"), F.col("seq").cast("string")),
            F.concat(F.lit("PackageVersion: "), version), F.lit("PackageDownloadLocation: NOASSERTION"),
            F.lit("FilesAnalyzed: false"), *[F.lit(x) for x in none], F.lit(""))
        return repos.select("repo", F.lit(0).cast("bigint").alias("seq"), head.alias("text")).unionByName(
            rows.select("repo", "seq", body.alias("text")))
    if fmt != "cyclonedx":
        raise ValueError(f"unknown format {fmt}")
    meta = F.to_json(F.struct(
        F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.lit(1).alias("version"),
        F.struct(F.struct(F.lit("application").alias("type"), F.col("repo").alias("name")).alias("component")).alias("metadata")))
    head = F.concat(F.regexp_replace(meta, r"\}$", ""), F.lit(',"components":['))
    comp = F.to_json(F.struct(
        F.lit("library").alias("type"), "name", version.alias("version"),
        F.concat(F.lit("pkg:"), "ecosystem", F.lit("/"), "name", F.lit("@"), version).alias("purl"),
        F.concat(F.lit("pkg-"), F.col("seq").cast("string")).alias("bom-ref")))
    body = F.concat(F.when(F.col("seq") > 1, ",").otherwise(""), comp)
    return (
        repos.select("repo", F.lit(0).cast("bigint").alias("seq"), head.alias("text"))
        .unionByName(rows.select("repo", "seq", body.alias("text")))
        .unionByName(repos.select("repo", last.alias("seq"), F.lit("]}").alias("text")))
    )


# --- bundles -------------------------------------------------------------------------


def gzip_size(size: Column) -> Column:
    return half_up(size * F.lit(P.GZIP_SHARE)).cast("bigint")


def estimate_bundle(deps: DataFrame, sizes: dict[str, int] = P.PACKAGE_SIZES) -> DataFrame:
    """Estimated size per dependency from the known-size table."""
    size = lookup(sizes, F.col("name"), P.UNKNOWN_PACKAGE_SIZE)
    return deps.select("repo", "name", size.cast("bigint").alias("size")).withColumn(
        "gzip_size", gzip_size(F.col("size")))


def bundle_report(modules: DataFrame) -> DataFrame:
    """Per build: total size, total gzip, modules, duplicate names, large modules."""
    per_name = modules.groupBy("build", "name").agg(
        F.count(F.lit(1)).alias("_c"), F.sum("size").alias("_s"), F.sum("gzip_size").alias("_g"),
        F.count_if(F.col("size") > P.LARGE_BUNDLE).alias("_l"))
    return per_name.groupBy("build").agg(
        F.sum("_s").cast("bigint").alias("total_size"), F.sum("_g").cast("bigint").alias("total_gzip"),
        F.sum("_c").cast("bigint").alias("modules"), F.count_if(F.col("_c") > 1).alias("duplicates"),
        F.sum("_l").cast("bigint").alias("large"))


def duplicate_modules(modules: DataFrame) -> DataFrame:
    return (
        modules.groupBy("build", "name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    )


def largest_modules(modules: DataFrame, k: int | None = None) -> DataFrame:
    """Modules above the large-bundle size, biggest first."""
    rows = modules.where(F.col("size") > P.LARGE_BUNDLE)
    return rows if k is None else rows.orderBy(F.col("size").desc(), "build", "name").limit(k)


def compare_bundles(before: DataFrame, after: DataFrame) -> DataFrame:
    """Size change per module name; percent is 0 for modules that are new."""
    zero = F.lit(0).cast("bigint")
    b = before.groupBy("name").agg(F.max("size").alias("_b"))
    a = after.groupBy("name").agg(F.max("size").alias("_a"))
    return (
        b.join(a, "name", "full_outer")
        .select("name", F.coalesce("_b", zero).alias("before_size"), F.coalesce("_a", zero).alias("after_size"))
        .withColumn("diff", F.col("after_size") - F.col("before_size"))
        .withColumn("percent", F.when(
            F.col("before_size") > 0, half_up(F.col("diff") / F.col("before_size") * 100, 2)).otherwise(0.0))
    )


def largest_changes(diff: DataFrame, k: int) -> DataFrame:
    return diff.orderBy(F.abs("diff").desc(), "name").limit(k)
