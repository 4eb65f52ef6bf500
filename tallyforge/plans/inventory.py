"""Dependency, licence, SBOM and bundle queries over ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deps as D
from ..rules import packages as P
from ..sources import manifests as S
from . import bindings as B
from .bindings import define, lit_list, pick, with_sql
from .registry import query
from .scans import q

NAMES = [a[0] for a in P.ADVISORIES] + ["react", "vue", "chalk", "left-pad"]
K = len(NAMES)


def _base(t):
    pk = F.col("p_partkey")
    return t.part.select(
        "p_partkey", F.concat_ws("-", "p_type", F.replace("p_brand", F.lit("#"), F.lit(""))).alias("repo"),
        pick(NAMES, pk % K).alias("n1"), pick(NAMES, (pk * 3 + 1) % K).alias("n2"),
        F.concat_ws(".", (F.col("p_size") % 15).cast("string"), (pk % 25).cast("string"), (pk % 23).cast("string")).alias("ver"))


define("part_base", f"""
SELECT p_partkey, p_type || '-' || replace(p_brand, '#', '') AS repo,
  list_extract({lit_list(NAMES)}, (p_partkey % {K})::INT + 1) AS n1, list_extract({lit_list(NAMES)}, ((p_partkey * 3 + 1) % {K})::INT + 1) AS n2,
  (p_size % 15) || '.' || (p_partkey % 25) || '.' || (p_partkey % 23) AS ver FROM part""")


def manifest_files(t):
    """One manifest per part: npm, pip, go or cargo; every 97th npm file is broken JSON."""
    n1, n2, ver = F.col("n1"), F.col("n2"), F.col("ver")
    m = F.create_map
    npm = F.to_json(F.struct(
        m(n1, F.concat(F.lit("^"), ver)).alias("dependencies"), m(n2, F.concat(F.lit("~"), ver)).alias("devDependencies"),
        m(F.concat(F.lit("peer-"), n1), F.lit(">=1.0")).alias("peerDependencies")))
    pip = F.concat(F.lit("# pinned\n"), n1, F.lit("=="), ver, F.lit("\n-r other.txt\n\n  "), n2, F.lit("\nrequests >= 2.0\n"))
    go = F.concat(F.lit("module x\nrequire example.com/"), n1, F.lit(" v"), ver, F.lit("\nrequire (\n\tother v1\n)\n"))
    cargo = F.concat(F.lit('[package]\nname = "x"\n[dependencies]\n'), n1, F.lit(' = "'), ver, F.lit('"\n'), n2,
                     F.lit(' = { version = "1" }\n  serde = "1.0"\n[dev-dependencies]\n'), n2, F.lit(' = "9.9"\n'))
    kind = F.col("p_partkey") % 4
    return _base(t).select(
        "repo", "p_partkey",
        F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit("/"),
                 pick(["package.json", "requirements.txt", "go.mod", "Cargo.toml"], kind)).alias("path"),
        F.when((kind == 0) & (F.col("p_partkey") % 97 == 0), "{oops")
        .when(kind == 0, npm).when(kind == 1, pip).when(kind == 2, go).otherwise(cargo).alias("content"))


define("dependencies", """
SELECT repo, n1 AS name, ver AS version, 'npm' AS ecosystem, 'm' || p_partkey || '/package.json' AS manifest FROM part_base WHERE p_partkey % 4 = 0 AND p_partkey % 97 <> 0 AND n1 <> n2
UNION ALL SELECT repo, n2, ver, 'npm', 'm' || p_partkey || '/package.json' FROM part_base WHERE p_partkey % 4 = 0 AND p_partkey % 97 <> 0
UNION ALL SELECT repo, n1, ver, 'pip', 'm' || p_partkey || '/requirements.txt' FROM part_base WHERE p_partkey % 4 = 1
UNION ALL SELECT repo, n2, '*', 'pip', 'm' || p_partkey || '/requirements.txt' FROM part_base WHERE p_partkey % 4 = 1
UNION ALL SELECT repo, 'requests', '2.0', 'pip', 'm' || p_partkey || '/requirements.txt' FROM part_base WHERE p_partkey % 4 = 1
UNION ALL SELECT repo, 'example.com/' || n1, 'v' || ver, 'go', 'm' || p_partkey || '/go.mod' FROM part_base WHERE p_partkey % 4 = 2
UNION ALL SELECT repo, n1, ver, 'cargo', 'm' || p_partkey || '/Cargo.toml' FROM part_base WHERE p_partkey % 4 = 3
UNION ALL SELECT repo, 'serde', '1.0', 'cargo', 'm' || p_partkey || '/Cargo.toml' FROM part_base WHERE p_partkey % 4 = 3""", ("part_base",))


@query("manifest_dependencies", with_sql("dependencies", "SELECT * FROM dependencies"))
def manifest_dependencies(t):
    return S.read_dependencies(manifest_files(t))


@query("manifest_dependency_kinds", with_sql("part_base", """
, b AS (SELECT * FROM part_base WHERE p_partkey % 4 = 0 AND p_partkey % 97 <> 0)
SELECT repo, n1 AS name, '^' || ver AS version, 'dependencies' AS kind FROM b UNION ALL
SELECT repo, n2, '~' || ver, 'devDependencies' FROM b UNION ALL SELECT repo, 'peer-' || n1, '>=1.0', 'peerDependencies' FROM b"""))
def manifest_dependency_kinds(t):
    return S.read_dependency_kinds(manifest_files(t))


@query("codebase_totals", with_sql("lang_files part_base", """
, f AS (SELECT repo, count(*) AS total_files, sum(n_lines)::BIGINT AS total_lines, sum(strlen(content))::BIGINT AS total_bytes FROM lang_files WHERE language IS NOT NULL GROUP BY 1),
d AS (SELECT 'src' || (p_partkey % 23) AS repo, count(*) * 2 AS dependencies, count(*) AS dev_dependencies FROM part_base WHERE p_partkey % 4 = 0 AND p_partkey % 97 <> 0 GROUP BY 1)
SELECT repo, coalesce(total_files, 0) AS total_files, coalesce(total_lines, 0) AS total_lines, coalesce(total_bytes, 0) AS total_bytes,
  coalesce(dependencies, 0) AS dependencies, coalesce(dev_dependencies, 0) AS dev_dependencies FROM f FULL JOIN d USING (repo)"""))
def codebase_totals(t):
    from ..operators.codestats import codebase_totals as totals

    files = manifest_files(t).withColumn("repo", F.concat(F.lit("src"), (F.col("p_partkey") % 23).cast("string")))
    return totals(B.code_files(t), S.read_dependency_kinds(files))


_ADV = ", ".join(f"({q(a)}, {q(b)}, {q(c)}, {q(d)}, {q(e)}, {f}::DOUBLE)" for a, b, c, d, e, f in P.ADVISORIES)
define("advisories", f"SELECT * FROM (VALUES {_ADV}) a(package, id, severity, title, fixed_in, cvss)")
# zero-padded numeric comparison; a deciding part that is not numeric is never less
_LT = """(SELECT coalesce((list_filter(list_transform(generate_series(1, greatest(len(p), len(f))),
   lambda i: CASE WHEN i > len(p) THEN 0.0 ELSE TRY_CAST(p[i] AS DOUBLE) END - CASE WHEN i > len(f) THEN 0.0 ELSE TRY_CAST(f[i] AS DOUBLE) END),
   lambda d: d IS NULL OR d <> 0))[1] < 0, false) FROM (SELECT string_split(version, '.') AS p, string_split(fixed_in, '.') AS f))"""
define("vulns", f"""
SELECT repo, package, version, ecosystem, id, severity, title, fixed_in, cvss
FROM dependencies JOIN advisories ON name = package WHERE {_LT}""", ("dependencies", "advisories"))


def vulns(t):
    return D.vuln_match(S.read_dependencies(manifest_files(t)), D.advisories(t.spark))


@query("vulnerable_dependencies", with_sql("vulns", "SELECT * FROM vulns"))
def vulnerable_dependencies(t):
    return vulns(t)


@query("merged_advisories", with_sql("vulns dependencies", """
, x AS (SELECT DISTINCT repo, name AS package, CASE WHEN length(name) % 2 = 0 THEN 'CVE-2021-23337' ELSE 'AUDIT-' || name END AS id,
          CASE length(name) % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' ELSE 'MEDIUM' END AS severity FROM dependencies WHERE ecosystem = 'npm')
SELECT repo, package, id, severity, version FROM vulns UNION ALL
SELECT repo, package, id, severity, NULL FROM x WHERE NOT EXISTS (SELECT 1 FROM vulns v WHERE v.repo = x.repo AND v.package = x.package AND v.id = x.id)"""))
def merged_advisories(t):
    """External audit rows derived from the npm packages, some already known."""
    deps = S.read_dependencies(manifest_files(t))
    size = F.length("name")
    audit = deps.where("ecosystem = 'npm'").select(
        "repo", F.col("name").alias("package"),
        F.when(size % 2 == 0, "CVE-2021-23337").otherwise(F.concat(F.lit("AUDIT-"), "name")).alias("id"),
        pick(["critical", "high", "moderate", "low", "odd"], size % 5).alias("severity")).distinct()
    return D.merge_advisories(D.vuln_match(deps, D.advisories(t.spark)), audit).select(
        "repo", "package", "id", "severity", "version")


@query("vulnerability_counts", with_sql("vulns", """
SELECT s AS severity, count(id) AS n FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) v(s) LEFT JOIN vulns ON severity = s GROUP BY 1"""))
def vulnerability_counts(t):
    return D.vuln_rollup(vulns(t))


@query("ranked_vulnerabilities", with_sql("vulns", """
SELECT repo, package, id, severity FROM vulns"""))
def ranked_vulnerabilities(t):
    return D.rank_sort(vulns(t), "severity", P.SEVERITIES, "repo", "package", "version", "ecosystem").select(
        "repo", "package", "id", "severity")


@query("dependency_risk", with_sql("part_base", """
, b AS (SELECT repo, CASE p_partkey % 3 WHEN 0 THEN '@types/' || n1 WHEN 1 THEN 'jest-' || n1 ELSE n1 END AS name,
  CASE p_partkey % 4 WHEN 0 THEN '^' || ver WHEN 1 THEN '~' || ver WHEN 2 THEN ver ELSE '*' END AS version FROM part_base)
SELECT repo, name, version, CASE WHEN NOT regexp_matches(version, '^[\\^~>=<*]') THEN 'low' WHEN version LIKE '~%' THEN 'medium' ELSE 'high' END AS pin_risk,
  CASE WHEN name LIKE '@types/%' THEN 'high' WHEN name LIKE 'jest-%' THEN 'medium' ELSE 'low' END AS trust_risk FROM b""".replace("\\\\", "\\")))
def dependency_risk(t):
    pk = F.col("p_partkey")
    rows = _base(t).select(
        "repo",
        F.when(pk % 3 == 0, F.concat(F.lit("@types/"), "n1")).when(pk % 3 == 1, F.concat(F.lit("jest-"), "n1")).otherwise(F.col("n1")).alias("name"),
        F.when(pk % 4 == 0, F.concat(F.lit("^"), "ver")).when(pk % 4 == 1, F.concat(F.lit("~"), "ver")).when(pk % 4 == 2, F.col("ver")).otherwise("*").alias("version"))
    return rows.withColumns({"pin_risk": D.pin_risk(F.col("version")), "trust_risk": D.trust_risk(F.col("name"))})


# --- licences ------------------------------------------------------------------------

LIC = ["MIT", "GPL-3.0", "Apache-2.0", "MPL-2.0", "LGPL-4.0-draft", "UNKNOWN", "LicenseRef-x", "(MIT OR ISC)", "SSPL-1.0", "AGPL-9",
       "Proprietary", "BSD-3-Clause", ""]


def licenses(t):
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    return t.part.select(F.col("p_type").alias("repo"), F.col("p_name").alias("package"), pick(LIC, brand % len(LIC)).alias("license"))


define("licenses", f"""
SELECT p_type AS repo, p_name AS package, list_extract({lit_list(LIC)}, regexp_extract(p_brand, '(\\d+)', 1)::INT % {len(LIC)} + 1) AS license FROM part""")
_CAT = """CASE license WHEN 'MIT' THEN 'permissive' WHEN 'GPL-3.0' THEN 'copyleft' WHEN 'Apache-2.0' THEN 'permissive' WHEN 'MPL-2.0' THEN 'restrictive'
 WHEN 'LGPL-4.0-draft' THEN '{lgpl}' WHEN '(MIT OR ISC)' THEN 'permissive' WHEN 'SSPL-1.0' THEN 'restrictive' WHEN 'AGPL-9' THEN 'copyleft'
 WHEN 'BSD-3-Clause' THEN 'permissive' ELSE 'unknown' END"""
define("cat_licenses", f"SELECT *, {_CAT.format(lgpl='restrictive')} AS category FROM licenses", ("licenses",))


@query("license_categories", with_sql("licenses", f"""
SELECT license, {_CAT.format(lgpl='restrictive')} AS category, {_CAT.format(lgpl='copyleft')} AS compat_category, count(*) AS n FROM licenses GROUP BY ALL"""))
def license_categories(t):
    lic = F.col("license")
    return licenses(t).groupBy("license", D.license_category(lic).alias("category"),
                               D.license_category(lic, True).alias("compat_category")).agg(F.count(F.lit(1)).alias("n"))


@query("license_rollup", with_sql("cat_licenses", """
SELECT 'license' AS dim, coalesce(nullif(license, ''), 'UNKNOWN') AS key, count(*) AS n FROM cat_licenses GROUP BY 2
UNION ALL SELECT 'category', category, count(*) FROM cat_licenses GROUP BY 2"""))
def license_rollup(t):
    return D.license_rollup(licenses(t))


@query("license_conflicts", with_sql("cat_licenses", """
SELECT a.repo, a.category AS kind, a.license AS license1, b.license AS license2, count(*) AS package_pairs
FROM cat_licenses a JOIN cat_licenses b ON a.repo = b.repo AND a.package <> b.package
WHERE a.category IN ('copyleft', 'restrictive') AND b.category = 'permissive' GROUP BY ALL"""))
def license_conflicts(t):
    return D.license_conflicts(licenses(t))


@query("conflicting_packages", with_sql("cat_licenses", """
, p AS (SELECT repo, package, count(*) AS n FROM cat_licenses WHERE category = 'permissive' GROUP BY ALL), s AS (SELECT repo, sum(n)::BIGINT AS n FROM p GROUP BY 1)
SELECT a.repo, a.package, a.license, a.category AS kind, s.n - coalesce(p.n, 0) AS conflicts FROM cat_licenses a JOIN s ON s.repo = a.repo
LEFT JOIN p ON p.repo = a.repo AND p.package = a.package WHERE a.category IN ('copyleft', 'restrictive') AND s.n - coalesce(p.n, 0) > 0"""))
def conflicting_packages(t):
    return D.conflicting_packages(licenses(t))


def lock_files(t):
    n1, n2, ver = F.col("n1"), F.col("n2"), F.col("ver")
    odd = F.col("p_partkey") % 2 == 1

    def entry(*cols):
        return F.to_json(F.struct(ver.alias("version"), *cols))

    plain = entry(F.lit("MIT").alias("license"))
    typed = entry(F.struct(F.lit("ISC").alias("type")).alias("license"))
    listed = entry(F.array(F.struct(F.lit("GPL-3.0").alias("type"))).alias("licenses"))
    text = F.concat(F.lit('{"packages":{"":{"name":"root"},"node_modules/'), n1, F.lit('":'), plain, F.lit(',"node_modules/@s/'), n2, F.lit('":'), typed,
                    F.lit('},"dependencies":{"'), n1, F.lit('":'), listed, F.lit(',"zz":'), F.when(odd, listed).otherwise(entry(F.lit(7).alias("license"))), F.lit("}}"))
    return B.dealt(_base(t), "p_partkey").select(F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("repo"),
                           F.lit("package-lock.json").alias("path"), text.alias("content"))


@query("lockfile_licenses", with_sql("part_base", """
SELECT 'r' || p_partkey AS repo, n1 AS package, ver AS version, 'MIT' AS license FROM part_base WHERE n1 <> n2
UNION ALL SELECT 'r' || p_partkey, n2, ver, 'ISC' FROM part_base
UNION ALL SELECT 'r' || p_partkey, 'zz', ver, CASE WHEN p_partkey % 2 = 1 THEN 'GPL-3.0' ELSE 'UNKNOWN' END FROM part_base"""))
def lockfile_licenses(t):
    return S.read_licenses(lock_files(t)).select("repo", "package", "version", "license")


@query("pip_licenses", with_sql("part_base", """
SELECT repo, n1 AS package, 'UNKNOWN' AS license FROM part_base WHERE p_partkey % 4 = 1 UNION ALL SELECT repo, n2, 'UNKNOWN' FROM part_base WHERE p_partkey % 4 = 1
UNION ALL SELECT repo, 'requests', 'Apache-2.0' FROM part_base WHERE p_partkey % 4 = 1"""))
def pip_licenses(t):
    return S.read_pip_licenses(manifest_files(t)).select("repo", "package", "license")


# --- SBOM and bundles ----------------------------------------------------------------

define("numbered_deps", """
SELECT *, row_number() OVER (PARTITION BY repo ORDER BY name, version, ecosystem, manifest) AS seq,
  CASE WHEN version = '*' THEN '0.0.0' ELSE version END AS v FROM dependencies""", ("dependencies",))


@query("sbom_spdx", with_sql("numbered_deps", """
, r AS (SELECT DISTINCT repo FROM dependencies)
SELECT repo, 0::BIGINT AS seq, concat_ws(chr(10), 'SPDXVersion: SPDX-2.3', 'DataLicense: CC0-1.0', 'SPDXID: SPDXRef-DOCUMENT', 'DocumentName: ' || repo,
  'DocumentNamespace: https://spdx.org/spdxdocs/' || repo || '-2025-01-01', 'Created: 2025-01-01T00:00:00Z', 'Creator: Tool: tallyforge', chr(10) || '## Packages' || chr(10)) AS text FROM r
UNION ALL SELECT repo, seq, concat_ws(chr(10), 'PackageName: ' || name, 'SPDXID: SPDXRef-Package-' || seq, 'PackageVersion: ' || v, 'PackageDownloadLocation: NOASSERTION',
  'FilesAnalyzed: false', 'PackageLicenseConcluded: NOASSERTION', 'PackageLicenseDeclared: NOASSERTION', 'PackageCopyrightText: NOASSERTION', '') FROM numbered_deps"""))
def sbom_spdx(t):
    return D.sbom(S.read_dependencies(manifest_files(t)), "spdx", created="2025-01-01T00:00:00Z")


@query("sbom_cyclonedx", with_sql("numbered_deps", """
, r AS (SELECT DISTINCT repo FROM dependencies)
SELECT repo, 0::BIGINT AS seq, '{"bomFormat":"CycloneDX","specVersion":"1.5","version":1,"metadata":{"component":{"type":"application","name":"' || repo || '"}},"components":[' AS text FROM r
UNION ALL SELECT repo, seq, CASE WHEN seq > 1 THEN ',' ELSE '' END || '{"type":"library","name":"' || name || '","version":"' || v || '","purl":"pkg:' || ecosystem || '/' || name || '@' || v || '","bom-ref":"pkg-' || seq || '"}' FROM numbered_deps
UNION ALL SELECT repo, 9223372036854775807, ']}' FROM r"""))
def sbom_cyclonedx(t):
    return D.sbom(S.read_dependencies(manifest_files(t)), "cyclonedx")


@query("estimated_bundle", with_sql("dependencies", f"""
SELECT repo, name, coalesce(s, 5000)::BIGINT AS size, floor(coalesce(s, 5000) * 0.3::DOUBLE + 0.5::DOUBLE)::BIGINT AS gzip_size
FROM dependencies LEFT JOIN (VALUES {", ".join(f"({q(k)}, {v})" for k, v in P.PACKAGE_SIZES.items())}) z(n, s) ON n = name WHERE ecosystem = 'npm'"""))
def estimated_bundle(t):
    return D.estimate_bundle(S.read_npm(manifest_files(t)))


def modules(t):
    size = F.floor(F.col("p_retailprice") * 110).cast("bigint")
    return t.part.select(
        F.col("p_brand").alias("build"), F.concat_ws("/", "p_name", "p_type").alias("name"),
        size.alias("size"), D.gzip_size(size).alias("gzip_size"), "p_partkey")


define("modules", """
SELECT p_brand AS build, p_name || '/' || p_type AS name, floor(p_retailprice * 110::DOUBLE)::BIGINT AS size,
  floor(floor(p_retailprice * 110::DOUBLE)::BIGINT * 0.3::DOUBLE + 0.5::DOUBLE)::BIGINT AS gzip_size, p_partkey FROM part""")


@query("bundle_report", with_sql("modules", """
, n AS (SELECT build, name, count(*) AS c, sum(size) AS s, sum(gzip_size) AS g, count(*) FILTER (size > 100000) AS l FROM modules GROUP BY ALL)
SELECT build, sum(s)::BIGINT AS total_size, sum(g)::BIGINT AS total_gzip, sum(c)::BIGINT AS modules, count(*) FILTER (c > 1) AS duplicates, sum(l)::BIGINT AS large FROM n GROUP BY 1"""))
def bundle_report(t):
    return D.bundle_report(modules(t))


@query("duplicate_modules", with_sql("modules", "SELECT build, name, count(*) AS n FROM modules GROUP BY ALL HAVING count(*) > 1"))
def duplicate_modules(t):
    return D.duplicate_modules(modules(t))


@query("largest_modules", with_sql("modules", """
SELECT build, name, size FROM modules WHERE size > 100000 ORDER BY size DESC, build, name LIMIT 25"""))
def largest_modules(t):
    return D.largest_modules(modules(t), 25).select("build", "name", "size")


define("bundle_diff", """
SELECT *, after_size - before_size AS diff, CASE WHEN before_size > 0 THEN floor((after_size - before_size)::DOUBLE / before_size::DOUBLE * 100::DOUBLE * 100::DOUBLE + 0.5::DOUBLE)::DOUBLE / 100::DOUBLE ELSE 0.0 END AS percent
FROM (SELECT name, coalesce(b.s, 0) AS before_size, coalesce(a.s, 0) AS after_size
 FROM (SELECT name, max(size) AS s FROM modules WHERE p_partkey % 3 <> 0 GROUP BY 1) b FULL JOIN (SELECT name, max(size + p_partkey) AS s FROM modules WHERE p_partkey % 5 <> 0 GROUP BY 1) a USING (name))""", ("modules",))


def bundle_diff(t):
    m = modules(t)
    after = m.where("p_partkey % 5 <> 0").withColumn("size", F.col("size") + F.col("p_partkey"))
    return D.compare_bundles(m.where("p_partkey % 3 <> 0"), after)


@query("bundle_changes", with_sql("bundle_diff", "SELECT * FROM bundle_diff"))
def bundle_changes(t):
    return bundle_diff(t)


@query("largest_bundle_changes", with_sql("bundle_diff", "SELECT name, diff FROM bundle_diff ORDER BY abs(diff) DESC, name LIMIT 10"))
def largest_bundle_changes(t):
    return D.largest_changes(bundle_diff(t), 10).select("name", "diff")
