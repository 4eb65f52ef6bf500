"""Project profiles and consistency: features per file, dominant patterns, violations, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.maths import half_up
from ..functions.rx import ascii_bounds
from ..functions.text import captures, identifiers, imports_of, naming_style, used_libraries
from ..rules import style as S, words
from ..sources.files import base_name, extension
from .codestats import language_of
from .history import first_rows


def _count(content: Column, patterns: tuple[str, ...]) -> Column:
    total = F.lit(0)
    for p in patterns:
        total = total + F.regexp_count(content, F.lit(ascii_bounds(p)))
    return total


def file_features(files: DataFrame) -> DataFrame:
    """One wide row per file: pattern counts, used libraries, extension; texts are read once."""
    content = F.col("content")
    ext = extension(F.col("path"))
    counts = [_count(content, p).alias(name) for name, p in S.COUNTS.items()]
    arrow = F.when(ext.isin(*S.ARROW_EXTENSIONS), _count(content, (S.ARROW_COMPONENT,))).otherwise(0)
    return files.select(
        "repo", "path", ext.alias("ext"), *counts, arrow.alias("arrow_components"),
        used_libraries(content).alias("libs"))


def naming_profile(files: DataFrame) -> DataFrame:
    """Dominant naming style per (repo, language); the earlier style wins a tie."""
    content = F.col("content")
    names = F.concat(*[captures(content, p) for p in S.NAME_PATTERNS])
    styled = files.withColumn("language", language_of(F.col("path"))).where(F.col("language").isNotNull()).select(
        "repo", "language", F.transform(names, naming_style).alias("_s"), _count(content, (S.CLASS_NAME,)).alias("_cls"))
    sums = styled.groupBy("repo", "language").agg(*[
        F.sum(F.size(F.filter("_s", lambda x: x == s)) + (F.col("_cls") if s == "PascalCase" else 0)).alias(s)
        for s in S.STYLES])
    best = F.array_max(F.array(*[
        F.struct(F.col(s).alias("n"), F.lit(-i).alias("rank"), F.lit(s).alias("style")) for i, s in enumerate(S.STYLES)]))
    return sums.withColumn("_b", best).where(F.col("_b.n") > 0).select("repo", "language", F.col("_b.style").alias("style"))


def _layout(files: DataFrame) -> DataFrame:
    dirs = files.where(F.contains("path", F.lit("/"))).select("repo", F.substring_index("path", "/", 1).alias("d")).distinct()
    return dirs.where(~F.col("d").isin(*words.SKIP_DIRS)).groupBy("repo").agg(
        F.count(F.lit(1)).alias("dirs"), F.count_if(F.col("d").rlike(S.FEATURE_DIR)).alias("feature_dirs"),
        F.count_if(F.col("d").rlike(S.TYPE_DIR)).alias("type_dirs"))


def preferred_libs(features: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most used libraries per repo as one array."""
    counts = features.select("repo", F.explode("libs").alias("lib")).groupBy("repo", "lib").agg(F.count(F.lit(1)).alias("n"))
    top = first_rows(counts, ["repo"], [F.col("n").desc(), F.col("lib")], k)
    return top.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "lib"))).alias("_l")).select(
        "repo", F.transform("_l", lambda x: x["lib"]).alias("preferred_libs"))


def pattern_profile(files: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Import, error, layout, component and test style per repo plus preferred libraries."""
    features = file_features(files) if features is None else features
    names = [*S.COUNTS, "arrow_components"]
    sums = features.groupBy("repo").agg(*[F.sum(c).alias(c) for c in names])
    c = {n: F.coalesce(F.col(n), F.lit(0)) for n in names}

    def share(part: Column, total: Column) -> Column:
        return F.when(total > 0, part / total).otherwise(0.0)

    imports = c["default_imports"] + c["named_imports"]
    d = share(c["default_imports"], imports)
    import_style = F.when(imports == 0, "mixed").when(d > 0.7, "default").when(d < 0.3, "named").otherwise("mixed")
    errs = c["try_catch"] + c["callback"] + c["result_type"]
    error_style = (
        F.when(share(c["try_catch"], errs) > 0.7, "try-catch")
        .when((c["callback"] > c["result_type"]) & (share(c["callback"], errs) > 0.5), "callback")
        .when((c["result_type"] > c["callback"]) & (share(c["result_type"], errs) > 0.5), "result-type").otherwise("mixed"))
    comps = c["function_components"] + c["class_components"] + c["arrow_components"]
    component = (
        F.when(share(c["function_components"], comps) > 0.6, "function").when(share(c["class_components"], comps) > 0.6, "class")
        .when(share(c["arrow_components"], comps) > 0.6, "arrow-function").otherwise("mixed"))
    a, b, e = c["describe_it"], c["test_global"], c["asserts"]
    test = (
        F.when((a > b) & (a > e), "describe-it").when((b > a) & (b > e), "test").when((e > a) & (e > b), "assert").otherwise("mixed"))
    dirs = F.coalesce("dirs", F.lit(0))
    layout = (
        F.when(dirs == 0, "mixed").when(share(F.col("feature_dirs"), dirs) > 0.5, "feature-based")
        .when(share(F.col("type_dirs"), dirs) > 0.5, "type-based").when(dirs < 3, "flat").otherwise("mixed"))
    return (
        sums.join(_layout(files), "repo", "left").join(preferred_libs(features), "repo", "left")
        .select("repo", import_style.alias("import_style"), error_style.alias("error_handling"), layout.alias("file_organization"),
                component.alias("component_structure"), test.alias("test_pattern"),
                F.coalesce("preferred_libs", F.array().cast("array<string>")).alias("preferred_libs"))
    )


_VIOLATION = ("line", "category", "severity", "actual", "expected")


def _violation(cond: Column, category: str, severity: str, actual: Column, expected: Column | str) -> Column:
    expected = F.lit(expected) if isinstance(expected, str) else expected
    return F.when(cond, F.struct(F.lit(1).alias("line"), F.lit(category).alias("category"), F.lit(severity).alias("severity"),
                                 actual.alias("actual"), expected.alias("expected")))


def _n(col: str, what: str) -> Column:
    return F.concat(F.col(col).cast("string"), F.lit(f" {what}"))


def style_violations(features: DataFrame, profile: DataFrame) -> DataFrame:
    """Import, error, component, test and library violations: rows per file and rule."""
    f = features.join(profile, "repo")
    c = F.col
    checks = [
        _violation((c("import_style") == "named") & (c("default_imports") > c("named_imports")), "import-style", "warning",
                   _n("default_imports", "default imports"), "named imports"),
        _violation((c("import_style") == "default") & (c("named_imports") > c("default_imports")), "import-style", "warning",
                   _n("named_imports", "named imports"), "default imports"),
        _violation((c("error_handling") == "try-catch") & (c("callback") > c("try_catch")), "error-handling", "warning",
                   _n("callback", "callback patterns"), "try/catch"),
        _violation((c("error_handling") == "result-type") & (c("try_catch") > c("result_type")), "error-handling", "info",
                   _n("try_catch", "try/catch blocks"), "Result type"),
        _violation(c("ext").isin(*S.ARROW_EXTENSIONS) & (c("component_structure") == "function") & (c("class_components") > c("function_components")),
                   "component-structure", "warning", _n("class_components", "class declarations"), "function declarations"),
        _violation(c("ext").isin(*S.ARROW_EXTENSIONS) & (c("component_structure") == "arrow-function") & (c("function_components") > c("arrow_components")),
                   "component-structure", "info", _n("function_components", "function declarations"), "arrow functions"),
        _violation(base_name(c("path")).rlike(S.TEST_FILE) & (c("test_pattern") == "describe-it") & (c("test_global") > c("describe_it")),
                   "test-pattern", "warning", _n("test_global", "test() calls"), "describe/it pattern"),
    ]

    def replacement(lib: Column) -> Column:
        out = F.lit(None).cast("string")
        for preferred, alts in reversed(list(S.ALTERNATIVES.items())):
            out = F.when(lib.isin(*alts) & F.array_contains("preferred_libs", preferred), preferred).otherwise(out)
        return out

    def lib_row(lib: Column, expected: Column) -> Column:
        return F.struct(F.lit(1).alias("line"), F.lit("lib-preference").alias("category"), F.lit("info").alias("severity"),
                        lib.alias("actual"), expected.alias("expected"))

    strange = F.filter("libs", lambda x: ~F.array_contains("preferred_libs", x))
    libs = F.when(F.size("preferred_libs") > 0, F.concat(
        F.filter(F.transform(strange, lambda x: F.when(replacement(x).isNotNull(), lib_row(x, replacement(x)))), lambda s: s.isNotNull()),
        F.transform(strange, lambda x: lib_row(x, F.array_join("preferred_libs", " or ")))))
    found = F.filter(F.array(*checks), lambda s: s.isNotNull())
    rows = F.when(libs.isNull(), found).otherwise(F.concat(found, libs))
    return f.select("repo", "path", F.explode(rows).alias("_v")).select("repo", "path", *[f"_v.{x}" for x in _VIOLATION])


def naming_violations(lines: DataFrame, naming: DataFrame) -> DataFrame:
    """Class names without capital under PascalCase, Pascal constants under camelCase."""
    text = F.col("text")
    classes = F.filter(captures(text, r"\bclass\s+([a-zA-Z_$][\w$]*)"), lambda n: ~n.rlike("^[A-Z]"))
    consts = F.filter(captures(text, r"\bconst\s+([A-Z][a-zA-Z0-9]+)\s*[=:]"), lambda n: ~n.rlike("^[A-Z0-9_]+$"))
    names = F.when(F.col("style") == "PascalCase", F.transform(
        classes, lambda n: F.struct(F.lit("error").alias("severity"), n.alias("actual"),
                                    F.concat(F.upper(F.left(n, F.lit(1))), F.substring(n, 2, 2147483647)).alias("expected")))
    ).when(F.col("style") == "camelCase", F.transform(
        consts, lambda n: F.struct(F.lit("warning").alias("severity"), n.alias("actual"),
                                   F.concat(F.lower(F.left(n, F.lit(1))), F.substring(n, 2, 2147483647)).alias("expected"))))
    marked = lines.where(text.contains("class") | text.contains("const")).withColumn("language", language_of(F.col("path")))
    return (
        marked.join(naming, ["repo", "language"])
        .select("repo", "path", "line", F.lit("naming").alias("category"), F.explode(names).alias("_v"))
        .select("repo", "path", "line", "category", "_v.severity", "_v.actual", "_v.expected")
    )


def suggest_fix(violations: DataFrame) -> DataFrame:
    """Adds a fix sentence per category."""
    c, a, e = F.col("category"), F.col("actual"), F.col("expected")
    fix = (
        F.when(c == "naming", F.format_string('rename "%s" to "%s"', a, e))
        .when(c == "lib-preference", F.format_string('import "%s" instead of "%s"', e, a))
        .when(c.isin("import-style", "error-handling", "component-structure", "test-pattern"), F.format_string("use %s here", e))
        .otherwise("align with the project profile"))
    return violations.withColumn("fix", fix)


def violation_rollup(violations: DataFrame) -> DataFrame:
    return (
        violations.groupingSets([["repo", "category"], ["repo", "severity"]], "repo", "category", "severity")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping("category").alias("_g"))
        .select("repo", F.when(F.col("_g") == 0, "category").otherwise("severity").alias("dim"),
                F.coalesce("category", "severity").alias("key"), "n")
    )


def consistency_score(violations: DataFrame, profiles: DataFrame, now: Column) -> DataFrame:
    """100 minus weighted deductions, scaled by profile age up to seven days; clamped to 0..100.

    profiles(repo, created_at).
    """
    points = F.lit(0)
    for sev, p in S.DEDUCTIONS.items():
        points = F.when(F.col("severity") == sev, p).otherwise(points)
    sums = violations.groupBy("repo").agg(F.sum(points).alias("_d"), F.count(F.lit(1)).alias("violations"))
    age = F.floor((F.unix_micros(now) - F.unix_micros("created_at")) / F.lit(86_400_000_000))
    factor = F.least(age / F.lit(float(S.FULL_AGE_DAYS)), F.lit(1.0))
    score = half_up(F.lit(100.0) - F.coalesce("_d", F.lit(0)) * factor)
    return profiles.join(sums, "repo", "left").select(
        "repo", F.coalesce("violations", F.lit(0)).alias("violations"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).cast("bigint").alias("score"))


def source_consistency(files: DataFrame, by: tuple[str, ...] = ("repo",)) -> DataFrame:
    """Shares of exporting (40), typed (35) and documented (25) script files."""
    c = F.col("content")
    typed = c.contains("interface ") | c.contains("type ") | c.rlike(
        r":\s*(string|number|boolean|void|never|any|unknown|Record|Partial|Pick|Omit|Promise|Array|Map|Set)<")
    docs = c.contains("/**") | c.contains("// ") | c.contains(" * @")
    script = files.where(extension(F.col("path")).isin(".ts", ".js", ".tsx", ".jsx"))
    return script.groupBy(*by).agg(
        F.count(F.lit(1)).alias("files"),
        half_up(F.count_if(c.contains("export ")) / F.count(F.lit(1)) * 40 + F.count_if(typed) / F.count(F.lit(1)) * 35
                + F.count_if(docs) / F.count(F.lit(1)) * 25).cast("bigint").alias("score"))


def learn_edits(pairs: DataFrame) -> DataFrame:
    """Pattern and confidence learned from (id, before, after): naming, else imports, else error
    style, else a generic edit; unchanged or empty sides give no-change."""
    b, a = F.col("before"), F.col("after")
    base = pairs.select(
        "id", ((b == "") | (a == "") | b.isNull() | a.isNull() | (b == a)).alias("_same"),
        F.array_except(identifiers(a), identifiers(b)).alias("_new"), imports_of(b).alias("_ib"), imports_of(a).alias("_ia"),
        *[(_count(a, S.COUNTS[k]) - _count(b, S.COUNTS[k])).alias(f"_{k}") for k in ("try_catch", "callback", "result_type")],
    ).withColumn("_styles", F.transform("_new", naming_style)).withColumn(
        "_imp", F.filter("_ia", lambda x: ~F.array_contains("_ib", x)))
    order = F.array_distinct("_styles")
    best = F.array_max(F.transform(order, lambda s, i: F.struct(
        F.size(F.filter("_styles", lambda x: x == s)).alias("n"), (-i).alias("rank"), s.alias("style"))))
    n_def = F.size(F.filter("_imp", lambda x: x.rlike(r"^import\s+[A-Za-z_$][\w$]*\s+from")))
    n_named = F.size(F.filter("_imp", lambda x: x.contains("{")))
    t, c, r = F.col("_try_catch"), F.col("_callback"), F.col("_result_type")
    err = (
        F.when((t > 0) & (t >= c) & (t >= r), F.struct(F.lit("try-catch").alias("s"), F.lit(0.7).alias("c")))
        .when((c > 0) & (c >= t) & (c >= r), F.struct(F.lit("callback").alias("s"), F.lit(0.6).alias("c")))
        .when((r > 0) & (r >= t) & (r >= c), F.struct(F.lit("result-type").alias("s"), F.lit(0.6).alias("c"))))
    x = base.withColumns({"_b": best, "_def": n_def, "_named": n_named, "_err": err})
    naming = F.coalesce(F.col("_b.style") != "unknown", F.lit(False))
    total = F.col("_def") + F.col("_named")
    imp = total > 0
    default_wins = F.col("_def") > F.col("_named")
    style = F.when(default_wins, "default").otherwise("named")
    share = F.greatest("_def", "_named") / total
    name_conf = F.least(F.lit(0.5) + F.col("_b.n") / F.size("_new") * 0.5, F.lit(1.0))
    return x.select(
        "id",
        F.when(F.col("_same"), "no-change").when(naming, F.concat(F.lit("naming:"), "_b.style"))
        .when(imp, F.concat(F.lit("import:"), style)).when(F.col("_err").isNotNull(), F.concat(F.lit("error-handling:"), "_err.s"))
        .otherwise("generic-edit").alias("pattern"),
        F.when(F.col("_same"), 0.0).when(naming, half_up(name_conf, 4)).when(imp, half_up(share, 2))
        .when(F.col("_err").isNotNull(), F.col("_err.c")).otherwise(0.3).alias("confidence"))
