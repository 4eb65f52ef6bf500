import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyforge.functions import text as X, versions as V
from tallyforge.functions.rx import ascii_bounds, glob_regex
from tallyforge.rules import bugs, debt, style, words

PATTERNS = [p for v in (*debt.TYPE_PATTERNS.values(), *debt.SEVERITY_PATTERNS.values(), *style.COUNTS.values()) for p in v]
PATTERNS += [r.pattern for r in bugs.RULES] + list(words.DECLARATION_PATTERNS) + [style.CLASS_NAME, *style.NAME_PATTERNS]
PIECES = ["bug", "fix", "é", "12", " ", "\n", "(", ")", "{", "!.", "eval(", "class Foo", "test (", "Result", "Ok", "_", "throw null", "const a ="]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), min_size=1, max_size=8))
def test_boundaries_keep_their_meaning(parts):
    text = "".join(parts)
    for p in PATTERNS:
        assert [m.span() for m in re.finditer(p, text, re.A)] == [m.span() for m in re.finditer(ascii_bounds(p), text, re.A)], p


def test_globs():
    assert re.match(glob_regex("src/**/*.ts"), "src/a/b.ts") and re.match(glob_regex("src/**/*.ts"), "src/b.ts")
    assert not re.match(glob_regex("*.ts"), "a/b.ts") and re.match(glob_regex("lib/**"), "lib/x/y.js")


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def test_versions(spark):
    cases = [("4.17.20", "4.17.21", True), ("4.17.21", "4.17.21", False), ("1.2", "1.2.0", False), ("1.x.0", "2.0", True), ("1.x", "1.2", False), ("10.0", "9.9", False), ("1", "1.0.1", True)]
    for a, b, want in cases:
        assert one(spark, V.version_lt(F.lit(a), F.lit(b))) is want, (a, b)
    for raw, want in (("^4.17.20", "4.17.20"), ("~1.0", "1.0"), (">=2.1", "2.1"), ("1.0", "1.0")):
        assert one(spark, V.strip_range(F.lit(raw))) == want


def test_names(spark):
    for name, want in (("FooBar", "PascalCase"), ("fooBar", "camelCase"), ("foo_bar", "snake_case"), ("foo-bar", "kebab-case"), ("FOO_BAR", "UPPER_CASE"), ("_x", "unknown")):
        assert one(spark, X.naming_style(F.lit(name))) == want
    assert one(spark, X.kebab(F.lit("  Hello, big World! "))) == "hello-big-world"
    assert one(spark, X.sanitize_id(F.lit("9 a-b"))) == "_9_a_b"


def test_commit_parts(spark):
    p = one(spark, X.commit_parts(F.lit("feat(auth)!: add login\n\nbody")))
    assert (p["valid"], p["type"], p["scope"], p["breaking"], p["subject"]) == (True, "feat", "auth", True, "add login")
    assert one(spark, X.commit_parts(F.lit("Merge branch x")))["valid"] and not one(spark, X.commit_parts(F.lit("oops")))["valid"]


def test_topic(spark):
    assert one(spark, X.topic(F.lit("Error: cannot open /a/b.txt while parsing config file config"))) == "open_parsing_config_file"
    assert one(spark, X.topic(F.lit("failed the"))) == "general_operations"


def test_compaction(spark):
    code = "// gone\nlet url = 'http://x'; // gone\n/* a\nb */\n\n\n\nlet aVeryLongIdentifierNameHere = 1;"
    got = one(spark, X.compact_code(F.lit(code), F.lit("typescript")))
    assert "gone" not in got and "http://x" in got and "aVeryLongIdentifie…" in got and "\n\n\n" not in got
    long = "\n".join(map(str, range(501)))
    assert "[1 lines collapsed]" in one(spark, X.compact_prose(F.lit(long))) and one(spark, X.compact_prose(F.lit("a\nb"))) == "a\nb"


def test_entropy(spark):
    assert one(spark, X.shannon_entropy(F.lit("aaaa"))) == 0.0
    assert one(spark, X.shannon_entropy(F.lit("abcd"))) == 2.0
    assert one(spark, X.shannon_entropy(F.lit(""))) == 0.0


def test_jaccard(spark):
    t = lambda s: X.tokens(F.lit(s))
    assert one(spark, X.jaccard(t("queue with redis"), t("redis queue now"))) == 0.5
    assert one(spark, X.jaccard(t("a b"), t("redis"))) == 0.0
