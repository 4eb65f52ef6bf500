"""Literal index: strings and patterns against brute force, with more rules than any plan could hold."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.functions.literals import required_literals
from tallyforge.operators import contain as C
from tallyforge.operators import experience as E
from tallyforge.operators import match as M
from tallyforge.rules.bugs import Rule

WORDS = ["disk", "host", "Timeout", "é", "ab", "x", "not found", "ENOENT", "429", "eval(", "\U0001f600"]


def texts(n, seed=1):
    r = random.Random(seed)
    return [" ".join(r.choice(WORDS) for _ in range(r.randint(0, 6))) + str(r.randint(0, 5000)) for _ in range(n)]


def found(pattern, text, ignore_case):
    try:
        return re.search(pattern, text, re.A | (re.I if ignore_case else 0)) is not None
    except re.error:
        return False


@pytest.mark.parametrize("pattern, literals", [
    ("timeout", ["timeout"]), ("not found|enoent", ["enoent", "not found"]), (r"\b(disk|host) 17\D*$", [" 17"]), ("(?i)EVAL\\s*\\(", ["eval"]),
    ("a+bcd?e", ["bc"]), ("(abc)?x", ["x"]), ("(abc){2}", ["abc"]), ("[ab]", []), ("x|[ab]", []), ("([", []), (r"\p{L}abc", []), (r"\Qab\E", []),
    ("(?=abc)d", ["d"]), ("", []), (None, [])])
def test_required_literals(pattern, literals):
    assert required_literals(pattern) == literals


def test_every_match_holds_a_required_literal():
    r = random.Random(5)
    parts = ["ab", "c", "(d|ef)", "g?", "[hi]", "(jk)+", "l{2}", ".", r"\d", "(m|)", "n*", r"\bo"]
    for _ in range(2000):
        pattern = "".join(r.choice(parts) for _ in range(r.randint(1, 5)))
        need = required_literals(pattern)
        text = "".join(r.choice("abcdefghijklmno1 ") for _ in range(12))
        if need and re.search(pattern, text):
            assert any(w in text for w in need), (pattern, text)


def test_containing(spark):
    rows = texts(200) + ["", None, "dis", "d"]
    needles = ["d", "is", "disk", "t f", "", None, "é", "zz", "429", "429", "\U0001f600", "k h"]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    out = C.containing(df, F.col("text"), spark.createDataFrame([(w,) for w in needles], "needle string"))
    assert sorted((r.id, r.needle) for r in out.collect()) == sorted(
        (i, w) for i, t in enumerate(rows) if t for w in set(needles) if w and w in t)
    none = spark.createDataFrame([], "needle string")
    assert C.containing(df, F.col("text"), none).collect() == []


def test_findings_of_5000_rules(spark):
    shapes = [r"\b(disk|host) .*%d", "%d$", "time(out|r).*%d", r"[a-c]+%d", "not found|enoent|%d"]
    rules = [Rule(f"r{i}", "c", "low", shapes[i % 5] % i, ("*",) if i % 3 else ("py",), i % 7 != 0, "", bool(i % 2)) for i in range(5000)]
    rules += [Rule("bad", "c", "low", "([", ("*",)), Rule("bare", "c", "low", r"\d{4}", ("*",)), Rule("top", "c", "high", "eval\\(", ("*",))]
    rows = [("repo", f"f{i % 4}", i, t, "py" if i % 2 else "go") for i, t in enumerate(texts(150))]
    lines = spark.createDataFrame(rows, "repo string, path string, line long, text string, lang string")
    got = sorted((r.line, r.rule_id) for r in M.bug_findings(lines, rules, ("top",)).collect())
    want = sorted((line, r.rule_id) for _, _, line, t, lang in rows for r in rules if r.active and r.rule_id != "top"
                  and ("*" in r.languages or lang in r.languages) and found(r.pattern, t, r.ignore_case))
    assert got == want and want


def test_corrections_of_5000_patterns(spark):
    shapes = [r"\b(disk|host) .*%d", "%d$", "timeout.*%d", "[A-C]+%d", "not found|enoent"]
    store = [(f"c{i}", "local" if i % 9 == 0 else "global", i % 2500, "([" if i == 3 else shapes[i % 5] % (i,) if "%d" in shapes[i % 5] else shapes[i % 5])
             for i in range(5000)]
    errors = [(i, t) for i, t in enumerate(texts(120, 2))] + [(500, None), (501, ""), (502, "nothing")]
    got = {r.id: r.correction_id for r in E.match_corrections(
        spark.createDataFrame(errors, "id long, error string"), spark.createDataFrame(store, "id string, scope string, seq long, symptom string")).collect()}
    for i, t in errors:
        hits = [(scope != "local", seq, c) for c, scope, seq, p in store if t is not None and found(p, t, True)]
        assert got[i] == (min(hits)[2] if hits else None), t
