import re

from tallyforge.operators import complexity as C
from tallyforge.registry import OPS, as_view, register_sql, run

CODE = """function alpha(a, b) {
  if (a && b) { return a ? b : 1; }
  for (let i = 0; i < 3; i++) { while (i) { i--; } }
}
const beta = (x) => {
  switch (x) {
    case 1: return 2;
  }
  try { go(x); } catch (e) { if (e) { throw e; } }
};
const gamma = x => x || 1;
class Foo {
  method(a) { return a; }
  broken(a) { return
"""


def brute(code):
    """Follows the definition literally: scan for a shape, walk to the matching brace, count."""
    out, seen = [], set()
    for m in re.finditer(r"(?:function\s+\w+|\w+\s*=\s*(?:async\s*)?\(|\w+\s*\([^)]*\)\s*\{)", code):
        line = code[: m.start()].count("\n") + 1
        if line in seen:
            continue
        seen.add(line)
        rest = code[m.start():]
        start = rest.find("{")
        depth, end = 0, -1
        for i in range(start if start >= 0 else len(rest), len(rest)):
            depth += (rest[i] == "{") - (rest[i] == "}")
            if depth == 0:
                end = i
                break
        if end < 0:
            continue
        body = rest[: end + 1]
        n = 1 + sum(len(re.findall(p, body, re.M)) for p in (
            r"\bif\s*\(", r"\bfor\s*\(", r"\bwhile\s*\(", r"^\s*case\s+.*:", r"\bcatch\s*\(", r"&&|\|\|", r"\?"))
        out.append((line, n, body.count("\n") + 1))
    return out


def test_discovery_matches_brute_force():
    got = [(line, cx, n) for _, line, cx, _, n in C.functions_of(CODE)]
    assert got[: len(brute(CODE))] == brute(CODE)
    named = {f[0]: f for f in C.functions_of(CODE)}
    # the shape "function name" ends before its parameter list, so only call shapes count parameters
    assert named["alpha"][2] == 6 and named["alpha"][3] == 0
    assert "broken" not in named and named["method"][2] == 1 and named["method"][3] == 1


def test_random_texts():
    import random

    rnd = random.Random(3)
    bits = ["function f(a) {", "}", "{", "\n", "if (x) ", "a ? b : c;", "x && y;", "case 1: z", "g(1) {", "catch (e) {", "for (;;) ", " "]
    for _ in range(300):
        code = "".join(rnd.choice(bits) for _ in range(40))
        want = brute(code)
        got = [(line, cx, n) for _, line, cx, _, n in C.functions_of(code)]
        assert got == want, code


def test_rollups_and_registry(spark):
    files = spark.createDataFrame([("r", "a.ts", CODE), ("r", "b.ts", "no functions")], "repo string, path string, content string")
    found = run("discover_functions", files=files)
    per = C.file_complexity(found).collect()
    assert len(per) == 1 and per[0]["maximum"] == 6
    assert "error_groups" in OPS and "threshold" in OPS["anomalies"].arguments and OPS["anomalies"].required == ("logs",)
    as_view("file_complexity", "cx_view", functions=found)
    assert spark.sql("SELECT count(*) AS n FROM cx_view").first()["n"] == 1
    register_sql(spark)
    got = spark.sql("SELECT name, complexity FROM functions_of('function f(a) { if (a) { } }')").collect()
    assert [(r["name"], r["complexity"]) for r in got] == [("f", 2)]


def test_unknown_argument_is_refused():
    import pytest

    with pytest.raises(TypeError):
        run("error_groups", nope=1)
