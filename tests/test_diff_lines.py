"""Added lines of diffs against a walk over the lines; schema blocks against one too."""

import random
import re

from tallyforge.operators.match import diff_lines
from tallyforge.sources.specs import read_schema_models


def walk(text):
    path, out = "", []
    for n, line in enumerate(text.split("\n"), 1):
        m = re.match(r"\+\+\+[^\S\n]+(?:b/)?(.+)", line)
        if m:
            path = m.group(1)
        elif line.startswith("+") and not line.startswith("+++") and line[1:].strip():
            out.append((path, n, line[1:].strip()))
    return out


def test_diff_lines_keep_their_file_and_number(spark):
    r = random.Random(1)
    parts = ["+++ b/a.ts", "+++ c d.py", "+++ /dev/null", "+x = 1", "+", "+  y  ", "-gone", " kept", "", "++z", "+++", "@@ -1 +1 @@", "--- a/x"]
    texts = ["\n".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(200)]
    df = spark.createDataFrame([(f"d{i}", "ts", t) for i, t in enumerate(texts)], "diff_id string, lang string, content string")
    out = diff_lines(df)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((x["repo"], x["path"], x["line"], x["text"]) for x in out.collect())
    assert got == sorted((f"d{i}", *row) for i, t in enumerate(texts) for row in walk(t))


def blocks(text):
    section, out = "", {}
    for line in text.split("\n"):
        m = re.match(r"(?i)\s*(?:model|table|entity)\s+(\w+)\s*\{", line)
        if m:
            section = m.group(1)
        elif re.fullmatch(r"\s*\}\s*", line):
            section = ""
        elif section and not line.lstrip().startswith("@@") and (f := re.search(r"^\s+(\w+)\s+(\S+)", line)):
            out[section, f.group(1)] = f.group(2)
    return {(e, f, t) for (e, f), t in out.items()}


def test_schema_blocks(spark):
    r = random.Random(2)
    parts = ["model A {", "  TABLE b {", "entity C{ x", "  id Int", "  id  String?", "\tname Text @u", "}", "  } ", "  @@index([id])", "loose Int", "", " models D {", "  }x y"]
    texts = ["\n".join(r.choice(parts) for _ in range(r.randint(0, 20))) for _ in range(200)]
    df = spark.createDataFrame([("r", f"f{i}", t) for i, t in enumerate(texts)], "repo string, path string, content string")
    got = {}
    for x in read_schema_models(df).collect():
        got.setdefault(x["path"], set()).add((x["entity"], x["field"], x["type"]))
    for i, t in enumerate(texts):
        assert got.get(f"f{i}", set()) == blocks(t), t
