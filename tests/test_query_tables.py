"""Queries, contexts and modules as tables of any size, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import decisions as D
from tallyforge.operators import imports as IM
from tallyforge.operators import knowledge as K

R = random.Random(4)
WORDS = [f"{a}{b}" for a in ("cat", "dog", "query", "Redis", "é", "ab") for b in ("", "s", "ing", "42")]


def phrase(most):
    return " ".join(R.choice(WORDS) for _ in range(R.randint(0, most)))


def test_relevance_of_a_table_equals_that_of_expressions(spark):
    now = F.lit("2024-03-01").cast("timestamp")
    rows = [(i, R.choice(["2024-02-20", "2024-01-01", "2020-01-01"]), phrase(3), R.choice(["Redis", "cats", "", None]), phrase(40) if i % 9 else None,
             [phrase(2), "dogs"], [phrase(1)] if i % 5 else []) for i in range(120)]
    kb = spark.createDataFrame(rows, "id long, ts string, topic string, library string, content string, relevance array<string>, tags array<string>")
    kb = kb.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("query", F.lit("clash")).drop("query")
    # a row without a text or library has no score by expressions
    kb = kb.na.fill("", ["content", "library"])
    few = sorted({phrase(3) for _ in range(15)} | {"", "ab é", "cats cats", "  Redis "})
    assert len(few) <= K.INLINE_QUERIES
    cols = ["query", "id", "score"]
    want = sorted(map(tuple, K.relevance(kb, few, now).select(*cols).collect()))
    table = spark.createDataFrame([(q,) for q in few + few + [None]], "query string")
    assert want and sorted(map(tuple, K.relevance(kb, table, now).select(*cols).collect())) == want
    many = few + [f"other{i} cats{i} redis{i % 7}" for i in range(5000)]
    got = K.query_knowledge(kb, many, now, k=3)
    assert got.groupBy("query").count().where("count > 3").isEmpty()
    top = sorted(map(tuple, K.query_knowledge(kb, few, now, k=3).select(*cols).collect()))
    assert sorted(r for r in map(tuple, got.select(*cols).collect()) if r[0] in few) == top


def tokens(text):
    clean = "".join(c for c in text.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789 ")
    return {w for w in clean.split() if len(w) > 2}


@pytest.mark.parametrize("least", [0.1, 0.5, 0.75, 0.99])
def test_similar_pairs_equal_brute_force(spark, least):
    entries = [(i, phrase(8)) for i in range(150)] + [(200, None), (201, "")]
    contexts = sorted({phrase(8) for _ in range(60)} | {"", "unseen words only", "cats unseen"})
    out = D.similar_pairs(spark.createDataFrame(entries, "id long, context string"), spark.createDataFrame([(c,) for c in contexts], "query string"), least)
    want = []
    for c in contexts:
        for i, e in entries:
            a, b = tokens(e or ""), tokens(c)
            if a and b and len(a & b) / len(a | b) > least:
                want.append((c, i, len(a & b) / len(a | b)))
    assert sorted((r.query, r.id, r.similarity) for r in out.collect()) == sorted(want)


def test_top_contexts_of_repeated_entries(spark):
    entries = [(i, "cats dogs redis") for i in range(50)] + [(100 + i, "cats dogs") for i in range(20)]
    many = [f"cats dogs redis number{i}" for i in range(3000)]
    out = D.similar_contexts(spark.createDataFrame(entries, "id long, context string"), many, k=3)
    by = {}
    for r in out.collect():
        by.setdefault(r.query, []).append(r.id)
    assert len(by) == 3000 and all(sorted(v) == [0, 1, 2] for v in by.values())


def test_coupling_of_5000_modules(spark):
    imports = [("r", f"f{i}", f"./lib/mod{i % 700}/{R.choice(['a', 'bc'])}") for i in range(900)]
    modules = [f"mod{i}" for i in range(4990)] + ["", "a", "bc", "/", "lib", "none"]
    got = {r.module: r.imported_by for r in IM.coupling(spark.createDataFrame(imports, "repo string, src_path string, target string"), modules).collect()}
    want = {m: len({s for _, s, t in imports if m in t}) for m in modules if m and any(m in t for _, _, t in imports)}
    assert got == want
