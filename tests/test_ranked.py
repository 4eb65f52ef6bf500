"""Best k items of each query, in blocks."""

import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F
from tallyforge.operators import decisions as D, knowledge as K, ranked


@pytest.mark.parametrize("kind", ["long", "string"])
def test_best_items_against_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(ranked, "SHARD", 7)
    monkeypatch.setattr(ranked, "BLOCK", 3)
    r = random.Random(3)
    key = (lambda i: i) if kind == "long" else (lambda i: f"é{i}")
    held = {key(i): {f"f{j}": float(r.randrange(1, 3)) for j in r.sample(range(12), 4)} for i in range(60)}
    bias = {i: float(r.randrange(3)) for i in held}
    wants = {f"q{q}": {f"f{j}": float(r.choice([-1, 1, 2])) for j in r.sample(range(14), 3)} for q in range(11)}
    items = spark.createDataFrame([(i, bias[i], f, v) for i, fs in held.items() for f, v in fs.items()], f"item {kind}, bias double, feature string, value double")
    asked = spark.createDataFrame([(q, 1.0, f, w) for q, fs in wants.items() for f, w in fs.items()], "query string, size double, feature string, weight double")

    def score(sums, bias, size):
        return np.where(sums > 0, sums + bias * size, -np.inf)

    want = set()
    for q, fs in wants.items():
        sums = {i: sum(w * held[i].get(f, 0) for f, w in fs.items()) for i in held}
        best = sorted((-(s + bias[i]), i) for i, s in sums.items() if s > 0)[:4]
        want |= {(q, i, -s) for s, i in best}
    got = ranked.best_items(items, asked, 4, score, ranked.counted(items.select("item").distinct())).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    assert ranked.best_items(items.limit(0), asked, 4, score, ranked.counted(items.limit(0))).isEmpty()
    assert ranked.best_items(items, asked.limit(0), 4, score, ranked.counted(items)).isEmpty()


def test_similar_contexts_are_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(ranked, "SHARD", 16)
    monkeypatch.setattr(ranked, "BLOCK", 8)
    r = random.Random(5)
    words = ["red", "blue", "old", "new", "ring", "bolt", "gear", "rod"]
    entries = spark.createDataFrame([(i, " ".join(["all", *r.sample(words, r.randrange(5))])) for i in range(200)], "id long, context string")
    asked = [(" ".join(["all", *r.sample(words, r.randrange(4))]),) for _ in range(40)]
    table = D.similar_contexts(entries, spark.createDataFrame(asked, "query string"))
    # twenty at a time are scored in one scan
    few = sorted({a for a, in asked})
    scans = [D.similar_contexts(entries, few[at:at + 20]) for at in range(0, len(few), 20)]
    assert sorted(map(tuple, table.collect())) == sorted(tuple(x) for s in scans for x in s.select(*table.columns).collect())
    assert "array_intersect" not in table._jdf.queryExecution().optimizedPlan().toString()


def test_best_knowledge_is_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(ranked, "SHARD", 16)
    monkeypatch.setattr(ranked, "BLOCK", 8)
    r = random.Random(7)
    words = ["red", "Blue", "old", "new", "ring"]
    pick = lambda n: " ".join(r.choice(words) for _ in range(n))
    kb = spark.createDataFrame(
        [(i, pick(1), pick(2), pick(r.randrange(9)), [pick(2), pick(1)], [pick(3)]) for i in range(90)],
        "id long, topic string, library string, content string, relevance array<string>, tags array<string>").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    now, asked = F.lit("2024-02-15").cast("timestamp"), sorted({pick(r.randrange(1, 4)) for _ in range(30)})
    table = K.query_knowledge(kb, spark.createDataFrame([(a,) for a in asked], "query string"), now, 5)
    cols = ["query", "id", "score"]
    scans = [K.query_knowledge(kb, asked[at:at + 15], now, 5) for at in range(0, len(asked), 15)]
    assert sorted(map(tuple, table.select(*cols).collect())) == sorted(tuple(x) for s in scans for x in s.select(*cols).collect())
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[(id|item)#\d+L?, query#", plan)
