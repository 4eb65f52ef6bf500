"""Exact top-k and fingerprints against brute force."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import SF, as_dicts, clashing, documents, empty, odd_documents, rows
from tallyforge.llm import sketches, topk
from tallyforge.llm.frames import settle
from tallyforge.llm.queries import ORACLES, QUERIES


def brute(vectors, queries, k, scale=64):
    def ints(v):
        return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(scale * x) for x in v]

    usable = [(i, ints(v)) for i, v in vectors if i is not None and ints(v) is not None]
    out = []
    for q in queries:
        for qv in {tuple(v) for i, v in usable if i == q}:
            scored = sorted((-sum(a * b for a, b in zip(qv, v, strict=False)), i) for i, v in usable if i != q)
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    r = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in r.normal(size=6)]) for i in range(150)]
    vectors += [(i, [0.5] * 6) for i in range(150, 190)]  # ties
    vectors += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, [1.0] * 6), (204, []), (205, [2.0, 3.0]),
                (220, [1e12] * 6), (206, [0.0] * 6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("cb", F.lit(2))
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 20 = 0"), k=20).collect()))
    assert got == brute(vectors, [i for i, _ in vectors if i is not None and i % 20 == 0], 20)
    few = df.where("vec_id in (0, 1, 2)")
    assert len(rows(topk.top_k(few, few.where("vec_id = 0")))) == 2
    assert rows(topk.top_k(df.where("false"), df)) == [] == rows(topk.top_k(df, df.where("false")))


def test_search_stops_before_the_end():
    r = np.random.default_rng(6)
    base = np.floor(64 * r.normal(size=(4000, 3)))
    lists = topk.Lists(np.arange(4000), base)
    read = []
    bound = topk.Lists.bound
    lists.bound = lambda *a: read.append(a[-1]) or bound(lists, *a)
    rows_, scores = lists.best(-1, base[0], 5)
    assert max(read) < 2000 and scores.tolist() == sorted((base @ base[0]).tolist())[::-1][:5]


def test_top_k_query(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    assert rows(QUERIES["op3_top_k"](spark, SF)) == sorted(con.sql(ORACLES["op3_top_k"]).fetchall(), key=repr)


def shingles(text):
    w = text.lower().split()
    return {tuple(w[max(0, i - 4):i + 1]) for i in range(len(w))}


def edited(text, nxt):
    q = len(text) // 4
    return text[:len(text) - q] + nxt[:q]


def test_fingerprints_of_odd_rows(spark):
    docs = odd_documents(spark)
    out = as_dicts(sketches.fingerprints(clashing(docs)))
    assert len(out) == docs.count()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    again = as_dicts(sketches.fingerprints(docs.repartition(5)))
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    assert rows(sketches.fingerprints(empty(spark))) == []
    one = as_dicts(sketches.fingerprints(documents(spark, ["a b c d e f g h"])))[0]
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(edited("a b c d e f g h", "a b c d e f g h").encode()).hexdigest()


def test_fingerprints_query(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    out = sorted(as_dicts(QUERIES["op4_fingerprints"](spark, SF)), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in out] == [i for i, _ in docs]
    prints = {}
    for k, ((_, text), r) in enumerate(zip(docs, out, strict=True)):
        nxt = docs[(k + 1) % len(docs)][1]
        new = edited(text, nxt)
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        for name, other in (("near_edited", new), ("near_next", nxt)):
            a, b = shingles(text), shingles(other)
            true = len(a & b) / min(len(a), len(b)) if a and b else float(a == b)
            assert abs(r[name] - true) < 0.35
    assert np.mean([r["near_edited"] for r in out]) > 0.65 and np.mean([r["near_next"] for r in out]) < 0.2


def test_sketches_merge_and_read_back(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    parts = documents(spark, [long[:9000], long[8000:], long])
    df = sketches.with_sketch(parts.select("doc_id", "text"), "text", "own")
    df = settle(settle(df, "sketches").select("doc_id", "own", sketches.fingerprint("own").alias("print")), "prints")
    back = df.select("own", sketches.parsed(F.col("print")).alias("read")).where("own.h <> read.h or own.n <> read.n")
    assert back.count() == 0
    pair = df.where("doc_id = 0").select(F.col("own").alias("a")).join(df.where("doc_id = 1").select(F.col("own").alias("b")), F.lit(True))
    got = pair.select(sketches.merged("a", "b").alias("m"), sketches.containment("a", "b").alias("c")).first()
    whole = df.where("doc_id = 2").select("own.h").first()[0]
    assert len(set(got["m"]) ^ set(whole)) <= 4  # the shingles at the cuts differ
    assert got["c"] == pytest.approx(1000 / 9000, abs=0.12)
