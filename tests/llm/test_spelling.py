"""Spelling variants against pairs found by deletion."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cases import SF, as_dicts, clashing, documents, empty, odd_documents, rows
from tallyforge.llm import spelling as sp
from tallyforge.llm.queries import ORACLES, QUERIES


def plain_counts(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def plain_near(words):
    """Near words by common deletions."""
    by = defaultdict(list)
    for w in words:
        for i in range(len(w)):
            by[w[:i], w[i + 1:]].append(w)
    near = defaultdict(set)
    for group in by.values():
        for a in group:
            near[a].update(b for b in group if b != a)
    for w in words:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1:]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    return near


def plain(n):
    near = plain_near(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()), key=repr)


def random_words(seed, k, letters="abé"):
    r = random.Random(seed)
    return {"".join(r.choice(letters) for _ in range(r.randint(5, 9))): r.randint(3, 400) for _ in range(k)}


def bucket_pairs(words):
    """All four first groups of all words in one bucket."""
    cols = [(w, n, m, lo, hi) for w, n in words.items() for m in (len(w), len(w) - 1) for lo, hi in ((m // 2, m), (0, m // 2))]
    t = pa.table(dict(zip(("word", "n", "m", "lo", "hi"), map(list, zip(*cols, strict=True)), strict=True)))
    out = sp.near_in_bucket(t)
    return set(zip(out.column("word").to_pylist(), out.column("near").to_pylist(), strict=True))


@pytest.mark.parametrize("letters", ["ab", "abcdefghijklé", "xÿ×"])
def test_search_finds_exactly_the_near_words(letters):
    words = random_words(1, 400, letters)
    near = plain_near(words)
    assert bucket_pairs(words) == {(a, b) for a in near for b in near[a]}


def test_intervals_count_occurrences():
    r = np.random.default_rng(3)
    words = [r.integers(2, 5, size=k) for k in (3, 5, 5, 8, 1)]
    index = sp.Index(words, 3)
    text = index.text.tolist()
    for size in (1, 2, 3):
        for at in range(len(text) - size):
            pattern = text[at:at + size]
            lo, hi = np.array([0]), np.array([index.size])
            for s in reversed(pattern):
                lo, hi = index.extend(np.array([s]), lo, hi)
            want = [i for i in range(len(text)) if text[i:i + size] == pattern]
            assert sorted(index.suffixes[lo[0]:hi[0]].tolist()) == want


def test_vocabulary_and_forms_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(sp, "HELD_WORDS", 50)
    docs = odd_documents(spark)
    more = documents(spark, ["Receive receive RECEIVE recieve receive", "receve receve receve, receiver", "naïve naive Naïve naïve naive naive NAÏVE",
                             "ÀÉÎÕÜ àéîõü ÀÉÎÕÜ ÀÉÎÕÜ", "İstanbul aſsume ×÷×÷×÷", "y" * 3000] * 4)
    both = docs.unionByName(more)
    want = plain_counts([(r.doc_id, r.text) for r in both.collect()])
    assert {r["word"]: r["n"] for r in as_dicts(sp.vocabulary(clashing(both)))} == want
    assert got(sp.report(clashing(both))) == plain(want)
    assert rows(sp.report(empty(spark))) == []


def test_hot_groups_are_halved_again(spark, monkeypatch):
    """Half of all words begin alike, and groups may hold 20."""
    monkeypatch.setattr(sp, "OPEN", 20)
    monkeypatch.setattr(sp, "BUCKET_CHARS", 3000)
    words = random_words(5, 500, "abcd") | {f"commonstart{w}": n for w, n in random_words(6, 400, "abc").items()}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    groups = sp.grouped(df)
    sizes = groups.groupBy("key").count().join(groups.selectExpr("key", "hi - lo as open"), "key")
    assert sizes.where("count > 20 and open > 1").isEmpty()
    assert got(sp.forms(df)) == plain(words)


def test_long_chains_of_forms(spark):
    words = {"a" * (5 + i): 3 * 2**i for i in range(25)}
    assert got(sp.forms(spark.createDataFrame(list(words.items()), "word string, n long"))) == plain(words)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(QUERIES["op13_spelling_variants"](spark, SF)) == plain(plain_counts(docs))


def test_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(ORACLES["op13_spelling_variants"])
    df = QUERIES["op13_spelling_variants"](spark, SF)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.select(*want.columns)) == sorted(want.fetchall(), key=repr)
