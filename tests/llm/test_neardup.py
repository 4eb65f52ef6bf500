"""Near-duplicate classes and components against brute force."""

import itertools
import random
import re

import numpy as np
import pytest

from cases import SF, as_dicts, clashing, documents, empty, odd_documents, rows
from tallyforge.llm import graph, neardup
from tallyforge.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs):
    """doc id -> (set size, component) of tuples (id, text) with distinct ids."""
    sets = {i: shingle_set(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(df, docs):
    want = brute(docs)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in as_dicts(df)}
    assert got == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in as_dicts(df))


def cloud(seed: int, n: int) -> list[str]:
    """Copies of one text with zero to many words changed, chains of copies, exact copies, short texts."""
    r = random.Random(seed)
    base = [f"w{r.randrange(3000)}" for _ in range(120)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(r.randrange(0, 9)):
            t[r.randrange(len(t))] = f"x{r.randrange(10**6)}"
        out.append(" ".join(t))
    chain = list(base)
    for k in range(12):
        chain[k * 9:k * 9 + 3] = [f"y{k}", f"z{k}", f"q{k}"]
        out.append(" ".join(chain))
    return [*out, out[0].upper(), out[3], "a b", "A b", "a b c d e f", "a b c d e g", "one", "", " "]


def test_near_copies_of_all_degrees(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    texts = cloud(1, 90)
    docs = list(enumerate(texts))
    random.Random(2).shuffle(docs)
    check(neardup.near_duplicates(spark.createDataFrame([(i, t, None, None, None) for i, t in docs], documents(spark, []).schema)), docs)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    out = as_dicts(neardup.near_duplicates(clashing(docs)))
    assert len(out) == docs.count()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[0][0]["n_shingles"] == by[1][0]["n_shingles"] == 0 and by[0][0]["component_id"] == 0
    assert by[5][0]["component_id"] == 4 and not by[5][0]["kept"] and by[4][0]["kept"]
    assert {r["component_id"] for r in by[7]} == {7} and len(by[7]) == 4
    assert by[None][0]["component_id"] is None and by[None][0]["kept"]
    assert rows(neardup.near_duplicates(empty(spark))) == []


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(QUERIES["op2_near_duplicates"](spark, SF), docs)


def test_estimates_are_close():
    r = np.random.default_rng(3)
    for share in (0.0, 0.3, 0.75, 1.0):
        pool = np.unique(r.integers(0, 2**63, 3000).astype(np.uint64))
        n = 1000
        both = int(2 * n * share / (1 + share))
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:both], pool[n:2 * n - both]]))
        got = neardup.estimate(neardup.registers(a), neardup.registers(b), len(a), len(b))
        assert abs(got - share) < 0.12
    few = neardup.registers(pool[:1])
    assert len(set(few.tolist())) == 1


def test_forest_joins_exactly_the_linked():
    texts = cloud(5, 40)
    sets = [s for s in neardup.shingle_sets(texts) if len(s)]
    docs = [(i, t) for i, t in enumerate([t for t in texts if words(t)])]
    want = {i: c for i, (_, c) in brute(docs).items()}
    root = list(range(len(sets)))
    for i, j in neardup.forest(sets, list(range(len(sets)))):
        lo, hi = sorted((root[i], root[j]))
        root = [lo if x == hi else x for x in root]
    assert {i: root[i] for i in range(len(sets))} == want


def test_members_of_one_component_do_not_meet_each_other(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    # a key of 320 joined members and 40 others, each alone
    label = {n: 0 if n < 320 else n for n in range(360)}
    members = spark.createDataFrame([(7, n, 0, label[n]) for n in label], "key long, node long, lead long, label long")
    nodes = spark.createDataFrame([(n, 50) for n in label], "node long, n_shingles long")
    tiles, met = {}, set()
    for r in neardup._tiles(members, nodes).collect():
        tiles.setdefault((r["i"], r["j"]), []).append((r["node"], r["meets"]))
    for tile in tiles.values():
        met |= {frozenset((a, b)) for a, meets in tile if meets for b, _ in tile if a != b}
    assert met == {frozenset(p) for p in itertools.combinations(label, 2) if label[p[0]] != label[p[1]]}
    # 320 in each of 3 blocks, 40 against 20 chunks and 2 other blocks; every block with every block would be 360 * 23
    assert sum(map(len, tiles.values())) == 320 * 3 + 40 * (20 + 2)


def test_keys_of_one_home_share_their_rows(spark):
    # 20 keys of 30 joined members and the same 6 others, each alone, besides one member of its own
    label = {n: 0 if n < 30 else n for n in range(60)}
    stands = [(k, n, 0, label[n]) for k in range(20) for n in [*range(36), 36 + k]]
    members = spark.createDataFrame(stands, "key long, node long, lead long, label long")
    nodes = spark.createDataFrame([(n, 50) for n in label], "node long, n_shingles long")
    tiles = neardup._tiles(members, nodes).collect()
    # 37 rows in each of 20 keys would be 740
    assert sorted(r["node"] for r in tiles) == list(range(56))
    assert {r["node"] for r in tiles if r["meets"]} == set(range(30, 56))


def test_keys_with_little_in_common_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    stands = [(k, n, 0, n) for k in range(9) for n in [0, *range(1 + 20 * k, 21 + 20 * k)]]
    members = spark.createDataFrame(stands, "key long, node long, lead long, label long")
    nodes = spark.createDataFrame([(n, 50) for n in range(181)], "node long, n_shingles long")
    tiles, met = {}, set()
    for r in neardup._tiles(members, nodes).collect():
        tiles.setdefault((r["key"], r["i"], r["j"]), []).append((r["node"], r["meets"]))
    for tile in tiles.values():
        met |= {frozenset((a, b)) for a, meets in tile if meets for b, _ in tile if a != b}
    keys = ([n for k, n, _, _ in stands if k == key] for key in range(9))
    assert met == {frozenset(p) for ns in keys for p in itertools.combinations(ns, 2)}
    assert {key for key, _, _ in tiles} == set(range(9))


def test_forest_of_the_first_against_all():
    texts = [t for t in cloud(6, 40) if words(t)]
    sets = neardup.shingle_sets(texts)
    want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if i < 9 and neardup.linked(sets[i], sets[j])}
    root = list(range(len(sets)))
    for i, j in want:
        lo, hi = sorted((root[i], root[j]))
        root = [lo if x == hi else x for x in root]
    got = list(range(len(sets)))
    for i, j in neardup.forest(sets, list(range(len(sets))), 9):
        assert (i, j) in want
        lo, hi = sorted((got[i], got[j]))
        got = [lo if x == hi else x for x in got]
    assert got == root


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(100, 101), (101, 102), (102, 100)]])
def test_components(spark, edges):
    got = dict(rows(graph.components(spark.createDataFrame(edges, "a long, b long"))))
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
