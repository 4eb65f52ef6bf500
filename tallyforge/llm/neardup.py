"""Near-duplicate classes by HyperMinHash: one hash per shingle, compressed registers, banding, exact confirmation.

A document's shingle hashes fall into ``BUCKETS`` buckets; a bucket keeps the least second hash as one byte: its leading
zeros (4 bits) and the bits after them (4 bits). Empty buckets borrow the register of a bucket drawn by a fixed
sequence. Bands of ``ROWS`` registers are keys; documents of one key are candidates. Documents of equal sets count once.

Candidates are linked without listing all pairs of a key. Each document is first compared with the least document among all
its keys, then with the least of each key where both still lie in different components; keys whose other members
still differ are compared tile by tile, those whose least members lie in one component together: the members outside the
largest component, in bounded blocks, with all others, the pairs of a tile by one matrix product, which yields only a
spanning forest. Every comparison estimates the Jaccard similarity from the registers, corrected for chance agreement,
and confirms on the full sets what comes near.
"""

from __future__ import annotations

import hashlib
import math
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .encoding import Memo
from .frames import SLICE_ROWS, arrow, map_slices, settle
from .graph import components

WORDS, PERCENT = 5, 75
BANDS, ROWS = 64, 6
BUCKETS = BANDS * ROWS
MANTISSA = 4
#: Estimates more than this below the threshold are not confirmed: over five standard deviations of ``BUCKETS`` registers.
MARGIN = 0.12
#: Documents of a key, and shingles of theirs, that one task compares with as many others.
BLOCK, WEIGHT = 2048, 1 << 20
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = (x ^ (x >> np.uint64(32))) * _ODD[2]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


@cache
def _word_hashes() -> Memo:
    return Memo(lambda words: [xxhash.xxh64_intdigest(w) for w in words])


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Distinct shingle hashes, ascending, of each text: A-Z lowered, words between white space, ``WORDS`` at a time."""
    # bytes.lower and bytes.split know A-Z and the six ASCII blanks only
    words = [(t or "").encode().lower().split() for t in texts]
    out = []
    for known in _word_hashes().take(words):
        h = np.array(known, np.uint64)
        width = min(WORDS, len(h))
        if not width:
            out.append(h)
            continue
        n = len(h) - width + 1
        x = np.full(n, width, np.uint64)
        for k in range(width):
            x = _mixed((x ^ h[k:k + n]) * _ODD[0])
        out.append(np.unique(x))
    return out


@cache
def _donors() -> np.ndarray:
    """For every bucket the fixed sequence of buckets it borrows from; every bucket occurs in it."""
    rng = np.random.default_rng(41)
    return np.stack([rng.permutation(BUCKETS) for _ in range(BUCKETS)])


def registers(hashes: np.ndarray) -> np.ndarray:
    """One byte per bucket from ascending distinct hashes (at least one)."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(BUCKETS)) >> np.uint64(32)
    value = _mixed(hashes * _ODD[1]) >> np.uint64(11)
    start = np.flatnonzero(np.diff(bucket, prepend=np.uint64(BUCKETS)))
    least = np.minimum.reduceat(value, start).astype(np.float64)
    fraction, exponent = np.frexp(least)
    zeros = np.clip(53 - exponent, 0, 15).astype(np.int64)
    bits = np.where(least > 0, (fraction * 2 - 1) * (1 << MANTISSA), 0).astype(np.int64)
    out = np.full(BUCKETS, -1, np.int64)
    out[bucket[start].astype(np.int64)] = zeros << MANTISSA | bits
    empty = np.flatnonzero(out < 0)
    if len(empty):
        offered = out[_donors()[empty]]
        out[empty] = offered[np.arange(len(empty)), (offered >= 0).argmax(axis=1)]
    return out.astype(np.uint8)


def chance(n: int, m: int) -> float:
    """Probability that a register of n and one of m unrelated shingles agree."""
    k = np.arange(16)

    def zeros(count: int) -> np.ndarray:
        load = max(count / BUCKETS, 1e-3)
        p = np.exp(-load * 2.0 ** -(k + 1)) - np.exp(-load * 2.0 ** -k)
        p[15] = 1 - math.exp(-load * 2.0 ** -15)
        return p / p.sum()

    return float((zeros(n) * zeros(m)).sum()) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> float:
    """Jaccard similarity from two documents' registers, corrected for chance agreement."""
    e = chance(n, m)
    return max(0.0, (float((a == b).mean()) - e) / (1 - e))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of ascending hashes reach the threshold."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= PERCENT * (len(a) + len(b) - both)


SIGNATURE = "doc_id long, n_shingles long, digest binary, registers binary"


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, digest, registers`` of every row; digest and registers null for a text without words."""

    def step(batch):
        sets = shingle_sets(batch.column("text").to_pylist())
        yield {"doc_id": batch.column("doc_id"), "n_shingles": [len(s) for s in sets],
               "digest": [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets],
               "registers": [registers(s).tobytes() if len(s) else None for s in sets]}

    return map_slices(docs, SIGNATURE, step)


def _confirmed(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` whose sets reach the threshold, from ``node, text, n_shingles, registers``."""
    def side(name: str) -> DataFrame:
        return nodes.select(F.col("node").alias(name), F.col("text").alias(f"text_{name}"), F.col("n_shingles").alias(f"n_{name}"),
                            F.col("registers").alias(f"r_{name}"))

    # the sizes alone rule out many
    met = pairs.join(side("a"), "a").join(side("b"), "b").where(
        F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT)

    def step(batch):
        col = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        near = [i for i in range(batch.num_rows) if estimate(
            np.frombuffer(col["r_a"][i], np.uint8), np.frombuffer(col["r_b"][i], np.uint8), col["n_a"][i], col["n_b"][i])
            >= PERCENT / 100 - MARGIN]
        left, right = (shingle_sets([col[c][i] for i in near]) for c in ("text_a", "text_b"))
        keep = [i for i, x, y in zip(near, left, right, strict=True) if linked(x, y)]
        yield {"a": [col["a"][i] for i in keep], "b": [col["b"][i] for i in keep]}

    return map_slices(met, "a long, b long", step)


def forest(sets: list[np.ndarray], labels: list[int], first: int | None = None) -> list[tuple[int, int]]:
    """Edges, as places, that join the linked ones of ``sets``; those of one label count as joined.

    Only the ``first`` sets (all, if not given) meet the others.
    """
    first = len(sets) if first is None else first
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    known: dict[int, int] = {}
    for i, label in enumerate(labels):
        root[i] = known.setdefault(label, i)
    group = np.array(root)
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    found, place, n = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(n > 1) - 1
    keep = n[place] > 1
    place, owner = shared[place[keep]], owner[keep]
    both = np.zeros((first, len(sets)), np.float32)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    width = 2048
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        lo, hi = np.searchsorted(place, [at, at + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[lo:hi], place[lo:hi] - at] = 1
        both += m[:first] @ m.T
    exact = both.astype(np.int64)
    near = 100 * exact >= PERCENT * (size[:first, None] + size[None, :] - exact)
    near &= (exact > 0) & (group[:first, None] != group[None, :])
    edges = []
    for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        a, b = find(int(i)), find(int(j))
        if a != b:
            root[b] = a
            edges.append((int(i), int(j)))
    return edges


def _open_keys(members: DataFrame) -> DataFrame:
    """``key, home`` of keys with members, besides the least, in different components; of keys of the same members one.

    The home of a key is the component of its least member.
    """
    rest = members.where("node <> lead").groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    keys = rest.where("lo <> hi").select("key")
    size = members.join(keys, "key").groupBy("key").agg(
        F.count("*").alias("n"), F.min(F.struct("node", "label")).alias("first"), F.max("node").alias("last"),
        F.bit_xor(F.xxhash64("node")).alias("sum"))
    return size.groupBy("n", "first", "last", "sum").agg(F.min("key").alias("key")).select("key", F.col("first.label").alias("home"))


def _blocks(n: str, weight: str) -> Column:
    return F.ceil(F.greatest(F.col(n) / BLOCK, F.col(weight) / WEIGHT)).cast("int")


def _tiles(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """``home, key, i, j, node, label, meets``: who stands together in one task, for the keys that stay open.

    Keys of one home share most of their members, so these stand together once for all of its keys (``key`` null), unless
    its keys one by one ask for fewer rows and comparisons. The members of the largest component need not meet each other.
    Those outside it are dealt into blocks, those of it into chunks. Tile ``i, j`` of j >= 0 holds block i and chunk j;
    tile ``i, -1 - j`` holds blocks i < j. Members that ``meets`` marks meet all of their tile.
    """
    shared = members.join(_open_keys(members), "key").groupBy("home", "node").agg(
        F.first("label").alias("label"), F.collect_list("key").alias("keys"))
    mine = settle(shared.join(nodes.select("node", "n_shingles"), "node"), "open")
    each = mine.select("home", "node", "label", "n_shingles", F.explode(F.concat(F.array(F.lit(None).cast("long")), "keys")).alias("key"))
    parts = each.groupBy("home", "key", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    shapes = parts.groupBy("home", "key").agg(
        F.max(F.struct("n", "weight", "label")).alias("most"), F.sum("n").alias("n"), F.sum("weight").alias("weight"))
    shapes = shapes.select(
        "home", "key", F.col("most.label").alias("main"), F.col("most.n").alias("n_in"), F.col("most.weight").alias("w_in"),
        (F.col("n") - F.col("most.n")).alias("n_out"), (F.col("weight") - F.col("most.weight")).alias("w_out"))
    shapes = shapes.withColumns({"chunks": _blocks("n_in", "w_in"), "blocks": _blocks("n_out", "w_out")})
    # rows of the tiles, and comparisons, of which a block of them counts as one row
    shapes = shapes.withColumn("cost", F.expr(f"n_in * blocks + n_out * (chunks + blocks - 1) + n_out * (n_in + n_out) / {BLOCK}"))
    better = shapes.groupBy("home").agg(F.expr("sum(if(key is null, cost, 0)) <= sum(if(key is null, 0, cost))").alias("together"))
    shapes = shapes.join(better, "home").where("(key is null) = together").select(
        F.col("home").alias("its_home"), F.col("key").alias("its_key"), "main", "chunks", "blocks")
    dealt = each.join(shapes, (F.col("home") == F.col("its_home")) & F.col("key").eqNullSafe(F.col("its_key")))
    dealt = dealt.withColumn("out", F.col("label") != F.col("main")).withColumn(
        "at", F.expr("cast(pmod(xxhash64(node, 'block'), if(out, blocks, chunks)) as int)"))
    tiles = F.expr("""if(out,
        concat(transform(sequence(0, chunks - 1), c -> struct(at as i, c as j, true as meets)),
               transform(filter(sequence(0, blocks - 1), o -> o <> at), o -> struct(least(at, o) as i, -1 - greatest(at, o) as j, at < o as meets))),
        transform(sequence(0, blocks - 1), o -> struct(o as i, at as j, false as meets)))""")
    return dealt.select("home", "key", "node", "label", F.explode(tiles).alias("tile")).select("home", "key", "tile.*", "node", "label")


def _block_links(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Spanning links of the keys that stay open, tile by tile."""
    met = _tiles(members, nodes).join(nodes.select("node", "text"), "node")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("meets", "descending")])
        nodes_, labels, texts = (group.column(c).to_pylist() for c in ("node", "label", "text"))
        sets: list[np.ndarray] = []
        for at in range(0, len(texts), SLICE_ROWS):
            sets += shingle_sets(texts[at:at + SLICE_ROWS])
        edges = forest(sets, labels, sum(group.column("meets").to_pylist()))
        return pa.table({"a": [nodes_[i] for i, _ in edges], "b": [nodes_[j] for _, j in edges]}, schema=arrow("a long, b long"))

    return met.groupBy("home", "key", "i", "j").applyInArrow(run, "a long, b long")


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members with the label of their node."""
    return members.drop("label").join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    ``component_id`` is the least id reachable over links of at least ``PERCENT`` per cent; ``kept`` holds for that
    document. A text without words, and a row without id, is linked with nothing (and kept); of a repeated id every row
    counts, and any link of one is a link of the id. Further columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = settle(signatures(rows), "signatures")
    known = signed.where("digest is not null and doc_id is not null")
    classes = settle(known.groupBy("digest").agg(
        F.min(F.struct("doc_id", "n_shingles", "registers")).alias("c")).select("digest", "c.*").withColumnRenamed("doc_id", "node"), "classes")
    keyed = classes.select("node", F.explode(F.array(*(
        F.xxhash64(F.substring("registers", ROWS * b + 1, ROWS), F.lit(b)) for b in range(BANDS)))).alias("key"))
    leads = keyed.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1")
    members = settle(keyed.join(leads.drop("n"), "key").select("key", "node", "lead"), "members")
    involved = members.select("node").distinct()
    nodes = settle(rows.withColumnRenamed("doc_id", "node").join(involved, "node").join(
        classes.select("node", "n_shingles", "registers"), "node"), "nodes")

    # each with the least of all its keys
    first = members.where("lead < node").groupBy(F.col("node").alias("b")).agg(F.min("lead").alias("a"))
    links = settle(_confirmed(first, nodes), "links")
    # with the least of each key, where that tells something new
    members = settle(_labelled(members, components(links)), "members")
    leaders = members.select(F.col("node").alias("lead"), F.col("label").alias("lead_label")).distinct()
    open_ = members.join(leaders, "lead").where("label <> lead_label").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    links = settle(links.union(_confirmed(open_, nodes)), "links")
    # tile by tile, where members of a key still differ
    members = settle(_labelled(members, components(links)), "members")
    links = links.union(_block_links(members, nodes))
    found = components(links)

    of_class = classes.select("digest", "node").join(found, "node", "left").select(
        "digest", F.coalesce("label", "node").alias("label"))
    # rows of one id stand together, whatever their sets
    own = signed.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    return own.select(
        "doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"),
        F.coalesce(F.col("label") == F.col("doc_id"), F.lit(True)).alias("kept"))
