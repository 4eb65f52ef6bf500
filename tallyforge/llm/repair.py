"""Token ids on disk, compressed by a grammar of frequent pairs, with random access.

Per shard, rounds of Re-Pair: the most frequent adjacent pairs become nonterminals, in one pass for a set of pairs in
which no symbol is both a left and a right part, so that occurrences of different pairs cannot overlap. Rounds end when
no pair is frequent enough. A shard file holds the rules, the expansion length of every nonterminal, the compressed
sequence and the documents' ids and places; any span is decoded by a search in the running expansion lengths.

File layout, little-endian: magic ``RPG1``, then six u32 counts (terminal bound, rules, symbols, documents, ids high,
ids low), then rules (u32 left, u32 right), expansion lengths (u32), symbols (u32), doc ids (i64), doc lengths (u32).
A null doc id is written as the smallest i64.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .encoding import encoder
from .frames import SLICE_ROWS, arrow, in_order, record, settle, texts

MAGIC = b"RPG1"
#: Ids gathered before a shard file is closed at the end of a document.
SHARD_IDS = 1 << 20
#: Rounds of pair replacement, pairs replaced in one round, and the least count of a pair.
ROUNDS, PAIRS, LEAST = 4, 2048, 64
NULL_ID = -(1 << 63)
_SLOTS = 1 << 20


def frequent_pairs(seq: np.ndarray, least: int, most: int) -> list[tuple[int, int]]:
    """At most ``most`` pairs with at least ``least`` occurrences, most frequent first, ties by value.

    Pairs are first counted in hashed slots, which cannot miss a frequent one, then exactly.
    """
    if len(seq) < 2:
        return []
    left, right = seq[:-1], seq[1:]
    slot = (left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA77)) >> np.uint32(12)
    counts = np.bincount(slot, minlength=_SLOTS)
    heavy = counts >= least
    if heavy.sum() > 2 * most:
        heavy = counts >= np.sort(counts[heavy])[-2 * most]
    at = np.flatnonzero(heavy[slot])
    pair = (left[at].astype(np.uint64) << np.uint64(32)) | right[at]
    found, n = np.unique(pair, return_counts=True)
    keep = n >= least
    found, n = found[keep], n[keep]
    order = np.lexsort((found, -n))[:most]
    return [(int(p >> np.uint64(32)), int(p & np.uint64(0xFFFFFFFF))) for p in found[order]]


def compress(ids: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """``(rules, symbols)``; symbol ``bound + k`` stands for the pair ``rules[k]``."""
    seq, rules = ids.astype(np.uint32), []
    for _ in range(ROUNDS):
        left_of: dict[int, int] = {}
        chosen, lefts, rights = [], set(), set()
        for a, b in frequent_pairs(seq, LEAST, PAIRS):
            if a in rights or b in lefts or (a == b and (a in lefts or b in rights)):
                continue
            lefts.add(a)
            rights.add(b)
            chosen.append((a, b))
        if not chosen:
            break
        first = bound + len(rules)
        rules += chosen
        keys = np.array([(a << 32) | b for a, b in chosen], np.uint64)
        order = np.argsort(keys)
        top = first + len(chosen)
        is_left = np.zeros(top, bool)
        is_left[list(lefts)] = True
        at = np.flatnonzero(is_left[seq[:-1]])
        pair = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]
        place = np.minimum(np.searchsorted(keys[order], pair), len(keys) - 1)
        hit = keys[order][place] == pair
        at, rule = at[hit], order[place[hit]]
        # a run of one symbol overlaps itself: take every second place of it
        run = np.concatenate([[True], np.diff(at) != 1])
        begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        even = (np.arange(len(at)) - begin) % 2 == 0
        at, rule = at[even], rule[even]
        seq[at] = first + rule
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
    return np.array(rules, np.uint32).reshape(-1, 2), seq


def expansion_lengths(rules: np.ndarray, bound: int) -> np.ndarray:
    size = np.ones(bound + len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        size[bound + k] = size[a] + size[b]
    return size[bound:]


def write_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    bound = int(ids.max()) + 1 if len(ids) else 1
    rules, seq = compress(ids, bound)
    head = struct.pack("<4s6I", MAGIC, bound, len(rules), len(seq), len(doc_ids), len(ids) >> 32, len(ids) & 0xFFFFFFFF)
    return b"".join([
        head, rules.astype("<u4").tobytes(), expansion_lengths(rules, bound).astype("<u4").tobytes(), seq.astype("<u4").tobytes(),
        np.array([NULL_ID if d is None else d for d in doc_ids], "<i8").tobytes(), np.array(lengths, "<u4").tobytes()])


class Shard:
    """A shard file opened for reading."""

    def __init__(self, raw: bytes):
        magic, self.bound, rules, symbols, docs, hi, lo = struct.unpack_from("<4s6I", raw)
        if magic != MAGIC:
            raise ValueError("not a shard file")
        self.n_ids, at = (hi << 32) | lo, struct.calcsize("<4s6I")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * rules).reshape(-1, 2)
        self.sizes = take("<u4", rules)
        self.symbols = take("<u4", symbols)
        self.doc_ids = [None if d == NULL_ID else d for d in take("<i8", docs).tolist()]
        self.lengths = take("<u4", docs)
        grown: list[np.ndarray] = []
        for a, b in self.rules.tolist():
            grown.append(np.concatenate([
                np.array([x], np.uint32) if x < self.bound else grown[x - self.bound] for x in (a, b)]))
        self.flat = np.concatenate([np.arange(self.bound, dtype=np.uint32), *grown])
        self.size = np.concatenate([np.ones(self.bound, np.int64), self.sizes.astype(np.int64)])
        self.place = np.cumsum(self.size) - self.size
        self.ends = np.cumsum(self.size[self.symbols])

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start`` on, decoding only the symbols that cover them."""
        if n <= 0:
            return np.zeros(0, np.uint32)
        i, j = np.searchsorted(self.ends, [start, start + n - 1], side="right")
        part = self.symbols[i:j + 1]
        size = self.size[part]
        begin = np.cumsum(size) - size
        out = self.flat[np.repeat(self.place[part] - begin, size) + np.arange(int(size.sum()))]
        skip = start - (int(self.ends[i]) - int(size[0]))
        return out[skip:skip + n]


FILE_SCHEMA = "part int, file int, n_docs long, n_ids long, payload binary"


def write_token_files(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Shard files of all texts in ascending ``doc_id`` order, written below the shared folder and read back.

    Rows ``part, file, n_docs, n_ids, payload``; ordered by (part, file) they hold the corpus in order. A null or empty
    text is ``end_id`` alone; null ids come first; equal ids stay rows of their own; no row, no file.
    """
    ordered = in_order(texts(docs)).withColumn("part", F.spark_partition_id())

    def run(batches):
        schema, encode = arrow(FILE_SCHEMA), encoder(path, False)
        end = np.asarray([end_id], "<u4").tobytes()
        names: list = []
        lengths: list[int] = []
        parts: list[bytes] = []
        held, file, part = 0, 0, 0

        def close():
            nonlocal held, file
            raw = write_shard(names, lengths, np.frombuffer(b"".join(parts), "<u4"))
            row = {"part": [part], "file": [file], "n_docs": [len(names)], "n_ids": [held], "payload": [raw]}
            names.clear(), lengths.clear(), parts.clear()
            held, file = 0, file + 1
            return record(schema, row)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(at, SLICE_ROWS)
                part = rows.column("part")[0].as_py()
                for doc_id, raw in zip(rows.column("doc_id").to_pylist(), encode(rows.column("text").to_pylist()), strict=True):
                    names.append(doc_id)
                    parts.append(raw + end)
                    lengths.append(len(raw) // 4 + 1)
                    held += lengths[-1]
                    if held >= SHARD_IDS:
                        yield close()
        if names:
            yield close()

    return settle(ordered.mapInArrow(run, FILE_SCHEMA), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from shard files one document at a time."""
    place = files.select("part", "file", "n_ids")
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = place.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("before"))
    starts = place.join(parts, "part").select(
        "part", "file", (F.col("before") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("base"))

    def run(batches):
        schema = arrow("part int, file int, doc_id long, at long, n_tokens long, ids_crc32 long")
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                shard = Shard(row.column("payload")[0].as_py())
                n = shard.lengths.astype(np.int64)
                at = np.cumsum(n) - n
                sums = [zlib.crc32(shard.ids(a, k).astype("<u4").tobytes()) for a, k in zip(at.tolist(), n.tolist(), strict=True)]
                p, f = (row.column(c)[0].as_py() for c in ("part", "file"))
                yield record(schema, {"part": [p] * len(n), "file": [f] * len(n), "doc_id": shard.doc_ids, "at": at, "n_tokens": n,
                                      "ids_crc32": sums})

    # a file of a million ids is a few MB: the Arrow batch limit keeps few of them in a task at once
    docs = files.select("part", "file", "payload").mapInArrow(
        run, "part int, file int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "file"]).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
