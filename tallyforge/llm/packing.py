"""Order-preserving packing: where to cut the token stream of ordered documents into windows.

Documents stand in ascending ``doc_id`` order as one stream of ids. Allowed cuts are document ends (free), sentence
ends (``SENTENCE_COST``) and, a whole window after a cut that has neither close before that place, the id there
(``ID_COST``); in the last window of the stream any id, as nothing follows that could fill it. The least total of padding
plus cut costs follows by dynamic programming over the allowed cuts: with f(i) the least cost of the stream up to cut
i, f(j) = cost(j) + W - j + min(f(i) + i) over the cuts i in [j - W, j), a sliding minimum kept in a monotone queue;
a window whose length is a power of two carries no padding and is one further transition per power.
"""

from __future__ import annotations

import zlib
from collections import deque
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .encoding import encoder, load
from .frames import SLICE_ROWS, arrow, in_order, record, settle, texts

WINDOW = 2048
SENTENCE_COST = 4
ID_COST = 32
#: Stops that no blank follows.
WIDE_STOPS = "。！？｡"
#: Powers of two below the window: all of them, as each is a length without padding.
POWERS = WINDOW.bit_length() - 1
#: Ids solved at once; the last window of a block is carried into the next block, so only a shard's end is padded.
BLOCK_IDS = 500_000
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, shard int, local_id long, "
          "offset long, padded long")


def padding(length: int, window: int = WINDOW) -> int:
    """Ids added to a sequence: none at a power of two, else up to the window."""
    return 0 if length & (length - 1) == 0 else window - length


def best_cuts(cuts: list[int], costs: list[int], window: int = WINDOW) -> list[int]:
    """Cheapest chain of cuts from 0 to the last of ``cuts`` (ascending, gaps at most ``window``)."""
    at = np.asarray(cuts)
    is_cut = np.zeros(at[-1] + 1, bool)
    is_cut[0] = is_cut[at] = True
    # most cuts have no other at a power of two before them: those that have are found at once
    places, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p in (1 << k for k in range(window.bit_length()) if 1 << k < window):
        later = np.flatnonzero(at >= p)
        later = later[is_cut[at[later] - p]]
        places.append(later)
        lengths.append(np.full(len(later), p))
    order = np.argsort(np.concatenate(places), kind="stable")
    from_ = np.concatenate(lengths)[order].tolist()
    until = np.cumsum(np.bincount(np.concatenate(places), minlength=len(at))).tolist()
    best: dict[int, int] = {0: 0}
    back: dict[int, int] = {}
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f(i) + i, i), values ascending
    done = 0
    for j, extra, upto in zip(cuts, costs, until, strict=True):
        while queue[0][1] < j - window:
            queue.popleft()
        value, i = queue[0]
        value += window - j
        if done < upto:
            for p in from_[done:upto]:
                if best[j - p] < value:
                    value, i = best[j - p], j - p
            done = upto
        value += extra
        best[j], back[j] = value, i
        key = value + j
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    chain = [cuts[-1]]
    while chain[-1]:
        chain.append(back[chain[-1]])
    return chain[::-1]


def allowed(doc_ends: np.ndarray, sentence_ends: np.ndarray, window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Ascending cuts and their costs.

    A cut at an id stands a window after any cut, unless a document or sentence end before that place costs no more in
    padding: a later cut only fills the window, an earlier one pads it. Each such cut asks for the next in turn.
    """
    soft = np.setdiff1d(sentence_ends, doc_ends, assume_unique=True)
    at = np.concatenate([doc_ends, soft])
    cost = np.concatenate([np.zeros(len(doc_ends), np.int64), np.full(len(soft), SENTENCE_COST)])
    known = np.concatenate([[0], np.sort(at)])
    end = known[-1]
    is_cut = np.zeros(end + 1, bool)
    is_cut[known] = True
    hard, new = [], known
    while len(new):
        new = new[new < end - window] + window
        new = new[~is_cut[new]]
        new = new[new - known[np.searchsorted(known, new) - 1] >= min(ID_COST - SENTENCE_COST, window)]
        is_cut[new] = True
        hard.append(new)
    tail = np.arange(max(end - window, 0), end)
    hard.append(tail[~is_cut[tail]])
    extra = np.concatenate(hard)
    at, cost = np.concatenate([at, extra]), np.concatenate([cost, np.full(len(extra), ID_COST)])
    order = np.argsort(at, kind="stable")
    return at[order].tolist(), cost[order].tolist()


@cache
def _marks(path: str) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """By id: whether its piece ends a sentence, and whether one may follow it; the ids of wide stops of several pieces.

    A stop of a script with blanks needs white space in the next piece; a wide stop needs none.
    """
    tok = load(path)
    pieces = [tok.decode([i]) for i in range(tok.get_vocab_size())]
    ends = np.array([2 if p.rstrip()[-1:] in set(WIDE_STOPS) else p.rstrip()[-1:] in {".", "!", "?"} for p in pieces], np.int8)
    ends[[not p.strip() for p in pieces]] = 0
    blank = np.array([p[:1].isspace() for p in pieces])
    wide = [tok.encode(c, add_special_tokens=False).ids for c in WIDE_STOPS]
    return ends, blank, [ids for ids in wide if len(ids) > 1]


def sentence_ends(stream: np.ndarray, path: str) -> np.ndarray:
    """Places after a sentence's last id, ascending, without the end of the stream."""
    ends, blank, wide = _marks(path)
    top = np.minimum(stream, len(ends) - 1)
    stop = (ends[top][:-1] == 2) | (ends[top][:-1] == 1) & blank[top][1:]
    for ids in wide:
        n = len(stream) - len(ids)
        if n > 0:
            stop[len(ids) - 1:] |= np.logical_and.reduce([stream[k:k + n] == x for k, x in enumerate(ids)])
    return np.flatnonzero(stop) + 1


class Packer:
    """Packs one shard's documents as they come; holds at most a block of ids, or one document if that is longer."""

    def __init__(self, shard: int, path: str, end_id: int, window: int = WINDOW):
        self.shard, self.path, self.end_id, self.window = shard, path, end_id, window
        self.docs: list[list] = []  # [doc_id, ids, ids already placed]
        self.held, self.next_id = 0, 0
        self.rows: dict[str, list] = {}
        self.clear()

    def clear(self) -> None:
        self.rows = {k.split()[0]: [] for k in SCHEMA.split(", ")}

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append([doc_id, ids, 0])
        self.held += len(ids)
        if self.held >= BLOCK_IDS:
            self.solve(last=False)

    def solve(self, last: bool) -> None:
        """Cut what is held; unless ``last``, keep the ids of the final window for the next block."""
        if not self.docs:
            return
        stream = np.concatenate([ids[done:] for _, ids, done in self.docs])
        ends = np.cumsum([len(ids) - done for _, ids, done in self.docs])
        chain = best_cuts(*allowed(ends, sentence_ends(stream, self.path), self.window), self.window)
        if not last:
            chain = chain[:-1]
        self.place(chain)

    def place(self, chain: list[int]) -> None:
        """Turn windows into pieces of documents."""
        r, at, k = self.rows, 0, 0
        for end in chain[1:]:
            begin, length = at, end - at
            while at < end:
                doc_id, ids, done = self.docs[k]
                take = min(end - at, len(ids) - done)
                r["doc_id"].append(doc_id)
                r["start"].append(done)
                r["length"].append(take)
                r["ids_crc32"].append(zlib.crc32(ids[done:done + take].tobytes()))
                r["doc_tokens"].append(len(ids))
                r["shard"].append(self.shard)
                r["local_id"].append(self.next_id)
                r["offset"].append(at - begin)
                r["padded"].append(padding(length, self.window))
                self.docs[k][2] += take
                at += take
                if self.docs[k][2] == len(ids):
                    k += 1
            self.next_id += 1
        del self.docs[:k]
        self.held = sum(len(ids) - done for _, ids, done in self.docs)

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        out = record(schema, self.rows)
        self.clear()
        return out


def pack(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """Pieces of every whole text: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded``.

    Each document is its ids and ``end_id``; a null or empty text is ``end_id`` alone. Documents are taken in ascending
    ``doc_id`` (null first, equal ids by text, each row a document of its own), in ordered shards; a sequence never
    spans two shards, so each shard pads one window. ``padded`` repeats the padding of the piece's sequence. An empty
    table gives no pieces; further columns of the input are ignored.
    """
    spark = docs.sparkSession
    ordered = in_order(texts(docs)).withColumn("shard", F.spark_partition_id())

    def run(batches):
        schema, packer, encode = arrow(SCHEMA), None, encoder(path, True)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                packer = packer or Packer(part.column("shard")[0].as_py(), path, end_id, window)
                ids = encode(part.column("text").to_pylist())
                for doc_id, raw in zip(part.column("doc_id").to_pylist(), ids, strict=True):
                    packer.add(doc_id, np.frombuffer(raw + end, "<u4"))
                yield packer.batch(schema)
        if packer:
            packer.solve(last=True)
            yield packer.batch(schema)

    # written once: the shards are numbered by their place, which another run of the plan need not repeat
    pieces = settle(ordered.mapInArrow(run, SCHEMA), "packed")
    sizes = pieces.groupBy("shard").agg(F.max("local_id").alias("top"))
    # one row per shard, not per document
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("shard", F.coalesce(F.sum(F.col("top") + 1).over(before), F.lit(0)).alias("first"))
    return pieces.join(first, "shard").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("local_id")).alias("sequence_id"),
        "offset", "padded")
