"""Exact top-k by inner product: the threshold algorithm over sorted per-dimension lists, block against block.

Candidates and queries are dealt into blocks of bounded size by a hash of their ids; every block of queries meets every
block of candidates in a task of its own. Inside, each dimension has its candidates sorted by value. A query reads the
lists of its dimensions from the end that favours it, to growing depths, scores what it meets, and stops once the sum of
the best contributions still unread cannot reach its k-th score. The best k of each block are merged by one ranking.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

CANDIDATE_ROWS, QUERY_ROWS = 4096, 2048
FIRST_DEPTH, GROWTH = 16, 4
_EXACT = 1 << 53


def scaled(vector: Column, scale: int = 64) -> Column:
    """``floor(scale * x)`` of each component as long; null for a vector that is null or holds null or non-finite ones."""
    x = F.transform(vector, lambda v: v.cast("double"))
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~odd, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


class Lists:
    """Sorted per-dimension lists of one block of candidates."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T.copy()  # ascending, per dimension
        self.sorted = np.take_along_axis(vectors.T, self.order, axis=1)

    def best(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best candidates other than ``query_id``, best first, ties to the smaller id."""
        n = len(self.ids)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        seen = np.zeros(n, bool)
        rows, scores = np.zeros(0, np.int64), q[:0]
        depth, done = 0, 0
        while True:
            depth = n if not len(up) + len(down) else min(n, max(FIRST_DEPTH, depth * GROWTH))
            if depth == n:
                new = np.flatnonzero(~seen)
            else:
                met = np.zeros(n, bool)
                met[self.order[up, n - depth:n - done].ravel()] = True
                met[self.order[down, done:depth].ravel()] = True
                new = np.flatnonzero(met & ~seen)
            done = depth
            seen[new] = True
            fresh = new[self.ids[new] != query_id]
            rows = np.concatenate([rows, fresh])
            scores = np.concatenate([scores, self.vectors[fresh] @ q])
            if len(rows) > k:
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                kept = scores >= least
                rows, scores = rows[kept], scores[kept]
                order = np.lexsort((self.ids[rows], -scores))[:k]
                rows, scores = rows[order], scores[order]
            if depth == n or len(rows) >= k and self.bound(q, up, down, depth) < scores.min():
                break
        order = np.lexsort((self.ids[rows], -scores))
        return rows[order], scores[order]

    def bound(self, q: np.ndarray, up: np.ndarray, down: np.ndarray, depth: int):
        """Most that a candidate not read down to ``depth`` in any list can score."""
        n = len(self.ids)
        return self.sorted[up, n - depth] @ q[up] + self.sorted[down, depth - 1] @ q[down]


def _matrix(vectors: pd.Series, width: int) -> list[list[int]] | np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def search_block(candidates: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """Best k of one block of candidates for each query of a block."""
    found: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    if len(candidates) and len(queries):
        width = max(map(len, [*candidates["v"], *queries["v"]]))
        c, q = _matrix(candidates["v"], width), _matrix(queries["v"], width)
        reach = max(1, int(np.abs(c).max(initial=0))) * max(1, int(np.abs(q).max(initial=0))) * max(1, width)
        # doubles are exact below 2^53, Python's integers beyond
        kind = float if reach < _EXACT else object
        lists = Lists(candidates["vec_id"].to_numpy(), c.astype(kind))
        for query_id, row in zip(queries["vec_id"].tolist(), q.astype(kind), strict=True):
            rows, scores = lists.best(query_id, row, k)
            found["query_id"] += [query_id] * len(rows)
            found["vec_id"] += lists.ids[rows].tolist()
            found["score"] += [int(s) for s in scores]
    return pd.DataFrame(found).astype("int64")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of every query by integer inner product.

    A candidate with the query's id does not count. Null ids and unusable vectors take no part; shorter vectors count as
    filled up with zeros; repeated rows of one id are each a candidate and each a query of that id, of which the first k
    are kept. Fewer than k candidates: all. Empty tables give no rows.
    """
    def usable(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("vec_id"), scaled(F.col(vector_col), scale).alias("v")).where(
            "vec_id is not null and v is not null")

    c, q = usable(candidates), usable(queries)
    n_c, n_q = (max(1, math.ceil(df.count() / size)) for df, size in ((c, CANDIDATE_ROWS), (q, QUERY_ROWS)))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        # 1 of n blocks of its own kind, met by each of the m blocks of the other kind
        return df.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", F.lit(own)), F.lit(n)).cast("int").alias(own),
                         F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    found = dealt(c, "cb", n_c, "qb", n_q).groupBy("qb", "cb").cogroup(dealt(q, "qb", n_q, "cb", n_c).groupBy("qb", "cb")).applyInPandas(
        lambda left, right: search_block(left, right, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
