"""Best k items of each query, by a score over what both hold, without a row per pair.

Items fall into shards and queries into blocks. A group is a block of queries and what a shard's items hold of it: its pairs are added
up in arrays, and only the best k of each query leave the group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .contain import few
from .history import first_rows

#: Items of a shard and queries of a block, at most about so many.
SHARD, BLOCK = 8192, 512

#: (sums, biases of the items, size of the query) to scores; what is no match scores -inf.
Score = Callable[[np.ndarray, np.ndarray, float], np.ndarray]


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above -inf, of equal ones the first."""
    at = np.flatnonzero(scores > -np.inf)
    if len(at) <= k:
        return at
    own = scores[at]
    least = np.partition(own, len(at) - k)[len(at) - k]
    above = at[own > least]
    return np.concatenate([above, at[own == least][:k - len(above)]])


def _group(items: pa.Table, asked: pa.Table, k: int, score: Score, out: pa.Schema) -> pa.Table:
    held, sought = items.column("item").combine_chunks(), asked.column("query").combine_chunks()
    names, queries = held.unique(), sought.unique()
    names = names.take(pc.sort_indices(names))
    features = asked.column("feature").combine_chunks().unique()
    place = pc.index_in(held, value_set=names).to_numpy(zero_copy_only=False)
    code = pc.index_in(items.column("feature").combine_chunks(), value_set=features).fill_null(-1).to_numpy(zero_copy_only=False)
    bias = np.zeros(len(names))
    bias[place] = items.column("bias").to_numpy()
    order = np.argsort(code, kind="stable")
    value, place = items.column("value").to_numpy()[order], place[order]
    start = np.searchsorted(code[order], np.arange(len(features) + 1))

    wants = pc.index_in(sought, value_set=queries).to_numpy(zero_copy_only=False)
    turn = np.argsort(wants, kind="stable")
    wanted = pc.index_in(asked.column("feature").combine_chunks(), value_set=features).to_numpy(zero_copy_only=False)[turn]
    weight, size = asked.column("weight").to_numpy()[turn], asked.column("size").to_numpy()[turn]
    first = np.searchsorted(wants[turn], np.arange(len(queries) + 1))
    who, which, points = [], [], []
    for q in range(len(queries)):
        sums = np.zeros(len(names))
        for i in range(first[q], first[q + 1]):
            lo, hi = start[wanted[i]], start[wanted[i] + 1]
            sums[place[lo:hi]] += weight[i] * value[lo:hi]
        scores = score(sums, bias, size[first[q]])
        best = _best(scores, k)
        who.append(np.full(len(best), q))
        which.append(best)
        points.append(scores[best])
    who, which, points = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (who, which, points))
    return pa.Table.from_arrays([queries.take(pa.array(who, pa.int64())), names.take(pa.array(which, pa.int64())), pa.array(points, pa.float64())], schema=out)


def counted(df: DataFrame) -> Column:
    """Number of rows as a scalar."""
    return df.select(F.count(F.lit(1))).scalar()


def best_items(items: DataFrame, asked: DataFrame, k: int, score: Score, n_items: Column) -> DataFrame:
    """``query, item, score`` of the ``k`` items of highest score of each query, ties to the least item.

    items(item, bias, feature, value): one row per item and feature, ``bias`` the item's own. asked(query, size, feature,
    weight): one row per query and feature, ``size`` the query's own. The sum of a pair is that of weight times value over
    the features of both, 0 without any; all sums must be exact, as they are added in no fixed order. No key is null. ``n_items``
    is about the number of items, see ``counted``; only the size of the shards depends on it.
    """
    spark = items.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def cuts(n: Column, most: int) -> Column:
        return F.greatest(F.ceil(n / most).cast("int"), F.lit(1))

    blocks, shards = cuts(counted(asked.select("query").distinct()), BLOCK), cuts(n_items, SHARD)
    dealt = asked.withColumn("_block", F.pmod(F.xxhash64("query"), blocks).cast("int"))
    homes = dealt.select("feature", "_block").distinct()
    # a feature of most items would otherwise be one key of the exchange
    left = items.join(F.broadcast(homes) if few(homes) else homes, "feature").withColumn("_shard", F.pmod(F.xxhash64("item"), shards).cast("int"))
    right = dealt.withColumnRenamed("_block", "_b").withColumn("_s", F.explode(F.sequence(F.lit(0), shards - 1)))
    schema = T.StructType([T.StructField("query", asked.schema["query"].dataType), T.StructField("item", items.schema["item"].dataType), T.StructField("score", T.DoubleType())])

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out = pa.schema([("query", theirs.schema.field("query").type), ("item", mine.schema.field("item").type), ("score", pa.float64())])
        if not mine.num_rows or not theirs.num_rows:
            return out.empty_table()
        return _group(mine, theirs, k, score, out)

    # into a given number of parts: others are merged by their bytes, while the pairs are many times the rows
    mine, theirs = ["_shard", "_block"], ["_s", "_b"]
    met = left.repartition(parts, *mine).groupBy(*mine).cogroup(right.repartition(parts, *theirs).groupBy(*theirs)).applyInArrow(run, schema)
    return first_rows(met, ["query"], [F.col("score").desc(), F.col("item")], k)
