"""Looking back over long ordered histories without one task per key.

A window partitioned by (key, bucket) sees only its own bucket. ``with_history`` adds to
every bucket the last ``k`` rows that precede it, flagged ``carried``, so that frames of up
to ``k`` preceding rows give exactly the result of a window over the whole key, while a hot
key is still spread over all of its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import pinned


def with_history(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], k: int
) -> DataFrame:
    """``df`` plus, per (keys, bucket), the ``k`` rows before it in ``order`` with carried = true.

    ``bucket`` must be monotone in ``order`` within a key.
    """
    payload = [c for c in df.columns if c not in keys and c != bucket]
    last = W.partitionBy(*keys, bucket).orderBy(*[F.col(c).desc() for c in order])
    # the rank filter is applied before the exchange as well, so a tail is k rows per task
    tails = (
        df.withColumn("_rk", F.row_number().over(last))
        .where(F.col("_rk") <= k)
        .groupBy(*keys, bucket)
        .agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in payload if c not in order]))).alias("_tail"))
    )
    # every non-empty bucket holds at least one row: k buckets back always suffice
    back = W.partitionBy(*keys).orderBy(bucket).rowsBetween(-k, -1)
    carried = (
        tails.withColumn("_prev", F.flatten(F.collect_list("_tail").over(back)))
        .withColumn("_row", F.explode(F.slice("_prev", F.greatest(F.size("_prev") - (k - 1), F.lit(1)), F.lit(k))))
        .select(*keys, bucket, *[F.col(f"_row.{c}").alias(c) for c in payload], F.lit(True).alias("carried"))
    )
    return df.select(*keys, bucket, *payload, F.lit(False).alias("carried")).unionByName(carried)


def lookback(keys: Sequence[str], bucket: str, order: Sequence[str]) -> W:
    """Window spec matching ``with_history``."""
    return W.partitionBy(*keys, bucket).orderBy(*[F.col(c) for c in order])


def sharded(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with ``_shard``, monotone in ``order`` within a key: rows are range-partitioned and kept as they lie.

    A key holding most rows spans as many shards as its share; whatever must cross from one shard to the next is a row
    per (key, shard). Null and equal rows keep together.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(n, *keys, *order).withColumn("_shard", F.spark_partition_id())
    return pinned(cut)


def numbered(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Adds ``seq`` 1..n per key in ``order``: ranks inside (key, shard), shifted by the counts of earlier shards."""
    placed = sharded(df, [key], order)
    counts = placed.groupBy(key, "_shard").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(key).orderBy("_shard").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(key, "_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy(key, "_shard").orderBy(*order)
    return (
        placed.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [key, "_shard"])
        .withColumn("seq", (F.col("_rn") + F.col("_off")).cast("bigint"))
        .drop("_shard", "_rn", "_off")
    )


def time_bucket(ts_ms: Column, width_ms: int) -> Column:
    return F.floor(ts_ms / F.lit(width_ms))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """First ``k`` rows per key; the rank limit also runs before the exchange."""
    spec = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rk", F.row_number().over(spec)).where(F.col("_rk") <= k).drop("_rk")


def distinct_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first seen in ``order``."""
    return first_rows(df, keys, order, 1)


def top_groups(df: DataFrame, dims: Sequence[str], k: int, count: str = "n") -> DataFrame:
    """The ``k`` most frequent groups; ties broken by the group itself."""
    return (
        df.groupBy(*dims).agg(F.count(F.lit(1)).alias(count))
        .orderBy(F.col(count).desc(), *dims)
        .limit(k)
    )
