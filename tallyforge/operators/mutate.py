"""Store changes as whole-table transformations: update, mark, purge, keep originals, counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .history import distinct_first, first_rows


def apply_updates(df: DataFrame, changes: DataFrame, key: str, columns: Sequence[str], latest: str | None = None) -> DataFrame:
    """Overwrite ``columns`` where a change exists; with ``latest`` the newest change per key wins."""
    if latest:
        changes = first_rows(changes, [key], [F.col(latest).desc()])
    c = changes.select(key, *[F.col(x).alias(f"_{x}") for x in columns])
    joined = df.join(c, key, "left")
    return joined.select(*[
        F.coalesce(f"_{x}", x).alias(x) if x in columns else F.col(x) for x in df.columns])


def mark_processed(df: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Stamp rows whose id is listed and that carry no stamp yet."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return df.join(hit, "id", "left").withColumn(
        "processed_at", F.coalesce("processed_at", F.when(F.col("_hit"), at))).drop("_hit")


def purge(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that do not meet the condition; a null condition keeps the row."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def older_than(ts: str, now: Column, hours: int) -> Column:
    return F.col(ts) < now - F.make_dt_interval(hours=F.lit(hours))


def delete_by_id(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def bump_usage(df: DataFrame, uses: DataFrame) -> DataFrame:
    """Add use counts and the last use time per id; uses(id, ts) is aggregated before the join."""
    u = uses.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.max("ts").alias("_last"))
    return df.join(u, "id", "left").withColumns({
        "applied_count": F.col("applied_count") + F.coalesce("_n", F.lit(0)),
        "last_applied_at": F.greatest("last_applied_at", "_last"),
    }).drop("_n", "_last")


def stale_items(items: DataFrame, usage: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Items idle for more than ``days``: last use, else the modified time."""
    last = usage.groupBy("name").agg(F.max("ts").alias("_last"))
    idle = (F.unix_micros(now) - F.unix_micros(F.coalesce("_last", "modified_at"))) / F.lit(86_400_000_000.0)
    return items.join(last, "name", "left").withColumn("idle_days", F.floor(idle).cast("bigint")).where(idle > days).drop("_last")


def suppress(rules: DataFrame, ids: DataFrame) -> DataFrame:
    return rules.join(ids.select("rule_id").distinct(), "rule_id", "left_anti")


def store_originals(df: DataFrame, existing: DataFrame | None = None, min_ratio: float = 0.15) -> DataFrame:
    """Texts worth keeping: saving at least ``min_ratio``; the first write of a (hash, type) wins."""
    # tested after the choice: a filter before it would move, with all that the ratio is computed from, to the read of the input
    worth = df.withColumn("_ok", F.coalesce(F.col("ratio") >= min_ratio, F.lit(False)))
    kept = distinct_first(worth, ["hash", "content_type"], [F.col("_ok").desc(), F.col("stored_at"), F.col("id")]).where("_ok").drop("_ok")
    kept = kept.withColumn("store_id", F.concat_ws("-", "hash", "content_type"))
    return kept if existing is None else kept.join(existing.select("store_id"), "store_id", "left_anti")


def restore(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """Originals by exact store id, or by hash prefix where no exact id exists.

    wanted(store_id). A prefix of four or more characters joins on its first four; for each shorter length the store is
    first reduced to the least id per prefix. The empty prefix finds nothing.
    """
    exact = wanted.join(store, "store_id").select(F.col("store_id").alias("wanted"), "store_id", "content")
    rest = wanted.select(F.col("store_id").alias("wanted")).join(
        exact.select("wanted"), "wanted", "left_anti")
    long = rest.where(F.length("wanted") >= 4).withColumn("_k", F.left("wanted", F.lit(4)))
    hits = long.join(store.withColumn("_k", F.left("store_id", F.lit(4))), "_k").where(
        F.col("store_id").startswith(F.col("wanted")))
    prefix = hits.groupBy("wanted").agg(F.min_by(F.struct("store_id", "content"), "store_id").alias("_s")).select(
        "wanted", "_s.store_id", "_s.content")
    for n in (1, 2, 3):
        least = store.groupBy(F.left("store_id", F.lit(n)).alias("wanted")).agg(
            F.min_by(F.struct("store_id", "content"), "store_id").alias("_s"))
        short = rest.where(F.length("wanted") == n).join(least, "wanted")
        prefix = prefix.unionByName(short.select("wanted", "_s.store_id", "_s.content"))
    return exact.unionByName(prefix)
