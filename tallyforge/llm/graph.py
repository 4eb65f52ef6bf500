"""Connected components by contraction: joins and mergeable aggregates only, no neighbour lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .frames import settle


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of every node of ``a, b`` edges; the label is the least node of its component.

    Each round moves every node to its neighbour (or itself) of least hash, under a hash of the round's own, and keeps the
    edges between different targets; a constant share of the nodes goes per round, whatever the shape. A node of
    many edges costs one partial minimum per task. Every round is written to the shared folder.
    """
    left = settle(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("label", F.col("node"))
    turn = 0
    while not left.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        both = left.select(F.col("a").alias("label"), rank("b").alias("r")).union(left.select(F.col("b").alias("label"), rank("a").alias("r")))
        best = both.groupBy("label").agg(F.min("r").alias("r"))
        moves = settle(best.select("label", F.least("r", rank("label"))["to"].alias("to")), "moves")
        labels = settle(labels.join(moves, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        left = left.join(moves.select(F.col("label").alias("a"), F.col("to").alias("x")), "a").join(
            moves.select(F.col("label").alias("b"), F.col("to").alias("y")), "b")
        left = settle(left.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        turn += 1
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    return settle(labels.join(least, "label").select("node", F.col("least").alias("label")), "components")
