"""Helpers shared by the corpus operators: clean inputs, written cuts, ordered shards, key folding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path

#: Rows handled at once inside a Python task; bounds what one step holds besides its Arrow batch.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` alone, a null text as the empty text; other columns cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The cut survives the loss of any executor: storage holds it, not an executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shards(spark: SparkSession, docs: DataFrame) -> int:
    """Number of ordered shards: as many as the shuffle setting or the splits of the input, whichever is more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())


def in_order(docs: DataFrame) -> DataFrame:
    """Range-partitioned by ``doc_id`` and sorted; equal ids stay together, in order of their texts."""
    n = shards(docs.sparkSession, docs)
    return docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")


_KINDS = {
    "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string(),
    "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
    "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()),
}


def arrow(ddl: str) -> pa.Schema:
    """Arrow schema of ``name kind, name kind``; works in tasks, which have no session."""
    return pa.schema([(name, _KINDS[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


def record(schema: pa.Schema, cols: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in schema], schema=schema)


def map_slices(df: DataFrame, ddl: str, step: Callable[[pa.RecordBatch], Iterator[dict[str, list]]]) -> DataFrame:
    """``mapInArrow`` over slices of at most ``SLICE_ROWS`` rows; ``step`` yields columns as lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = arrow(ddl)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for cols in step(batch.slice(at, SLICE_ROWS)):
                    yield record(out, cols)

    return df.mapInArrow(run, ddl)
