"""Readers of canonical tables landed as Parquet or JSON lines: git exports, stores, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import SCHEMAS
from .logs import read_jsonl


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """A canonical table under its declared schema; JSON rows that do not fit are flagged."""
    if fmt == "parquet":
        return spark.read.schema(SCHEMAS[name]).parquet(path)
    if fmt == "json":
        return read_jsonl(spark, path, SCHEMAS[name])
    raise ValueError(f"unknown format {fmt}")


def read_commits(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, "commits", path, fmt)


def read_commit_files(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, "commit_files", path, fmt)


def read_blame(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, "blame", path, fmt)
