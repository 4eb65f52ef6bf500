"""Sinks: append, versioned overwrite, memory and debt exports, SBOM files."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F


def append_events(df: DataFrame, path: str, fmt: str = "json", day_from: str = "ts") -> None:
    """Append rows partitioned by day, so that readers prune by date."""
    df.withColumn("day", F.to_date(day_from)).write.mode("append").partitionBy("day").format(fmt).save(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever store Spark reads."""
    fs, where = _store(spark, path)
    return fs.exists(where)


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder name) of the commits of a store, oldest first."""
    fs, where = _store(spark, f"{path}/_commits")
    if not fs.exists(where):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(where)]
    return sorted((int(n), v) for n, _, v in (name.partition("-") for name in names) if n.isdigit() and v)


def _claim(spark: SparkSession, path: str, number: int) -> bool:
    """Takes a commit number by creating its lock file; False if another writer has it."""
    fs, where = _store(spark, f"{path}/_numbers/{number:012d}")
    try:
        fs.create(where, False).close()
    except Py4JJavaError as taken:
        if taken.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    return True


def overwrite_store(df: DataFrame, path: str, keep: int = 3) -> int:
    """Replace a store without touching what is being read; returns the number of the new version.

    The rows are written to a folder of their own. Then the writer takes the next free commit number by creating its file,
    which fails if another writer was first, in which case it tries the one after; so of two writers neither is lost
    and the later number is the current version. Of older versions the ``keep`` newest stay, for readers under way.
    ``df`` may itself come from ``read_store`` of the same path.
    """
    if keep < 1:
        raise ValueError("at least one version is kept")
    spark, name = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{path}/version={name}")
    number = max((n for n, _ in versions(spark, path)), default=0) + 1
    while not _claim(spark, path, number):
        number += 1
    fs, where = _store(spark, f"{path}/_commits/{number:012d}-{name}")
    fs.create(where, False).close()
    for n, old in versions(spark, path)[:-keep]:
        for gone in (f"{path}/_commits/{n:012d}-{old}", f"{path}/version={old}"):
            fs, where = _store(spark, gone)
            fs.delete(where, True)
    return number


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder name of the newest version."""
    found = versions(spark, path)
    return found[-1][1] if found else None


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a store written by ``overwrite_store``."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/version={version}")


def write_memory(store: DataFrame, path: str, fmt: str = "markdown") -> None:
    """One text block per memory."""
    from ..operators.memory import export_memory

    export_memory(store, fmt).select("text").write.text(path, lineSep="\n")


def export_debt(items: DataFrame, path: str) -> None:
    """Items and their statistics as JSON lines below ``path``."""
    from ..operators.debt import debt_breakdown, debt_score

    items.write.json(f"{path}/items")
    debt_score(items).write.json(f"{path}/score")
    debt_breakdown(items).write.json(f"{path}/breakdown")


def write_sbom(lines: DataFrame, path: str) -> None:
    """SBOM lines of ``deps.sbom`` as text, one folder per repo, in document order.

    Range partitioning by (repo, seq) keeps a large repo in several ordered part files.
    """
    ordered = lines.repartitionByRange("repo", "seq").sortWithinPartitions("repo", "seq")
    ordered.select("repo", "text").write.partitionBy("repo").text(path)
