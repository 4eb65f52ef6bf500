"""Log, trace and session readers; corrupt lines are kept and flagged, never lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

from ..functions import dates


def parse_log_lines(lines: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """One log entry per non-blank line: JSON objects by field, anything else as raw text.

    ``attrs`` holds the remaining JSON fields as strings.
    """
    doc = F.try_parse_json(F.col(text))
    kind = F.schema_of_variant(F.col("_doc"))
    obj = F.col("_doc").isNotNull() & (kind.startswith("OBJECT") | kind.startswith("ARRAY"))

    def field(name: str):
        return F.try_variant_get("_doc", f"$.{name}", "string")

    raw_ts = F.when(F.col("is_raw"), dates.sniff_ts(F.col(text))).otherwise(field("timestamp"))
    core = F.array(F.lit("timestamp"), F.lit("level"), F.lit("message"))
    attrs = F.map_filter(
        F.from_json(F.col(text), "map<string,string>"), lambda k, v: ~F.array_contains(core, k)
    )
    return (
        lines.where(F.trim(F.regexp_replace(text, r"\s+", " ")) != "")
        .withColumn("_doc", doc)
        .withColumn("is_raw", ~F.coalesce(obj, F.lit(False)))
        .select(
            *keep,
            raw_ts.alias("ts_raw"),
            dates.to_ts(raw_ts).alias("ts"),
            F.when(~F.col("is_raw"), field("level")).alias("level"),
            F.when(F.col("is_raw"), F.col(text)).otherwise(field("message")).alias("message"),
            "is_raw",
            F.when(~F.col("is_raw"), attrs).alias("attrs"),
        )
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of text files, lines numbered from 1 within their file however it is split.

    The lines of a split are read in order; what stands before it is the sum of the counts of the file's earlier splits, one
    row per split.
    """
    raw = spark.read.text(path).select(
        F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"))
    splits = raw.groupBy("file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    earlier = W.partitionBy("file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    placed = splits.select("file", "_start", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return raw.join(placed, ["file", "_start"]).select("file", (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("line"), "text")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log entries of text files; ``service`` is the file's base name without suffix, ``line`` the number within the file."""
    name = F.regexp_extract("file", r"([^/.]*)[^/]*$", 1)
    return parse_log_lines(read_lines(spark, path).select("text", name.alias("service"), "line"), "text", "service", "line")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines under a declared schema; unparsable rows keep their text in ``_corrupt_record``."""
    from pyspark.sql.types import StringType

    declared = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    full = StructType(list(declared.fields)).add("_corrupt_record", StringType())
    return (
        spark.read.schema(full)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )


def parse_spans(lines: DataFrame, text: str = "text") -> DataFrame:
    """spans(trace_id, start_time, end_time) of JSON trace lines; id aliases coalesced.

    A numeric ``timestamp`` is both ends; else startTime/endTime; else 0..duration.
    """
    schema = (
        "traceId string, trace_id string, trace struct<id:string>, timestamp double, startTime double, "
        "endTime double, duration double")
    # a quoted number does not fit DOUBLE and stays null; inline keeps the parse to one per line,
    # where a filter pushed below a projection would repeat it for every field
    stamp, start, end, dur = (F.col(f) for f in ("timestamp", "startTime", "endTime", "duration"))
    ranged = start.isNotNull() | end.isNotNull()
    ids = [F.col("traceId"), F.col("trace_id"), F.col("trace.id")]
    return (
        lines.select(F.inline(F.array(F.from_json(F.col(text), schema))))
        .select(
            F.coalesce(*[F.nullif(i, F.lit("")) for i in ids]).alias("trace_id"),
            F.when(stamp.isNotNull(), stamp).when(ranged, start)
            .when(dur.isNotNull(), F.lit(0.0)).alias("start_time"),
            F.when(stamp.isNotNull(), stamp).when(ranged, end).otherwise(dur).alias("end_time"),
        )
        .where(F.col("trace_id").isNotNull())
    )


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("pathGlobFilter", "*.jsonl").text(path)
    return parse_spans(raw.select(F.col("value").alias("text")))


def parse_session_log(lines: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """(clock, event, detail) of ``[HH:MM:SS] EVENT: detail`` lines; other lines dropped."""
    shape = r"^\[(\d{2}:\d{2}:\d{2})\] ([^:]+): ?(.*)$"
    return lines.where(F.col(text).rlike(shape)).select(
        *keep,
        F.regexp_extract(text, shape, 1).alias("clock"),
        F.regexp_extract(text, shape, 2).alias("event"),
        F.regexp_extract(text, shape, 3).alias("detail"),
    )


def read_session_log(spark: SparkSession, path: str) -> DataFrame:
    """Session events with the date taken from the ``session-YYYYMMDD.log`` file name."""
    day = F.to_date(F.regexp_extract("_metadata.file_name", r"(\d{8})", 1), "yyyyMMdd")
    raw = spark.read.text(path).select(F.col("value").alias("text"), day.alias("day"))
    return parse_session_log(raw, "text", "day")
