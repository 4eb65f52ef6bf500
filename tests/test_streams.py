import datetime as dt

from pyspark.sql import functions as F

from tallyforge.session import scratch_path
from tallyforge.streaming import runs as R, streams as S


def land(spark, rows, schema, label):
    """Write each group of rows as one file, in arrival order."""
    path = scratch_path(spark, label)
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/part={i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_decay_follows_the_sequential_model(spark):
    events = [("applied", 0), ("match", 10), ("match", 20), ("match", 200), ("applied", 210), ("match", 220), ("match", 230), ("match", 240), ("match", 250), ("match", 260)]
    rows = [("c", k, at(s)) for k, s in events]
    out = R.drain(S.correction_decay_stream(land(spark, [rows[:3], rows[3:6], rows[6:]], "correction_id string, kind string, ts timestamp", "decay-in")), "decay-test")
    got = [r["outcome"] for r in out.orderBy("us").collect()]
    assert got == ["failed", "failed", "ok", "failed", "failed", "failed", "revoked"]


def test_revocation_survives_batches(spark):
    rows = [[("c", "applied", at(0))], [("c", "match", at(i)) for i in range(1, 6)], [("c", "match", at(500))]]
    out = R.drain(S.correction_decay_stream(land(spark, rows, "correction_id string, kind string, ts timestamp", "decay-in")), "decay-test")
    assert [r["outcome"] for r in out.orderBy("us").collect()] == ["failed", "failed", "failed", "revoked"]


def test_late_rows_are_dropped(spark):
    # the watermark reached by one batch filters late rows from the batch after the next on
    rows = [[(at(0), "a")], [(at(7200), "b")], [(at(7260), "b")], [(at(5), "late")], [(at(9000), "c")]]
    out = R.drain(S.log_rate_stream(land(spark, rows, "ts timestamp, message string", "rate-in")), "rate-test")
    assert {r["minute"]: r["count"] for r in out.collect()}[at(0)] == 1


def test_consolidation_waits_for_the_minimum(spark):
    schema = "id bigint, ts timestamp, error string"
    rows = [[(i, at(i), "disk full on node") for i in range(k, k + n)] for k, n in ((0, 3), (3, 1), (4, 2), (6, 2))]
    folder = scratch_path(spark, "consolidate")
    R.start_consolidation(land(spark, rows, schema, "fail-in"), folder, f"{folder}/checkpoint", 5).awaitTermination()
    got = {r["upto"]: r["confidence"] for r in spark.read.parquet(f"{folder}/candidates").collect()}
    assert got == {2: 6}


def test_baseline_spans_batches(spark):
    schema = "service string, start timestamp, end timestamp, count bigint"
    rows = [[("a", at(60 * i), at(60 * i + 300), 1) for i in range(3)], [("a", at(600), at(900), 9)], [("a", at(660), at(960), 2)]]
    out = R.drain(S.anomaly_stream(land(spark, rows, schema, "counts-in"), 3.0), "anomaly-test").collect()
    assert [(r["start"], r["count"], r["baseline"]) for r in out] == [(at(600), 9, 1.0)]


def test_dedup_keeps_first(spark):
    rows = [[("h1", at(0)), ("h2", at(1))], [("h1", at(2))]]
    out = R.drain(S.dedup_stream(land(spark, rows, "content_hash string, created_at timestamp", "dedup-in")), "dedup-test")
    assert sorted(r["content_hash"] for r in out.collect()) == ["h1", "h2"]


def test_dedup_remembers_over_hours_and_restarts(spark):
    rows = [[("h1", at(0)), ("h2", at(1)), ("h1", at(2))], [("h3", at(40_000)), ("h1", at(40_001))], [("h2", at(90_000)), (None, at(90_001))], [(None, at(5))]]
    folder = scratch_path(spark, "dedup-store")
    stream = land(spark, rows, "content_hash string, created_at timestamp", "dedup-in")
    for _ in range(2):  # the second start finds nothing new
        R.start_dedup(stream, f"{folder}/store", f"{folder}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{folder}/store").collect()
    assert sorted((r["content_hash"] or "", r["created_at"]) for r in out) == [("", at(90_001)), ("h1", at(0)), ("h2", at(1)), ("h3", at(40_000))]


def test_promotion_waits_for_confidence_and_happens_once(spark):
    schema = "id bigint, ts timestamp, error string"
    rows = [[(i, at(i), "disk full on node")] for i in range(6)]
    lessons = land(spark, [[(99, at(0), ["keep the build small"])]], "id bigint, ts timestamp, lessons array<string>", "lesson-in")
    folder, durable = scratch_path(spark, "promotion"), spark.createDataFrame([], "context_hash string")
    found = S.candidate_stream(lessons, land(spark, rows, schema, "fail-in"))
    R.start_promotion(found, durable, f"{folder}/store", f"{folder}/checkpoint", 3).awaitTermination()
    out = spark.read.parquet(f"{folder}/store")
    assert out.count() == 1 and out.first()["confidence"] == 3


def test_scan_equals_batch(spark):
    from tallyforge.operators.debt import comment_items
    from tallyforge.sources.files import to_lines

    schema = "repo string, path string, content string"
    rows = [[("r", "a.ts", "// TODO: one\nx\n  # FIXME two")], [("r", "b.ts", "/* HACK three */")]]
    got = R.drain(S.scan_stream(land(spark, rows, schema, "scan-in")), "scan-test")
    want = comment_items(to_lines(spark.createDataFrame(rows[0] + rows[1], schema)))
    order = lambda d: sorted(map(tuple, d.select("path", "line", "tag", "message").collect()))
    assert order(got) == order(want) and len(order(got)) == 3
    assert F is not None
