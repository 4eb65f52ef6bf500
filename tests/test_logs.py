from pyspark.sql import functions as F

from tallyforge.operators import logs as L
from tallyforge.sources.logs import parse_log_lines, parse_spans


def entries(spark, rows):
    df = spark.createDataFrame(rows, "line bigint, ts_raw string, level string, message string")
    return df.withColumns({"ts": F.col("ts_raw").try_cast("timestamp"), "service": F.lit("a")})


def test_grouping_masks_numbers(spark):
    got = L.error_groups(entries(spark, [
        (1, None, "error", "Timeout on port 3000"), (2, None, "ERROR", "Timeout on port 4000"), (3, None, "info", "x")])).collect()
    assert [(r["pattern"], r["count"], r["example"]) for r in got] == [("timeout on port n", 2, "Timeout on port 3000")]


def test_severity_levels(spark):
    rows = [(1, None, "error", "fatal: disk")]
    rows += [(i, None, "error", "busy worker") for i in range(50)]
    rows += [(i, None, "error", "slow worker") for i in range(15)]
    rows += [(1, None, "error", "odd thing")]
    got = {r["pattern"]: r["severity"] for r in L.error_groups(entries(spark, rows)).collect()}
    assert got == {"fatal disk": "high", "busy worker": "high", "slow worker": "medium", "odd thing": "low"}


def test_short_key_falls_back_to_message(spark):
    assert L.error_groups(entries(spark, [(1, None, "error", "!!")])).first()["pattern"] == "!!"


def test_malformed_lines_are_kept(spark):
    lines = spark.createDataFrame([(1, '{"level":"info","message":"a"}'), (2, "garbage"), (3, '{"level":"error","message":"b"}'), (4, "  ")], "line int, text string")
    got = parse_log_lines(lines, "text", "line")
    over = L.log_overview(got).first()
    assert (over["total_lines"], over["error_count"]) == (3, 1)


def test_minute_buckets(spark):
    got = L.frequency(entries(spark, [
        (1, "2024-01-01T10:00:00Z", "info", "a"), (2, "2024-01-01T10:00:30Z", "info", "b"), (3, "2024-01-01T10:01:00Z", "info", "c"), (4, None, "info", "d")]))
    assert sorted((r["minute"], r["count"]) for r in got.collect()) == [("2024-01-01T10:00", 2), ("2024-01-01T10:01", 1)]


def sequential_anomalies(rows, minutes, threshold):
    """Plain reading of the rule: (ms, line, message) rows of one service."""
    rows = sorted(rows)
    base, out, seen = [], [], set()
    for i, (ms, _, msg) in enumerate(rows):
        n = sum(1 for r in rows[i:] if r[0] <= ms + minutes * 60_000)
        if base:
            avg = sum(base) / len(base)
            if n > threshold * max(avg, 1) and (ms, msg) not in seen:
                seen.add((ms, msg))
                out.append((ms, msg, n))
        base = (base + [n])[-20:]
    return out


def test_anomalies_against_sequential_model(spark):
    import random

    rnd = random.Random(5)
    data = []
    for line in range(1500):
        burst = rnd.random() < 0.3
        # a hot instant, bursts across bucket borders, and quiet hours
        ms = 1_700_000_000_000 + (rnd.choice([3_599_000, 3_600_500, 7_200_000]) + rnd.randrange(4) * 1000 if burst else rnd.randrange(40_000_000) // 1000 * 1000)
        data.append((ms, line, f"m{rnd.randrange(3)}"))
    rows = [(line, ms, msg) for ms, line, msg in data]
    df = spark.createDataFrame(rows, "line bigint, ms bigint, message string").select(
        "line", "message", F.lit("error").alias("level"), F.lit("a").alias("service"), F.timestamp_millis("ms").alias("ts"), F.col("ms").cast("string").alias("ts_raw"))
    got = sorted((int(r["ts_raw"]), r["message"], r["count"]) for r in L.anomalies(df, 5, 1.5).collect())
    assert got == sorted(sequential_anomalies(data, 5, 1.5))
    assert got


def test_anomalies_of_services_that_span_partitions(spark):
    import random

    rnd = random.Random(9)
    data = {None: [], "a": [], "b": [], "c": []}
    for line in range(1200):
        name = rnd.choice(["a"] * 8 + ["b", "c", None])
        ms = 1_700_000_000_000 + (500 if line % 3 == 0 else rnd.randrange(3_000_000))  # a third of all rows in one instant
        data[name].append((ms, line, f"m{rnd.randrange(4)}"))
    rows = [(name, *r) for name, mine in data.items() for r in mine]
    df = spark.createDataFrame(rows, "service string, ms bigint, line bigint, message string").select(
        "service", "line", "message", F.lit("error").alias("level"), F.timestamp_millis("ms").alias("ts"), F.col("ms").cast("string").alias("ts_raw"))
    want = sorted((str(name), *r) for name, mine in data.items() for r in sequential_anomalies(mine, 3, 1.2))
    for n in ("1", "4", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = sorted((str(r["service"]), int(r["ts_raw"]), r["message"], r["count"]) for r in L.anomalies(df, 3, 1.2).collect())
        assert got == want and want
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert L.anomalies(df.where("false"), 3, 1.2).collect() == []


def test_anomaly_plan_after_the_sort(spark):
    """The sorted events are read back twice; three exchanges follow the one that sorts them."""
    df = spark.range(10).selectExpr("'a' as service", "id as line", "'m' as message", "'error' as level", "timestamp_millis(id) as ts", "'x' as ts_raw")
    plan = L.anomalies(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 2 and "FileScan" not in plan and "Window" not in plan
    assert sum("Exchange" in line for line in plan.splitlines()) <= 3


def test_spans_ignore_quoted_numbers(spark):
    df = spark.createDataFrame([('{"traceId":"t","timestamp":"5"}',), ('{"trace":{"id":"t"},"startTime":2,"endTime":9}',), ('{"trace_id":"t","duration":4}',), ("nope",)], "text string")
    assert L.trace_summary(parse_spans(df)).collect() == [("t", 3, 9.0)]
