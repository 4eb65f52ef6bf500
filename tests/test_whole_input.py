"""Equal paths in several repos stay apart; no size, window or prefix length drops rows."""

import datetime as dt

from pyspark.sql import functions as F

from tallyforge.functions.text import escaped_symptom
from tallyforge.operators import coverage, debt, experience, gitstats, match, mutate, scan


def found(df):
    return sorted(map(tuple, df.collect()))


def test_coverage_of_equal_paths(spark):
    counts = "total_statements int, covered_statements int, total_branches int, covered_branches int, total_functions int, covered_functions int, total_lines int, covered_lines int"
    rows = [("r1", "x", "a.ts", *[2, 2] * 4, []), ("r2", "x", "a.ts", *[2, 0] * 4, [1, 2]), ("r2", "y", "a.ts", *[2, 1] * 4, [2]), ("r3", "x", "b.ts", *[0, 0] * 4, None)]
    cov = spark.createDataFrame(rows, f"repo string, tool string, path string, {counts}, uncovered_lines array<int>")
    got = {(r["repo"], r["path"]): (r["lines_pct"], r["uncovered_lines"]) for r in coverage.merge_coverage(cov).collect()}
    assert got == {("r1", "a.ts"): (100.0, []), ("r2", "a.ts"): (50.0, [2]), ("r3", "b.ts"): (100.0, [])}
    both = {(r["repo"], r["path"]): r["uncovered_lines"] for r in coverage.merge_coverage(cov, compat=True).collect()}
    assert both == {("r1", "a.ts"): [], ("r2", "a.ts"): [1, 2], ("r3", "b.ts"): []}


def test_authors_and_changes_of_equal_paths(spark):
    ts = dt.datetime(2024, 1, 1)
    files = spark.createDataFrame([(f"r{i}", "a.ts", f"h{i}", f"dev{i}", 1, 2, ts) for i in range(3)],
                                  "repo string, path string, hash string, author string, additions long, deletions long, ts timestamp")
    assert [r["risk"] for r in gitstats.bus_factor(files).collect()] == ["high"] * 3
    assert found(gitstats.change_summary(files)) == [(f"r{i}", "a.ts", 1, 2) for i in range(3)]
    sizes = spark.createDataFrame([("r0", "a.ts", 200_000)], "repo string, path string, n_bytes long")
    scores = {r["repo"]: (r["commits"], r["score"]) for r in gitstats.change_risk(files, sizes, F.lit(ts)).collect()}
    assert scores["r0"][1] == scores["r1"][1] + 10 and {n for n, _ in scores.values()} == {1}


def test_rollups_of_equal_paths(spark):
    todo = spark.createDataFrame([("r1", "a.ts", "TODO", None), ("r2", "a.ts", "TODO", "dev")], "repo string, path string, tag string, author string")
    rows = {(r["dim"], r["repo"], r["key"]): r["n"] for r in debt.todo_rollup(todo).collect()}
    assert rows[("path", "r1", "a.ts")] == rows[("path", "r2", "a.ts")] == 1 and rows[("tag", None, "TODO")] == 2
    bugs = spark.createDataFrame([(r, "a.ts", "critical", "security", "b1") for r in ("r1", "r2")],
                                 "repo string, path string, severity string, category string, rule_id string")
    assert match.finding_stats(bugs).first()["files"] == 2
    assert {(r["dim"], r["repo"]) for r in match.finding_rollup(bugs).collect()} == {
        ("severity", None), ("category", None), ("rule_id", None), ("path", "r1"), ("path", "r2")}


def test_permission_audit_reads_large_files(spark):
    files = spark.createDataFrame([("r", "big.ts", "x" * 2_000_000 + "\nrole: 'admin'")], "repo string, path string, content string")
    assert found(scan.permission_audit(files)) == [("admin", 1, "high")]


def test_originals_by_prefixes_of_any_length(spark):
    store = spark.createDataFrame([("abcdef-json", "1"), ("abzz-json", "2"), ("b-json", "3")], "store_id string, content string")
    wanted = spark.createDataFrame([(w,) for w in ("a", "ab", "abz", "abzz", "abcdef", "b-json", "x", "")], "store_id string")
    assert found(mutate.restore(store, wanted)) == [
        ("a", "abcdef-json", "1"), ("ab", "abcdef-json", "1"), ("abcdef", "abcdef-json", "1"), ("abz", "abzz-json", "2"),
        ("abzz", "abzz-json", "2"), ("b-json", "b-json", "3")]


def test_all_failures_count_and_ids_are_text(spark):
    rows = [(f"id{i:03d}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), f"timeout on node {i}", "sh", None) for i in range(60)]
    failures = spark.createDataFrame(rows, "id string, ts timestamp, error string, tool string, processed_at timestamp")
    got = experience.failure_suggestions(failures).collect()
    assert [(r["n"], r["symptom"]) for r in got] == [(60, "timeout on node 59")]
    late = experience.failure_suggestions(failures, since=F.lit(dt.datetime(2024, 1, 1, 0, 50))).collect()
    assert [r["n"] for r in late] == [10]


def test_symptoms_never_end_in_a_lone_escape(spark):
    text = "x" * 99 + "(("
    got = spark.createDataFrame([(text,)], "e string").select(escaped_symptom(F.col("e"))).first()[0]
    assert got == "x" * 99 + "\\("
