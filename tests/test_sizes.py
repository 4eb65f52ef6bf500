"""Findings that show on larger keys, longer texts or more copies than the smallest tables hold."""

import duckdb
from pyspark.sql import functions as F

from oracle_check import compare
from tallyforge.functions.maths import half_up
from tallyforge.operators import memory as M
from tallyforge.plans.registry import ORACLES, QUERIES, load_all

load_all()


def held(spark, tmp_path, names, **tables):
    """Whether the named queries return their SQL's rows over the tables given as SQL."""
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name, sql in tables.items():
        con.execute(f"copy ({sql}) to '{tmp_path}/{name}.parquet' (format parquet)")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    for name in names:
        n, verdict = compare(spark, con, name, QUERIES[name], ORACLES[name], str(tmp_path))
        assert n > 0 and verdict.startswith("ok"), (name, verdict)


def test_half_up_of_large_values(spark):
    row = spark.range(1).select(half_up(F.lit(3e16), 4).alias("big"), half_up(F.lit(-1e300), 2).alias("low"), half_up(F.lit(2.345), 1).alias("small")).head()
    assert tuple(row) == (3e16, -1e300, 2.3)


def test_memories_dated_after_now(spark, tmp_path):
    held(spark, tmp_path, ["memory_retention"], conversations="select 7000 + i as conv_id, i % 7 as turn, 'user' as role, 't' || i as text from range(3000) r(i)")


def test_conflicts_of_synced_memories(spark, tmp_path):
    held(spark, tmp_path, ["synced_memory_counts"], conversations="select i as conv_id, 0::bigint as turn, 'user' as role, 't' || (i // 2) as text from range(40) r(i)")


def test_gained_provenance_is_counted_and_kept(spark):
    rows = spark.sql("""select *, 'n' name, 'd' description, 'c' content, array('t') tags, 'data' memory_type, 'h' content_hash from values
        ('m1', 'desk', timestamp'2024-01-01', 'user'), ('m2', 'shell', timestamp'2024-01-02', 'user') as t(id, platform, created_at, agent)""")
    merged = M.sync_memory(M.new_store(rows.where("id = 'm1'")), M.new_store(rows.where("id = 'm2'"))).head()
    assert merged.conflicts == 1 and [p.platform for p in merged.provenance] == ["desk", "shell"]


def test_decision_records_of_long_numbers(spark, tmp_path):
    held(spark, tmp_path, ["decision_records", "decision_record_edges"], customer="select 9990 + i as c_custkey, 'AUTO' as c_mktsegment from range(40) r(i)")


def test_migrations_with_very_long_quoted_texts(spark):
    from tallyforge.operators.scan import migration_complexity

    body = "SELECT 'a;b\\'c'; SELECT '" + "x; \\' é" * 40_000 + "'; DROP TABLE t; -- \"" + "y;\n" * 40_000 + "\" ; '" + "z" * 50_000
    row = migration_complexity(spark.createDataFrame([("r", "m.sql", body)], "repo string, path string, content string")).head()
    assert (row.statements, row.score, row.complexity) == (4, 6, "high")


def test_json_is_parsed_once(spark):
    from tallyforge.operators.compaction import compact_json

    rows = spark.createDataFrame([("[1]",)], "content string")
    plan = rows.select(compact_json(F.col("content")).alias("short"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("parse_json(content") == 1


def test_ratio_is_not_computed_by_the_read(spark):
    from tallyforge.operators.mutate import store_originals

    rows = spark.range(9).select("id", (F.col("id") % 2).cast("double").alias("ratio"), F.lit("h").alias("hash"), F.lit("json").alias("content_type"), F.current_timestamp().alias("stored_at"))
    dealt = store_originals(rows.repartition(4, "id"))
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan[plan.index("RepartitionByExpression"):] and [r.id for r in dealt.collect()] == [1]


def test_texts_meet_a_small_index_in_their_tasks(spark):
    from tallyforge.operators.contain import containing

    rows = spark.createDataFrame([(1, "the quick fox"), (2, "a slow ox")], "id int, text string")
    needles = spark.createDataFrame([("fox",), ("ox",)], "needle string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = containing(rows, F.col("text"), needles)
        joins = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
        assert sorted((r.id, r.needle) for r in found.collect()) == [(1, "fox"), (1, "ox"), (2, "ox")]
        assert "rightHint=(strategy=broadcast)" in joins[1] + joins[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_failures_need_no_lines(spark):
    from tallyforge.operators import coverage as CV
    from tallyforge.plans.specs import coverage
    from tallyforge.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    plan = CV.coverage_failures(CV.merged_shares(coverage(t)), 99)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan
    assert CV.merged_shares(coverage(t)).exceptAll(CV.merge_coverage(coverage(t)).drop("uncovered_lines")).isEmpty()


def test_few_practice_requests_are_one_scan(spark):
    from tallyforge.operators import knowledge as KN
    from tallyforge.plans.scans import now
    from tallyforge.plans.stores import knowledge
    from tallyforge.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    listed = KN.suggest_practices(knowledge(t), [("Test", "jest"), ("test", "jest")], now())
    asked = spark.createDataFrame([("Test", "jest")], "task string, framework string")
    assert "Generate explode(array_distinct" not in listed._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, listed.collect())) == sorted(map(str, KN.suggest_practices(knowledge(t), asked, now()).collect()))


def test_lock_files_are_dealt(spark):
    from tallyforge.plans.inventory import lock_files
    from tallyforge.plans.registry import Tables

    plan = lock_files(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().analyzed().toString()
    assert "RepartitionByExpression [p_partkey" in plan


def test_coverage_counts_do_not_travel_with_lines(spark):
    from tallyforge.operators import coverage as CV

    kinds = ", ".join(f"9 total_{k}, n covered_{k}" for k in CV.KINDS)
    cov = spark.sql(f"""select repo, path, uncovered_lines, {kinds} from values ('r', 'a', array(3, 1, 2, null, 2), 3), ('r', 'a', array(2, 3, 7), 5),
        ('r', 'b', null, 1), (null, 'a', array(4), 2), ('r', null, array(9, 5, 6), 7), ('r', null, array(5), 0) as t(repo, path, uncovered_lines, n)""")
    for compat, want in ((False, {("r", "a"): [2, 3], ("r", "b"): [], (None, "a"): [4], ("r", None): [5]}),
                         (True, {("r", "a"): [1, 2, 3, 7], ("r", "b"): [], (None, "a"): [4], ("r", None): [5, 6, 9]})):
        merged = CV.merge_coverage(cov, compat)
        got = merged.collect()
        assert len(got) == 4 and {(r.repo, r.path): r.uncovered_lines for r in got} == want
        assert {(r.repo, r.path): r.lines_pct for r in got}[("r", "a")] == 56.0
        plan = merged._jdf.queryExecution().optimizedPlan().toString()
        assert all("total_lines" not in x and "lines_pct" not in x for x in plan.split("\n") if "Aggregate" in x and "_pos" in x)
