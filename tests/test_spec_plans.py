"""Version diffs: one reading of each side, odd contracts."""

from pyspark.sql import functions as F

from tallyforge.operators import specdiff as D
from tallyforge.sources import specs as SS


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def contract(spark, *rows):
    return SS.read_openapi(spark.createDataFrame(rows, "version string, content string"))


def test_api_diff_reads_and_parses_once(spark, tmp_path):
    spark.createDataFrame([("v1", '{"paths":{"/a":{"get":{}}}}'), ("v2", '{"paths":{"/b":{"get":{}}}}')], "version string, content string").write.parquet(str(tmp_path / "s"))
    out = D.api_diff(SS.read_openapi(spark.read.parquet(str(tmp_path / "s"))), "v1", "v2")
    assert plan(out).count("FileScan") == 1 and plan(out).count("try_parse_json") <= 1 and plan(out).count("Exchange hash") == 1
    assert sorted((r.type, r.path) for r in out.collect()) == [("endpoint-added", "/b"), ("endpoint-removed", "/a")]


def test_api_diff_of_odd_contracts(spark):
    old = '{"paths":{"/a":{"get":{"parameters":[{"name":"x","required":true},{"name":"y"},{"name":"y","in":"header"}],"responses":{"200":{"schema":{"type":"object"}},"201":{}}}}}}'
    new = '{"paths":{"/a":{"GET":{"parameters":[{"name":"y"},{"name":"n","required":true},{"name":"o"}],"responses":{"200":{"schema":{"type":"array"}}}}}}}'
    got = sorted((r.type, r.detail, r.breaking) for r in D.api_diff(contract(spark, ("v1", old), ("v2", new), ("v2", "not json"), ("v3", old)), "v1", "v2").collect())
    assert got == [
        ("param-removed", "New required parameter 'n' (query) was added", True),
        ("param-removed", "Optional parameter 'y' (header) was removed", True),
        ("param-removed", "Required parameter 'x' (query) was removed", True),
        ("response-changed", "Response 200 schema changed", True), ("response-changed", "Response 201 was removed", True)]
    assert D.api_diff(contract(spark, ("v1", old), ("v3", old)), "v1", "v3").collect() == []


def test_schema_diff_reads_each_side_once(spark, tmp_path):
    cols = "entity string, field string, type string, required boolean, is_unique boolean, default_value string, rel_entity string, rel_type string"
    one = [("a", "x", "int", True, False, None, None, None), ("a", "y", "int", True, False, None, None, None), ("gone", "p", "int", True, False, None, None, None),
           ("gone", "q", "int", True, False, None, None, None)]
    two = [("a", "x", "text", True, False, None, None, None), ("new", "z", "int", True, False, None, None, None)]
    for name, rows in (("one", one), ("two", two)):
        spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / name))
    before, after = (spark.read.parquet(str(tmp_path / n)) for n in ("one", "two"))
    out = D.schema_diff(before, after)
    assert plan(out).count("FileScan") == 2 and plan(out).count("Exchange hash") == 2
    assert sorted((r.entity, r.field or "", r.change) for r in out.collect()) == [
        ("a", "x", "type changed"), ("a", "y", "removed"), ("gone", "", "entity removed"), ("new", "", "entity added")]
    assert plan(D.schema_evolution(before, after)).count("FileScan") == 2
    assert sorted((r.field, r.change) for r in D.schema_evolution(before, after).collect()) == [
        ("a.x", "modified"), ("a.y", "removed"), ("gone (model)", "removed"), ("new (model)", "added")]
    assert D.schema_diff(before, before.where(F.lit(False))).count() == 2
