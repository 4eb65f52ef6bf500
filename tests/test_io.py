import datetime as dt
import json

from pyspark.sql import functions as F

from tallyforge.operators import deps as D, debt as DB
from tallyforge.session import scratch_path
from tallyforge.sources import files as FI, logs as LG, manifests as MF, sinks as SK


def tree(tmp_path, files):
    for name, text in files.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_read_files_skips_folders_hidden_and_other_extensions(spark, tmp_path):
    root = tree(tmp_path, {
        "one/src/a.ts": "x\ny", "one/node_modules/b.ts": "n", "one/.git/c.ts": "n", "two/d.py": "é", "two/.hidden.py": "n", "two/e.bin": "n"})
    got = {(r["repo"], r["path"]): (r["content"], r["n_bytes"], r["ext"]) for r in FI.read_files(spark, root).collect()}
    assert got == {("one", "src/a.ts"): ("x\ny", 3, ".ts"), ("two", "d.py"): ("é", 2, ".py")}
    assert FI.read_files(spark, root, max_bytes=2).count() == 1


def test_log_jsonl_trace_and_session_readers(spark, tmp_path):
    root = tree(tmp_path, {
        "app.log": '{"timestamp":"2024-01-01T00:00:00Z","level":"error","message":"a","extra":1}\n\n2024-01-01 10:00:00 boom\n',
        "store.jsonl": '{"id":1,"v":"x"}\nnot json\n', "session-20240102.log": "[10:00:00] TASK+: a\nnoise\n"})
    logs = {r["message"]: r for r in LG.read_logs(spark, f"{root}/app.log").collect()}
    assert logs["a"]["attrs"] == {"extra": "1"} and logs["a"]["service"] == "app"
    assert logs["2024-01-01 10:00:00 boom"]["ts_raw"] == "2024-01-01 10:00:00"
    rows = LG.read_jsonl(spark, f"{root}/store.jsonl", "id int, v string").cache()
    assert rows.where("_corrupt_record IS NOT NULL").count() == 1 and rows.where("id = 1").count() == 1
    day = LG.read_session_log(spark, f"{root}/session-20240102.log").first()
    assert (day["day"], day["event"], day["detail"]) == (dt.date(2024, 1, 2), "TASK+", "a")


def test_manifest_versions(spark):
    text = json.dumps({"dependencies": {"lodash": "^4.17.20", "express": "^4.18.0"}, "devDependencies": {"vitest": "^1.0.0"}})
    files = spark.createDataFrame([("r", "package.json", text), ("r", "x/package.json", "{bad")], "repo string, path string, content string")
    got = {r["name"]: r["version"] for r in MF.read_dependencies(files).collect()}
    assert got == {"lodash": "4.17.20", "express": "4.18.0", "vitest": "1.0.0"}
    hit = D.vuln_match(MF.read_dependencies(files), D.advisories(spark)).collect()
    assert sorted(r["package"] for r in hit) == ["express", "lodash"]


def test_store_can_be_rewritten_from_itself(spark):
    path = scratch_path(spark, "store")
    SK.overwrite_store(spark.range(3), path)
    SK.overwrite_store(SK.read_store(spark, path).where("id > 0"), path)
    assert sorted(r["id"] for r in SK.read_store(spark, path).collect()) == [1, 2]


def test_store_versions_are_numbered_and_none_is_lost(spark, monkeypatch):
    from threading import Thread

    path = scratch_path(spark, "store")
    done = []
    writers = [Thread(target=lambda i=i: done.append((SK.overwrite_store(spark.range(i, i + 1), path, keep=9), i))) for i in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(n for n, _ in done) == [1, 2, 3, 4] == [n for n, _ in SK.versions(spark, path)]
    assert SK.read_store(spark, path).first()["id"] == dict(done)[4]
    # a writer that sees an old listing still gets a number of its own
    real = SK.versions
    monkeypatch.setattr(SK, "versions", lambda s, p: real(s, p)[:1])
    assert SK.overwrite_store(spark.range(7, 8), path, keep=9) == 5
    monkeypatch.setattr(SK, "versions", real)
    assert SK.overwrite_store(spark.range(8, 9), path, keep=2) == 6
    assert [n for n, _ in SK.versions(spark, path)] == [5, 6] and SK.read_store(spark, path).first()["id"] == 8


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    texts = {"a.log": "\n".join(f"a{i}" + "x" * (i % 40) for i in range(400)) + "\n", "b.b.log": "one\n\nthree", "empty.log": ""}
    root = tree(tmp_path, texts)
    want = sorted((name.split(".")[0], i + 1, line) for name, text in texts.items() for i, line in enumerate(text.split("\n")) if line)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for size in ("700b", "2500b", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert sorted((r["service"], r["line"], r["message"]) for r in LG.read_logs(spark, f"{root}/*.log").collect()) == want
    for k, v in before.items():
        spark.conf.set(k, v)


def test_append_is_partitioned_by_day(spark):
    path = scratch_path(spark, "events")
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 2))], "id int, ts timestamp")
    SK.append_events(rows, path)
    SK.append_events(rows, path)
    back = spark.read.json(path)
    assert back.count() == 4 and back.where(F.col("day") == "2024-01-02").count() == 2


def test_sbom_is_a_valid_document(spark):
    deps = spark.createDataFrame([("r", f"p{i:03d}", "1.0" if i % 2 else "*", "npm", "package.json") for i in range(250)], "repo string, name string, version string, ecosystem string, manifest string")
    lines = D.sbom(deps, "cyclonedx").orderBy("seq").collect()
    doc = json.loads("".join(r["text"] for r in lines))
    assert len(doc["components"]) == 250 and doc["components"][0]["version"] == "0.0.0" and doc["components"][7]["bom-ref"] == "pkg-8"
    path = scratch_path(spark, "sbom")
    SK.write_sbom(D.sbom(deps, "spdx"), path)
    assert spark.read.text(path).where("value LIKE 'PackageName:%'").count() == 250


def test_debt_export(spark):
    items = spark.createDataFrame([("r", "src/a.ts", 1, "bug", "major", "open", 4)], "repo string, path string, line int, type string, severity string, status string, age_days int")
    path = scratch_path(spark, "debt")
    SK.export_debt(items, path)
    assert spark.read.json(f"{path}/score").first()["score"] == 5


def test_debt_classification(spark):
    cases = {"fix this crash on null": ("bug", "critical"), "slow query needs cache": ("performance", "major"), "": ("refactor", "minor"), "SECURITY": ("security", "critical")}
    df = spark.createDataFrame([(k,) for k in cases], "message string")
    got = {r["message"]: (r["type"], r["severity"]) for r in DB.with_class(df).collect()}
    assert got == cases


def test_git_tables_under_declared_schemas(spark, tmp_path):
    from tallyforge.sources.tables import read_commits

    root = tree(tmp_path, {"c.json": '{"repo":"r","hash":"h","author":"a","ts":"2024-01-01T00:00:00Z","message":"fix: x"}\n{"repo":\n'})
    rows = read_commits(spark, f"{root}/c.json", "json").cache()
    assert rows.where("hash = 'h'").first()["ts"] == dt.datetime(2024, 1, 1)
    assert rows.where("_corrupt_record IS NOT NULL").count() == 1


def test_knowledge_rows(spark):
    from tallyforge.operators.knowledge import knowledge_rows

    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1), "Pool of connections", "Prisma", "text", None, ["a"]), (dt.datetime(2024, 1, 1), "t", "l", " ", None, [])],
                                 "ts timestamp, topic string, library string, content string, url string, tags array<string>")
    got = knowledge_rows(rows, "manual").collect()
    assert len(got) == 1 and got[0]["relevance"] == ["pool", "connections", "prisma"] and got[0]["source"] == "manual"


def test_schemas_parse():
    from pyspark.sql.types import StructType
    from tallyforge.schemas import SCHEMAS

    assert all(StructType.fromDDL(ddl).fields for ddl in SCHEMAS.values())


def test_locale_keys_of_every_depth(spark):
    from tallyforge.sources.locales import read_locales

    deep = '{"k":' * 19 + '"leaf"' + "}" * 19
    files = spark.createDataFrame([("r", "l/en.json", '{"a": "x", "e": {}, "d": ' + deep + "}"), ("r", "l/de.json", '{"a": "y"}')], "repo string, path string, content string")
    got = sorted(tuple(x) for x in read_locales(files).collect())
    assert got == [("r", "de", "a", "y"), ("r", "en", "a", "x"), ("r", "en", "d" + ".k" * 19, "leaf")]
