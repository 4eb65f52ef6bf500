import datetime as dt
from collections import defaultdict

from pyspark.sql import functions as F

from tallyforge.operators import config as CF, deps as D, gitstats as G, history as H, memory as M, mutate as U, prompts as P
from tallyforge.operators.match import active_rules, bug_findings, usable
from tallyforge.rules.bugs import Rule
from tallyforge.sources.coverage import read_istanbul


def mem(spark, rows):
    schema = "id string, agent string, platform string, content_hash string, t int"
    df = spark.createDataFrame(rows, schema)
    ts = F.timestamp_seconds("t")
    return df.select(
        "id", F.col("id").alias("name"), F.lit("").alias("description"), F.col("content_hash").alias("content"), "agent", "platform",
        F.array().cast("array<string>").alias("tags"), F.lit("data").alias("memory_type"), ts.alias("created_at"), ts.alias("updated_at"), "content_hash")


def agents(df):
    return {r["content_hash"]: [p["agent"] for p in r["provenance"]] for r in df.collect()}


def test_upsert_adds_only_new_agents(spark):
    store = M.new_store(mem(spark, [("a", "x", "p", "h1", 1)]))
    out = M.upsert_memory(store, mem(spark, [("b", "x", "p", "h1", 2), ("c", "y", "p", "h1", 3), ("d", "z", "q", "h2", 4), ("e", "z", "q", "h2", 5)])).cache()
    assert agents(out) == {"h1": ["x", "y"], "h2": ["z"]}
    rows = {r["content_hash"]: r for r in out.collect()}
    assert rows["h1"]["id"] == "a" and rows["h1"]["updated_at"].second == 3 and rows["h2"]["id"] == "d"


def test_hot_hash_with_many_copies(spark):
    rows = [(f"m{i}", f"agent{i % 4}", "p", "hot" if i % 3 == 0 else f"h{i}", i) for i in range(600)]
    got = agents(M.new_store(mem(spark, rows)))
    want = defaultdict(set)
    for _, a, _, h, _ in rows:
        want[h].add(a)
    assert {k: set(v) for k, v in got.items()} == dict(want)


def test_carried_history_equals_one_window(spark):
    rows = [("hot" if i % 3 else f"k{i % 5}", (i * 7919) % 1000, i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, t int, seq int").withColumn("b", F.floor(F.col("t") / 50))
    frame = H.lookback(["k"], "b", ["t", "seq"]).rowsBetween(-7, -1)
    got = {(r["k"], r["seq"]): r["v"] for r in H.with_history(df, ["k"], "b", ["t", "seq"], 7).withColumn("v", F.sum("seq").over(frame)).where("NOT carried").collect()}
    byk = defaultdict(list)
    for k, t, s in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        byk[k].append(s)
    want = {(k, s): (sum(v[max(0, i - 7):i]) if i else None) for k, v in byk.items() for i, s in enumerate(v)}
    assert got == want


def test_license_pairs_equal_the_plain_product(spark):
    import random

    rnd = random.Random(1)
    lic = ["MIT", "GPL-3.0", "MPL-2.0", "ISC", "UNKNOWN"]
    rows = [(f"r{rnd.randrange(2)}", f"p{rnd.randrange(12)}", rnd.choice(lic)) for _ in range(80)]
    kind = {"MIT": "permissive", "ISC": "permissive", "GPL-3.0": "copyleft", "MPL-2.0": "restrictive"}
    want = defaultdict(int)
    for ra, pa, la in rows:
        for rb, pb, lb in rows:
            if ra == rb and pa != pb and kind.get(la) in ("copyleft", "restrictive") and kind.get(lb) == "permissive":
                want[(ra, kind[la], la, lb)] += 1
    got = {tuple(r)[:4]: r["package_pairs"] for r in D.license_conflicts(spark.createDataFrame(rows, "repo string, package string, license string")).collect()}
    assert got == dict(want)


def test_sequence_numbers_over_shards(spark):
    """One key holds most rows; a third of all rows are equal in all order columns but the last."""
    from tallyforge.operators.history import numbered

    rows = [("r" if i % 9 else None, "same" if i % 3 == 0 else f"{chr(97 + i % 7)}{i % 13:02d}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "repo string, name string, i int")
    placed = numbered(df, "repo", ["name", "i"]).collect()
    for key in ("r", None):
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        got = {r["i"]: r["seq"] for r in placed if r["repo"] == key}
        if key is not None:
            assert got == {r[2]: n for n, r in enumerate(mine, 1)}


def test_releases_and_bench_history_of_one_hot_key(spark):
    import datetime as dt
    import random

    from tallyforge.operators import gitstats as G

    r = random.Random(3)
    at = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)
    commits = [("hot" if r.random() < 0.9 else "cold", f"h{i}", "a", at(r.randrange(3000)), "feat: x") for i in range(600)]
    tags = [("hot", f"v{k:04d}", at(k)) for k in (5, 5, 700, 701, 2000)] + [("cold", "v1", at(1500)), ("none", "v9", at(1))]
    out = G.with_release(spark.createDataFrame(commits, "repo string, hash string, author string, ts timestamp, message string"),
                         spark.createDataFrame(tags, "repo string, version string, ts timestamp"))
    want = {c[1]: min(((t, v) for repo, v, t in tags if repo == c[0] and t >= c[3]), default=(None, "Unreleased"))[1] for c in commits}
    assert {x["hash"]: x["version"] for x in out.collect()} == want
    runs = [("b" if i % 10 else "other", at(r.randrange(50)), i, float(r.randrange(100))) for i in range(400)]
    got = {x["seq"]: x["baseline"] for x in G.bench_history(spark.createDataFrame(runs, "name string, ts timestamp, seq long, duration double")).collect()}
    for name in ("b", "other"):
        mine = sorted(x for x in runs if x[0] == name)
        for i, x in enumerate(mine):
            before = [y[3] for y in mine[max(0, i - 9):i]]
            assert got[x[2]] == (sum(before) / len(before) if before else None)


def test_istanbul_counts(spark):
    text = '{"a.ts":{"s":{"0":1,"1":1,"2":0},"b":{"0":[1,0]},"f":{"0":3},"l":{"1":1,"2":1,"3":0}}}'
    r = read_istanbul(spark.createDataFrame([("r", "x.json", text)], "repo string, path string, content string")).first()
    assert (r["total_statements"], r["covered_statements"], r["covered_branches"], r["covered_functions"], r["uncovered_lines"]) == (3, 2, 1, 1, [3])


def test_broken_rule_is_skipped(spark):
    rules = usable(spark, [Rule("bad", "c", "low", "([", ("*",)), Rule("good", "c", "low", "x+", ("*",)), Rule("off", "c", "low", "x", ("*",), False)])
    lines = spark.createDataFrame([("r", "a", 1, "axx", "ts")], "repo string, path string, line int, text string, lang string")
    assert [r["rule_id"] for r in bug_findings(lines, rules).collect()] == ["good"]
    assert [r.rule_id for r in active_rules(rules, ["good"])] == []


def test_bench_history(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    runs = spark.createDataFrame([("b", t(1), 1, 100.0), ("b", t(2), 2, 200.0), ("one", t(1), 3, 5.0)], "name string, ts timestamp, seq int, duration double")
    got = G.bench_regression(runs).collect()
    assert [(r["name"], r["regressed"], r["change"], r["previous"]) for r in got] == [("b", True, 100.0, 100.0)]


def test_updates_marks_and_purges(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", dt.datetime(2024, 1, 1))], "id int, v string, processed_at timestamp")
    changes = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "id int, v string, at int")
    assert sorted((r["id"], r["v"]) for r in U.apply_updates(df, changes, "id", ["v"], "at").collect()) == [(1, "y"), (2, "b")]
    marked = U.mark_processed(df, df.select("id"), F.lit("2025-01-01").cast("timestamp")).collect()
    assert {r["id"]: r["processed_at"].year for r in marked} == {1: 2025, 2: 2024}
    assert [r["id"] for r in U.purge(df, F.col("processed_at") < F.lit("2024-06-01").cast("timestamp")).collect()] == [1]


def test_env_and_rules(spark):
    kv = spark.createDataFrame([("s", "PORT", "80a"), ("s", "URL", "http://x"), ("s", "FLAG", "yes")], "service string, key string, value string")
    rules = [CF.ConfigRule("PORT", "number", True), CF.ConfigRule("URL", "url"), CF.ConfigRule("FLAG", "boolean"), CF.ConfigRule("NEED", "string", True)]
    got = sorted((r["key"], r["severity"]) for r in CF.validate_config(kv, rules).collect())
    assert got == [("FLAG", "error"), ("NEED", "error"), ("PORT", "error")]


def test_command_guard(spark):
    cases = {"rm -rf /": "deny", "rm -rf ./build": "allow", "git push --force origin main": "deny", "git push -f origin x": "warn", "git push --force-with-lease origin main": "allow", "format": "allow"}
    df = spark.createDataFrame([(c, "a.ts", False) for c in cases], "command string, path string, ignored boolean")
    assert {r["command"]: r["decision"] for r in P.risky_commands(df).collect()} == cases
