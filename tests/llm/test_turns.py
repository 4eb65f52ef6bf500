"""Conversation repair against enumeration of all edits, whole and in pieces."""

import hashlib
import random
import re
import zlib

from cases import SF, as_dicts, rows
from tallyforge.llm import turns
from tallyforge.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def every_repair(codes):
    """All edit strings with at most two inserts in a row, with cost and resulting roles; no bounds, no states."""
    def go(i, run):
        if run < 2:
            for role in "ua":
                for cost, letters, roles in go(i, run + 1):
                    yield cost + 2, "I" + letters, role + roles
        if i == len(codes):
            yield 0, "", ""
            return
        c = codes[i]
        cut = int(c.isupper())
        for cost, letters, roles in go(i + 1, 0):
            yield cost + 3, "D" + letters, roles
            if c != "-":
                yield cost + cut, "K" + letters, c.lower() + roles
                for role in "ua":
                    yield cost + cut + 2, "R" + letters, role + roles

    return go(0, 0)


def plain(codes):
    return min((cost, letters) for cost, letters, roles in every_repair(codes) if re.fullmatch("(s?(ua)+)?", roles))


def test_search_equals_enumeration():
    r = random.Random(2)
    seen = {"".join(r.choice("sSuUaAxX-") for _ in range(r.randint(0, 3))) for _ in range(150)}
    for codes in seen:
        assert turns.search(codes) == plain(codes), codes


def test_pieces_equal_the_whole():
    r = random.Random(3)
    for n in (1, 5, 40, 200):
        for _ in range(12):
            codes = "".join(r.choice("suuaaauUAx-") for _ in range(n))
            joined = turns.Joined()
            at = 0
            while at < n:
                step = r.randint(1, 9)
                found = turns.piece(codes[at:at + step])
                joined.add([c for c, _ in found], [w for _, w in found])
                at += step
            assert joined.result() == turns.search(codes)


def damage(table):
    out = []
    for conv, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        harm = zlib.crc32(key.encode()) % 20
        if harm == 0:
            continue
        if harm == 1:
            text = ""
        elif harm == 2:
            text = re.sub("[.!?]", "", text)
        elif harm == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if harm == 3 else 1)
    return out


def brute(table, search=turns.search):
    harmed = damage(table)
    out = []
    for conv in {r[0] for r in table}:
        mine = sorted((r for r in harmed if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
        seen, codes, counts = set(), "", {"-b": 0, "-d": 0, "cut": 0}
        for _, _, role, text in mine:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            if not solid:
                counts["-b"] += 1
                codes += "-"
            elif (role, text) in seen:
                counts["-d"] += 1
                codes += "-"
            else:
                c = role[:1] if role[:1] in tuple("sua") else "x"
                cut = solid[-1] not in ".!?"
                counts["cut"] += cut
                codes += c.upper() if cut else c
            seen.add((role, text))
        cost, audit = search(codes)
        dated = [r[1] for r in mine if r[1] is not None]
        gaps = max(dated) - min(dated) + 1 - len(set(dated)) if dated else 0
        initials = [r[2][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        left, it, last = [], iter(mine), None
        for letter in audit:
            role = text = None
            if letter != "I":
                _, _, role, text = next(it)
            if letter == "D":
                continue
            if letter != "K":
                role, text = "assistant" if last == "u" else "user", "" if letter == "I" else text
            last = role[:1]
            left.append(f"{role}:{text}")
        out.append((conv, gaps, counts["-b"], counts["-d"], counts["cut"], illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=repr)


def odd_table():
    r = random.Random(7)
    texts = ["Hello.", "Hi!  \n", "cut off", "", " \t", None, "Ünï. ", "same.", "x" * 5000 + "?", "\x85", "a.b"]
    roles = ["user", "assistant", "system", "tool", None, "", "User", "s"]
    table = [(c, t, r.choice(roles[:3] if r.random() < 0.8 else roles), r.choice(texts)) for c in range(60) for t in range(r.randint(1, 9))]
    table += [(None, None, None, None), (None, 1, "user", "q?"), (-3, None, "user", "b."), (-3, None, "user", "b."), (-3, 2, "assistant", "c.")]
    table += [(500, t, "user" if t % 2 else "assistant", f"text {t % 400}.") for t in range(1500) if t % 97]  # one long conversation
    table += [(501, 4, "user", "again.")] * 700  # one row many times
    return table


def test_odd_conversations(spark, monkeypatch):
    table = odd_table()
    df = spark.createDataFrame(table, SCHEMA).repartition(5)
    from pyspark.sql import functions as F

    clash = df.withColumns({n: F.lit("clash") for n in ("k", "digest", "audit", "cost", "dated")})
    want = brute(table)
    assert got(turns.report(clash)) == want
    assert got(turns.report(df.where("false"))) == []


def test_query(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = QUERIES["op12_turn_repair"](spark, SF)
    assert got(out) == brute(table)
    assert len(rows(out)) == len({r[0] for r in table}) and as_dicts(out)


def test_repaired_turns_alternate(spark):
    table = odd_table()[:300]
    harmed = turns.ordered(turns.damaged(spark.createDataFrame(table, SCHEMA)))
    plan = turns.plans(harmed)
    by = {}
    for r in turns.repaired(harmed, plan).orderBy("k", "position").collect():
        by.setdefault(r.k, []).append(r.role[:1])
    assert by and all(re.fullmatch("s?(ua)+", "".join(v)) for v in by.values())


def test_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = con.sql(ORACLES["op12_turn_repair"])
    df = QUERIES["op12_turn_repair"](spark, SF)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.select(*want.columns)) == sorted(want.fetchall(), key=repr)
