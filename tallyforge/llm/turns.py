"""Conversation structure repair: the cheapest edits that give alternating turns, by depth-first branch and bound.

A conversation is its rows by turn (null turns first; rows of one turn by role, then digest of the text). A row's first
fault counts: ``blank`` (no character but white space), ``duplicate`` (role and text seen earlier in the conversation),
``truncated`` (the last such character is no full stop, exclamation or question mark). Edits: keep a row (0), rerole it to
user or assistant (2), delete it (3; the only edit of blank and duplicate rows), insert an empty user or assistant turn
anywhere (2); a truncated row that stays adds 1. What remains must be nothing, or an optional system turn and then one or
more pairs of user and assistant, told by the first letters of the roles. Of the cheapest repairs the one whose letters
(K, R, D, I, in order) are least in ASCII wins.

**Search.** A node is (row, state); the state is what the last remaining turn was. An explicit stack holds prefixes, least
letter on top; a prefix is dropped if its cost and the bound of its suffix exceed the incumbent's cost, or if the
node's dominance table holds a prefix at least as good in (cost, letters). The suffix bounds come from one backward pass
over the costs alone, and are tight, so the search only branches where costs tie. Letters and states determine each other,
hence of two prefixes of one node and cost the one with lesser letters stays lesser whatever follows.

**Scale.** Rows without their texts are range-partitioned by conversation and turn, so one conversation may span many
partitions; each contributes pieces of at most ``BLOCK`` rows, a piece the best (cost, letters) from every state to every
state, and pieces are joined in order, where prefixes share all but a short end. Duplicates come from a mergeable
minimum per (conversation, role, digest). Only the last step, which writes a conversation's repaired turns in their order
(and their SHA-256, which cannot be split), passes one conversation through one task, row by row.

Nulls: a null role or text is one space; a null conversation id is a conversation of its own. Repeated rows are duplicates.
An empty table gives an empty table. Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .frames import shards

#: Rows of a piece; bounds the search's tables.
BLOCK = 512
#: Nothing yet, after the system turn, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
FINAL = (START, ASSISTANT)
KEEP_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: State after a turn whose role is free; it is the only role that fits.
FREE_NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
#: A row's code: first letter of its role (``x`` for any but s, u, a), in upper case if truncated; ``-`` if it must go.
GONE = "-"
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
_FAR = 1 << 60
_MIN = -(1 << 63)


def _moves(code: str, state: int) -> list[tuple[str, int, int]]:
    """Edits of a row as ``letter, cost, state after``, by letter."""
    out = [("D", DELETE, state)]
    if code != GONE:
        cut = CUT if code.isupper() else 0
        kept = KEEP_NEXT.get((state, code.lower()))
        if kept is not None:
            out.append(("K", cut, kept))
        out.append(("R", REROLE + cut, FREE_NEXT[state]))
    return out


def _suffix_bounds(codes: str, final: tuple[int, ...]) -> list[list[int]]:
    """Least cost from every (row, state) to the end in one of ``final``."""
    def with_inserts(costs: list[int]) -> list[int]:
        for _ in STATES:
            costs = [min(costs[q], INSERT + costs[FREE_NEXT[q]]) for q in STATES]
        return costs

    out = [with_inserts([0 if q in final else _FAR for q in STATES])]
    for code in reversed(codes):
        after = out[-1]
        out.append(with_inserts([min(cost + after[p] for _, cost, p in _moves(code, q)) for q in STATES]))
    return out[::-1]


def search(codes: str, entry: int = START, final: tuple[int, ...] = FINAL) -> tuple[int, str] | None:
    """Cheapest (cost, letters) from ``entry`` before the first row to one of ``final`` after the last; None if there is none."""
    bounds, n = _suffix_bounds(codes, final), len(codes)
    if bounds[0][entry] >= _FAR:
        return None
    best_cost, best = bounds[0][entry], None
    dominance: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        at, state, cost, letters = stack.pop()
        if cost + bounds[at][state] > best_cost or best is not None and letters > best:
            continue
        seen = dominance.get((at, state))
        if seen is not None and seen <= (cost, letters):
            continue
        dominance[at, state] = (cost, letters)
        if at == n and state in final and (best is None or (cost, letters) < (best_cost, best)):
            best_cost, best = cost, letters
            continue
        steps = [("I", cost + INSERT, at, FREE_NEXT[state])]
        if at < n:
            steps += [(letter, cost + more, at + 1, p) for letter, more, p in _moves(codes[at], state)]
        for letter, paid, row, p in sorted(steps, reverse=True):
            if paid + bounds[row][p] <= best_cost:
                stack.append((row, p, paid, letters + letter))
    return best_cost, best


@lru_cache(maxsize=20_000)
def whole(codes: str) -> tuple[int, str]:
    """Repair of a short whole conversation; many have the same codes."""
    return search(codes)


def piece(codes: str) -> list[tuple[int, str]]:
    """Best from every state to every state, entry-major; cost -1 where there is none."""
    return [search(codes, a, (b,)) or (-1, "") for a in STATES for b in STATES]


class Joined:
    """Best prefix of a conversation by state, over its pieces in order; what all prefixes share is set aside."""

    def __init__(self):
        self.shared: list[str] = []
        self.best: dict[int, tuple[int, str]] = {START: (0, "")}

    def add(self, costs: list[int], letters: list[str]) -> None:
        out: dict[int, tuple[int, str]] = {}
        for a, (cost, prefix) in self.best.items():
            for b in STATES:
                more = costs[4 * a + b]
                if more >= 0:
                    new = (cost + more, prefix + letters[4 * a + b])
                    if b not in out or new < out[b]:
                        out[b] = new
        common = os.path.commonprefix([w for _, w in out.values()])
        if common:
            self.shared.append(common)
            out = {b: (c, w[len(common):]) for b, (c, w) in out.items()}
        self.best = out

    def result(self) -> tuple[int, str]:
        cost, end = min(self.best[q] for q in FINAL if q in self.best)
        return cost, "".join(self.shared) + end


def _faults(text: Column) -> tuple[Column, Column]:
    """Blank, truncated."""
    return ~text.rlike(r"[^\x20\x09-\x0D]"), ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")


def ordered(rows: DataFrame) -> DataFrame:
    """``k, dated, turn, role, text, digest``: clean columns and the order of rows."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    return rows.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(_MIN)).alias("k"), F.col("turn").isNotNull().alias("dated"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
        text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))


_ORDER = ("k", "dated", "turn", "role", "digest")
_PIECE = ("k long, shard int, part int, whole boolean, n long, first string, last string, has_first boolean, first_turn long, "
          "has_last boolean, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, "
          "costs array<long>, letters array<string>")
_PLAN = "k long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Piece:
    """Running facts of a stretch of one conversation."""

    def __init__(self, k, shard: int, part: int):
        self.k, self.shard, self.part = k, shard, part
        self.codes: list[str] = []
        self.first = self.last = None
        self.first_turn = self.last_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, dated: bool, turn: int, role: str, blank: bool, duplicate: bool, cut: bool) -> None:
        initial = role[:1]
        if self.first is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        if dated:
            if self.first_turn is None:
                self.first_turn = turn
            if turn != self.last_turn:
                self.turns += 1
            self.last_turn = turn
        if blank or duplicate:
            self.blank += blank
            self.duplicate += not blank
            self.codes.append(GONE)
        else:
            self.truncated += cut
            code = initial if initial in ("s", "u", "a") else "x"
            self.codes.append(code.upper() if cut else code)

    def row(self, alone: bool) -> tuple:
        codes = "".join(self.codes)
        found = [whole(codes) if len(codes) <= 64 else search(codes)] if alone else piece(codes)
        return (self.k, self.shard, self.part, alone, len(codes), self.first, self.last, self.first_turn is not None, self.first_turn or 0,
                self.last_turn is not None, self.last_turn or 0, self.turns, self.blank, self.duplicate, self.truncated, self.illegal,
                [c for c, _ in found], [w for _, w in found])


def _to_arrow(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    from .frames import arrow, record

    schema = arrow(ddl)
    return record(schema, {f.name: [r[i] for r in rows] for i, f in enumerate(schema)})


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the sorted rows of one partition. Only its first and last conversation may go on elsewhere."""
    from pyspark import TaskContext

    shard, now, before, part, out = TaskContext.get().partitionId(), None, None, 0, []
    first_key = None
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("k", "dated", "turn", "role", "digest", "blank", "cut", "later")]
        for k, dated, turn, role, digest, blank, cut, later in zip(*cols, strict=True):
            if before is None:
                first_key = k
            if now is None or k != now.k:
                if now is not None:
                    out.append(now.row(now.k != first_key and part == 0))
                now, part = _Piece(k, shard, 0), 0
            elif len(now.codes) >= BLOCK:
                out.append(now.row(False))
                part += 1
                now = _Piece(k, shard, part)
            key = (k, dated, turn, role, digest)
            now.add(dated, turn, role, blank, later or key == before, cut)
            before = key
        if len(out) > 1000:
            yield _to_arrow(out, _PIECE)
            out = []
    if now is not None:
        out.append(now.row(False))
    if out:
        yield _to_arrow(out, _PIECE)


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Plans from pieces sorted by conversation, shard and part."""
    out: list[tuple] = []
    now: dict = {}

    def close() -> None:
        if now:
            cost, audit = now["joined"].result() if now["alone"] is None else now["alone"]
            gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
            out.append((now["k"], gaps, now["blank"], now["duplicate"], now["truncated"], now["illegal"], cost, audit))

    for batch in batches:
        for r in batch.to_pylist():
            if not now or now["k"] != r["k"]:
                close()
                now = {"k": r["k"], "joined": Joined(), "alone": None, "low": None, "high": None, "turns": 0, "last": None,
                       "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
            if r["n"] == 0:
                continue
            for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
                now[name] += r[name]
            if now["last"] is not None and now["last"] + r["first"] not in LEGAL:
                now["illegal"] += 1
            now["last"] = r["last"]
            if r["has_first"]:
                if now["low"] is None:
                    now["low"] = r["first_turn"]
                elif now["high"] == r["first_turn"]:
                    now["turns"] -= 1
                now["high"] = r["last_turn"]
            if r["whole"]:
                now["alone"] = (r["costs"][0], r["letters"][0])
            else:
                now["joined"].add(r["costs"], r["letters"])
        if len(out) > 1000:
            yield _to_arrow(out, _PLAN)
            out.clear()
    close()
    if out:
        yield _to_arrow(out, _PLAN)


def plans(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``k`` (the conversation, null as the least long) and its gaps, faults, illegal neighbours, cost and audit.

    ``rows`` as ``ordered`` gives them; ``ids``: ``k`` of conversations that are to have a plan even without rows.
    """
    spark = rows.sparkSession
    blank, cut = _faults(F.col("text"))
    light = rows.select(*_ORDER, blank.alias("blank"), cut.alias("cut"))
    first = light.groupBy("k", "role", "digest").agg(F.min(F.struct("dated", "turn")).alias("first"))
    marked = light.join(first, ["k", "role", "digest"]).select(
        *_ORDER, "blank", "cut", (F.struct("dated", "turn") > F.col("first")).alias("later"))
    n = shards(spark, rows)
    pieces = marked.repartitionByRange(n, *_ORDER).sortWithinPartitions(*_ORDER).mapInArrow(_pieces, _PIECE)
    if ids is not None:
        none = ids.distinct().select("k", *[F.lit(0 if kind in ("long", "int") else None).cast(kind).alias(name) for name, kind in (
            c.split(" ") for c in _PIECE.split(", ")[1:])])
        pieces = pieces.unionByName(none)
    return pieces.repartition(n, "k").sortWithinPartitions("k", "shard", "part").mapInArrow(_join_pieces, _PLAN)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns from streams of a plan row (with the audit) and the rows of its conversation in order."""
    out: list[tuple] = []
    k, audit, at, state, position = None, "", 0, START, 0

    def emit(role: str, text: str) -> None:
        nonlocal position
        out.append((k, position, role, text))
        position += 1

    def inserts() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = FREE_NEXT[state]
            emit(ROLE[state], "")
            at += 1

    for batch in batches:
        for new, plan, role, text in zip(*(batch.column(c).to_pylist() for c in ("k", "audit", "role", "text")), strict=True):
            if plan is not None:
                inserts()
                k, audit, at, state, position = new, plan, 0, START, 0
                continue
            inserts()
            letter = audit[at]
            at += 1
            if letter == "K":
                state = KEEP_NEXT[state, role[:1]]
                emit(role, text)
            elif letter == "R":
                state = FREE_NEXT[state]
                emit(ROLE[state], text)
            if len(out) >= 256:
                yield _to_arrow(out, "k long, position long, role string, text string")
                out = []
    inserts()
    if out:
        yield _to_arrow(out, "k long, position long, role string, text string")


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``k, position, role, text`` of what the plans leave; a conversation's turns lie in one partition, in order."""
    n = shards(rows.sparkSession, rows)
    heads = plan.select("k", F.lit(0).alias("kind"), F.lit(False).alias("dated"), F.lit(0).cast("long").alias("turn"),
                        F.lit("").alias("role"), F.lit("").alias("text"), F.lit(None).cast("binary").alias("digest"), "audit")
    body = rows.select("k", F.lit(1).alias("kind"), "dated", "turn", "role", "text", "digest", F.lit(None).cast("string").alias("audit"))
    both = heads.unionByName(body).repartition(n, "k").sortWithinPartitions("k", "kind", "dated", "turn", "role", "digest")
    return both.select("k", "audit", "role", "text").mapInArrow(_applied, "k long, position long, role string, text string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    now, running = None, None
    for batch in batches:
        for k, role, text in zip(*(batch.column(c).to_pylist() for c in ("k", "role", "text")), strict=True):
            if running is None or k != now:
                if running is not None:
                    out.append((now, running.hexdigest()))
                now, running = k, hashlib.sha256()
            else:
                running.update(b"\n")
            running.update(f"{role}:{text}".encode())
        if len(out) > 1000:
            yield _to_arrow(out, "k long, sha256 string")
            out = []
    if running is not None:
        out.append((now, running.hexdigest()))
    if out:
        yield _to_arrow(out, "k long, sha256 string")


def digests(turns: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines, newline-joined, from ``repaired``; those without turns are left out."""
    return turns.mapInArrow(_digests, "k long, sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The table damaged row by row by the crc32 of ``conv_id:turn`` (nulls one space) modulo 20: 0 drops the row, 1
    empties its text, 2 removes its stops, 3 repeats it, 4 gives it to the user."""
    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    rows = conversations.select(
        "conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"),
        (F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20).alias("harm"))
    harm = F.col("harm")
    rows = rows.where(harm != 0).select(
        "conv_id", "turn", F.when(harm == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(harm == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("copies"))
    return rows.select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy")).drop("copy")


def report(conversations: DataFrame) -> DataFrame:
    """Damages the conversations, repairs them, and gives the plan and the digest of the repaired turns of each."""
    from .frames import settle

    rows = ordered(damaged(conversations))
    ids = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(_MIN)).alias("k"))
    plan = settle(plans(rows, ids), "plans")
    found = plan.join(digests(repaired(rows, plan)), "k", "left")
    return found.select(
        F.nullif(F.col("k"), F.lit(_MIN)).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
