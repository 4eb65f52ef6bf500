"""Secrets in texts: known forms by pattern, unknown ones by the Shannon entropy of sliding windows.

Base kinds are patterns: ``assign`` (a value assigned to a secret's name), ``access`` (access key ids), ``hex`` (long
lower-case hexadecimal runs). Beside them every maximal run of a character class that is at least a window long is a
candidate. A window slides over it; the counts of its characters change by one character in and one out a step, and with
them the sum of count * log2(count) from which the window's entropy follows. Windows at or above the class's threshold
that mix the character types the class asks for are joined to spans ``high_hex`` and ``high_base64``. Candidates that an
allow-list pattern covers are suppressed; the base kinds never are.

Spans count in code points, ends exclusive. A null text is the empty text and has none; every row of a repeated or null id
gets its own result; an empty table gives an empty table. A text is read whole, in one pass a kind; work and memory are
linear in its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .frames import SLICE_ROWS, texts

#: Fixed forms of the base kinds, in the order in which spans of one start stand.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
LEAST_VALUE = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE_KINDS = ("assign", "access", "hex")


class CharClass(NamedTuple):
    """Characters of a candidate, window length, bits a character a window must reach, and the least number of character
    types (lower, upper, digit) it must mix."""

    kind: str
    run: re.Pattern
    window: int
    bits: float
    types: int


CLASSES = (
    CharClass("high_hex", re.compile(r"[0-9a-fA-F]{20,}"), 20, 3.0, 2),
    CharClass("high_base64", re.compile(r"[A-Za-z0-9+/_=-]{24,}"), 24, 4.0, 2),
)
KINDS = BASE_KINDS + tuple(c.kind for c in CLASSES)
#: A candidate is no secret where one of these matches from its beginning to its end, ...
ALLOWED = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUIDs
    r".{0,100}(?i:example|sample|dummy|placeholder|changeme|your[-_]).{0,100}",  # documentation values
    r"[A-Za-z]+([-_/][A-Za-z]+)+[-_/]?\d{0,4}",  # paths and names joined from words
)
#: ... or where one of these ends right before it: labelled digests, data and links are public.
ALLOWED_BEFORE = (r"(?i:sha-?(1|224|256|384|512)|md5|integrity|checksum|commit|etag)[\"']?\s*[:= -]\s*[\"']?", r"https?://[^\s\"']*")
#: So many characters before a candidate are looked at for those.
LOOK_BACK = 200


def _c_log_c(window: int) -> list[float]:
    return [0.0] + [c * log2(c) for c in range(1, window + 1)]


def _type(ch: str) -> int:
    return 0 if "a" <= ch <= "z" else 1 if "A" <= ch <= "Z" else 2 if "0" <= ch <= "9" else 3


def high_windows(run: str, window: int, bits: float, types: int) -> Iterator[tuple[int, int, float]]:
    """``start, end, entropy`` of joined windows of ``run`` with at least ``bits`` a character; the entropy is the largest
    of the windows joined."""
    weight = _c_log_c(window)
    counts: dict[str, int] = {}
    kinds = [0, 0, 0, 0]
    total = 0.0
    least = window * (log2(window) - bits)  # the sum of c log c may be at most this
    open_at, open_end, open_bits = -1, -1, 0.0
    for i, ch in enumerate(run):
        c = counts.get(ch, 0)
        total += weight[c + 1] - weight[c]
        counts[ch] = c + 1
        kinds[_type(ch)] += 1
        if i < window - 1:
            continue
        if total <= least + 1e-9 and (kinds[0] > 0) + (kinds[1] > 0) + (kinds[2] > 0) >= types:
            at, h = i - window + 1, log2(window) - total / window
            if open_at >= 0 and at <= open_end:
                open_end, open_bits = i + 1, max(open_bits, h)
            else:
                if open_at >= 0:
                    yield open_at, open_end, open_bits
                open_at, open_end, open_bits = at, i + 1, h
        out = run[i - window + 1]
        c = counts[out]
        total += weight[c - 1] - weight[c]
        counts[out] = c - 1
        kinds[_type(out)] -= 1
    if open_at >= 0:
        yield open_at, open_end, open_bits


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """``start, kind, end`` of the base kinds."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return found


class Scanner:
    """Spans of a text; ``allowed`` and ``allowed_before`` are patterns that suppress candidates."""

    def __init__(self, classes=CLASSES, allowed=ALLOWED, allowed_before=ALLOWED_BEFORE):
        self.classes = classes
        self.allowed = re.compile("|".join(f"(?:{p})" for p in allowed)) if allowed else None
        self.before = re.compile(f"(?:{'|'.join(f'(?:{p})' for p in allowed_before)})$") if allowed_before else None

    def suppressed(self, text: str, start: int, end: int) -> bool:
        if self.allowed and self.allowed.fullmatch(text, start, end):
            return True
        return bool(self.before and self.before.search(text[max(0, start - LOOK_BACK):start]))

    def spans(self, text: str) -> tuple[list[tuple[int, str, int, float | None]], int]:
        """Spans by start, then kind, and the number of suppressed candidates."""
        found = [(*s, None) for s in base_spans(text)]
        suppressed = 0
        for c in self.classes:
            for m in c.run.finditer(text):
                high = list(high_windows(m.group(), c.window, c.bits, c.types))
                if high and self.suppressed(text, *m.span()):
                    suppressed += 1
                else:
                    found += [(m.start() + a, c.kind, m.start() + b, h) for a, b, h in high]
        found.sort(key=lambda s: (s[0], KINDS.index(s[1]), s[2]))
        return found, suppressed


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_SPAN)), ("n_suppressed", pa.int64())])
_DDL = "doc_id long, spans array<struct<kind:string,start:long,end:long,bits:double>>, n_suppressed long"


def find_secrets(docs: DataFrame, allowed=ALLOWED, allowed_before=ALLOWED_BEFORE, classes=CLASSES) -> DataFrame:
    """``doc_id, spans, n_suppressed`` of every document: spans as structs of kind, start, end and (for the entropy kinds)
    bits a character, by start, then kind. One pass over the texts, no exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(classes, allowed, allowed_before)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                spans, suppressed = [], []
                for text in part.column("text").to_pylist():
                    found, n = scanner.spans(text)
                    spans.append([{"kind": k, "start": a, "end": b, "bits": h} for a, k, b, h in found])
                    suppressed.append(n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(spans, _SCHEMA.field("spans").type), pa.array(suppressed, pa.int64())],
                    schema=_SCHEMA)

    return texts(docs).mapInArrow(run, _DDL)


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans, of every document."""
    found = find_secrets(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    high = F.filter("spans", lambda s: ~s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), F.size(high).cast("long").alias("n_entropy"), "n_suppressed")


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; overlapping spans are one. Other columns stay."""
    scanner = Scanner()

    @F.pandas_udf("string")
    def clean(column):
        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for start, _, end, _ in scanner.spans(text)[0]:
                if start >= at:
                    out += [text[at:start], mark]
                at = max(at, end)
            return "".join(out) + text[at:]

        return column.map(one)

    return docs.withColumn("text", clean("text"))
