"""Spelling variants: words one edit apart, found by search schemes over a bidirectional FM-index.

The vocabulary is the maximal letter runs of all texts, lower-cased, with a planted deletion (``variant``), of at least
``LEAST_CHARS`` code points and ``LEAST_COUNT`` occurrences. Two words are near if one inserted, deleted or replaced code
point turns one into the other.

**Pigeonhole.** Let m be the length of the shorter of two near words. Cut at its half: the edit lies in one half, so the
other half is the beginning, or the end, of both. Each word therefore goes to four groups: of the beginnings and
ends that belong to m = its length and to m = its length - 1. Groups hold few words; where one holds more than ``OPEN``, its open
stretch, in which the edit lies, is halved again, until groups are small or the stretch is one place, where a group is
bounded by the squared alphabet. Rows grow by two per level, never by pairs.

**Search.** Groups are dealt to buckets of about ``BUCKET_CHARS`` characters. A bucket builds two FM-indexes over its
words between delimiters, one read forward and one backward, so that a pattern can be extended to the left or to the
right. A word is matched exactly from its delimiter through its fixed half, as an interval of suffix ranks, and extended
across the open stretch with one error allowed there, then exactly to the other delimiter. All words of a bucket take each
step together in numpy; an interval narrower than the alphabet is extended by the symbols it holds only.

**Forms.** A word's form is its near word of largest count (ties: least in code-point order) if that count is at least
twice its own; its root follows forms to the last. Counts at least double along a chain, so pointer doubling over
written tables takes about log2(log2(count)) rounds.

Nulls: a null text has no words; a null id enters the planted deletion as an empty id. Repeated rows count again. A table
without words gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .frames import arrow, record, settle, texts

LEAST_CHARS, LEAST_COUNT = 5, 3
#: Words in one group before its open stretch is halved again.
OPEN = 10_000
#: Characters of the words that one index holds, about.
BUCKET_CHARS = 300_000
#: Distinct words a task holds before it sends their counts on.
HELD_WORDS = 200_000
_RUN = re.compile("[a-zÀ-ÿ]+")


def variant(word: str, crc: int) -> str:
    """``word`` with one code point deleted where 97 divides the crc."""
    if crc % 97:
        return word
    at = crc % len(word)
    return word[:at] + word[at + 1:]


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n`` of all texts; counts are summed in the tasks before the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held = arrow("word string, n long"), Counter()

        def flush() -> pa.RecordBatch:
            out = record(schema, {"word": list(held), "n": list(held.values())})
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                # bytes.lower changes A-Z alone
                words = Counter(_RUN.findall(text.as_py().encode("utf-8", "replace").lower().decode()))
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in words.items():
                    word = variant(word, zlib.crc32(word.encode(), start))
                    if len(word) >= LEAST_CHARS:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield flush()
        if held:
            yield flush()

    counts = texts(docs).mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _key(m: Column, lo: Column, hi: Column) -> Column:
    """Hash of what is fixed outside the open stretch [lo, hi) of a shorter word of length m; a clash only merges groups."""
    return F.xxhash64(m, lo, hi, F.substring(F.col("word"), F.lit(1), lo), F.col("word").substr(F.length("word") - (m - hi) + 1, m - hi))


def opened(words: DataFrame) -> DataFrame:
    """``word, n, m, lo, hi, key``: each word in its four first groups."""
    def halves(m: Column) -> list[Column]:
        half = F.floor(m / 2).cast("int")
        return [F.struct(m.alias("m"), half.alias("lo"), m.alias("hi")), F.struct(m.alias("m"), F.lit(0).alias("lo"), half.alias("hi"))]

    m = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(*halves(m), *halves(m - 1))).alias("s")).select("word", "n", "s.*")
    return rows.withColumn("key", _key(F.col("m"), F.col("lo"), F.col("hi")))


def _halved(rows: DataFrame) -> DataFrame:
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    both = F.array(F.struct("m", mid.alias("lo"), "hi"), F.struct("m", "lo", mid.alias("hi")))
    out = rows.select("word", "n", F.explode(both).alias("s")).select("word", "n", "s.*")
    return out.withColumn("key", _key(F.col("m"), F.col("lo"), F.col("hi")))


def grouped(words: DataFrame) -> DataFrame:
    """``word, n, m, lo, hi, key``: every word in its groups of two to ``OPEN`` words; written once a level."""
    rows, done = settle(opened(words), "spelling-groups"), None
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.col("hi") - F.col("lo")).alias("open")).where("size > 1")
        sized = settle(rows.join(sizes, "key"), "spelling-sized")
        large = (F.col("size") > OPEN) & (F.col("open") > 1)
        small = sized.where(~large).drop("size", "open")
        done = small if done is None else done.unionByName(small)
        wide = sized.where(large)
        if wide.isEmpty():
            return done
        rows = settle(_halved(wide.drop("size", "open")), "spelling-groups")


class Index:
    """FM-index of words between delimiters: terminator 0, delimiter 1, letters from 2."""

    def __init__(self, words: list[np.ndarray], letters: int):
        one = np.ones(1, np.int64)
        self.text = np.concatenate([one, *[x for w in words for x in (w, one)], np.zeros(1, np.int64)])
        self.letters, self.size = letters, len(self.text)
        self.suffixes = self._sorted_suffixes()
        self.bwt = self.text[self.suffixes - 1]
        # rank of the pair (symbol, row) among all: the step from a row to the row of its symbol before
        self.steps = np.sort(self.bwt * self.size + np.arange(self.size))
        self.starts = np.flatnonzero(self.text == 1)

    def _sorted_suffixes(self) -> np.ndarray:
        rank, width = self.text.copy(), 1
        while True:
            after = np.zeros(self.size, np.int64)
            after[:-width] = rank[width:] + 1
            pair = rank * (self.size + 2) + after
            order = np.argsort(pair, kind="stable")
            ranked = pair[order]
            fresh = np.empty(self.size, np.int64)
            fresh[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
            if fresh[order[-1]] == self.size - 1 or width >= self.size:
                return order
            rank, width = fresh, 2 * width

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank intervals of ``symbol + pattern`` from those of the patterns."""
        base = symbols * self.size
        return np.searchsorted(self.steps, base + lo), np.searchsorted(self.steps, base + hi)

    def branches(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``row, letter`` of the letters that may stand before each pattern: those in its interval, or the whole alphabet
        where that is less."""
        width = hi - lo
        wide = np.flatnonzero(width > self.letters)
        narrow = np.flatnonzero(width <= self.letters)
        w = width[narrow]
        rows = np.repeat(narrow, w)
        at = np.repeat(lo[narrow] - np.concatenate([[0], np.cumsum(w)[:-1]]), w) + np.arange(w.sum())
        span = self.letters + 2
        pairs = np.unique(rows * span + self.bwt[at]) if len(rows) else np.zeros(0, np.int64)
        rows, letters = pairs // span, pairs % span
        real = letters > 1
        return (np.concatenate([rows[real], np.repeat(wide, self.letters)]),
                np.concatenate([letters[real], np.tile(np.arange(2, span), len(wide))]))

    def word(self, lo: np.ndarray) -> np.ndarray:
        """Number of the word whose delimited form has this rank."""
        return np.searchsorted(self.starts, self.suffixes[lo])


class _States:
    """Partial matches: the row they belong to and their rank interval."""

    def __init__(self, row, lo, hi):
        alive = lo < hi
        self.row, self.lo, self.hi = row[alive], lo[alive], hi[alive]

    def pick(self, mask) -> _States:
        return _States(self.row[mask], self.lo[mask], self.hi[mask])

    def join(self, *others: _States) -> _States:
        every = (self, *others)
        return _States(*(np.concatenate([getattr(s, f) for s in every]) for f in ("row", "lo", "hi")))


def one_error(index: Index, seq: np.ndarray, length: np.ndarray, fixed: np.ndarray, last: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``row, word``: indexed words one edit from the sequences, which are read toward the far delimiter.

    ``seq`` holds symbols, a row a sequence, padded; the first ``fixed`` of them match exactly and the edit lies at
    ``fixed`` to ``last``. Where ``shorter``, the indexed word lacks one symbol of the sequence; else one is replaced or
    the indexed word has one more.
    """
    n = len(seq)
    none = np.zeros(0, np.int64)
    lo, hi = index.extend(np.ones(n, np.int64), np.zeros(n, np.int64), np.full(n, index.size, np.int64))
    exact = _States(np.arange(n), lo, hi)
    wrong = _States(none, none, none)
    found_rows, found_words = [], []
    for at in range(seq.shape[1] + 1):
        open_ = exact.pick((fixed[exact.row] <= at) & (at <= last[exact.row]))
        ahead = [wrong]
        skipped = _States(none, none, none)
        swapped = skipped
        if len(open_.row):
            longer = open_.pick(~shorter[open_.row])
            which, letters = index.branches(longer.lo, longer.hi)
            lo, hi = index.extend(letters, longer.lo[which], longer.hi[which])
            ahead.append(_States(longer.row[which], lo, hi))
            inside = (at < last[longer.row[which]]) & (at < length[longer.row[which]])
            if at < seq.shape[1]:
                inside &= letters != seq[longer.row[which], at]
                swapped = _States(longer.row[which][inside], lo[inside], hi[inside])
            skipped = open_.pick(shorter[open_.row] & (at < length[open_.row]))
        wrong = ahead[0].join(*ahead[1:])
        ends = wrong.pick(length[wrong.row] == at)
        if len(ends.row):
            lo, hi = index.extend(np.ones(len(ends.row), np.int64), ends.lo, ends.hi)
            ends = _States(ends.row, lo, hi)
            found_rows.append(ends.row)
            found_words.append(index.word(ends.lo))
        if at == seq.shape[1]:
            break

        def read(states: _States, at: int = at) -> _States:
            states = states.pick(length[states.row] > at)
            return _States(states.row, *index.extend(seq[states.row, at], states.lo, states.hi))

        exact, wrong = read(exact), read(wrong).join(swapped, skipped)
        if not len(exact.row) and not len(wrong.row):
            break
    return np.concatenate([none, *found_rows]), np.concatenate([none, *found_words])


#: Sequences searched at once, which bounds the partial matches held.
SEARCH_ROWS = 50_000


def near_in_bucket(table: pa.Table) -> pa.Table:
    """``word, n, near, near_n`` of one bucket's rows ``word, n, m, lo, hi``."""
    words, place = np.unique(np.array(table.column("word").to_pylist(), dtype=object), return_inverse=True)
    counts = np.zeros(len(words), np.int64)
    counts[place] = table.column("n").to_numpy()
    points = [np.frombuffer(w.encode("utf-32-le"), "<u4") for w in words]
    letters, coded = np.unique(np.concatenate(points), return_inverse=True)
    sizes = np.array([len(p) for p in points])
    symbols = np.split(coded.astype(np.int64) + 2, np.cumsum(sizes)[:-1])
    m, lo, hi = (table.column(c).to_numpy().astype(np.int64) for c in ("m", "lo", "hi"))
    pairs = []
    # right of a fixed beginning, or left of a fixed end: whichever is longer
    rightward = lo >= m - hi
    for side in (True, False):
        mine = np.flatnonzero(rightward == side)
        if not len(mine):
            continue
        # extension goes to the left in an index of the text, so the one of the reversed words extends to the right
        index = Index([s[::-1] for s in symbols] if side else symbols, len(letters))
        fixed, last = (lo, hi) if side else (m - hi, m - lo)
        mine = mine[np.argsort(sizes[place[mine]], kind="stable")]
        for at in range(0, len(mine), SEARCH_ROWS):
            rows = mine[at:at + SEARCH_ROWS]
            own = place[rows]
            seq = np.zeros((len(rows), sizes[own].max()), np.int64)
            for i, w in enumerate(own):
                seq[i, :sizes[w]] = symbols[w] if side else symbols[w][::-1]
            got, near = one_error(index, seq, sizes[own], fixed[rows], last[rows], sizes[own] > m[rows])
            pairs.append(own[got] * len(words) + near)
    every = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    a, b = every // len(words), every % len(words)
    return pa.table({"word": pa.array(words[a], pa.string()), "n": counts[a], "near": pa.array(words[b], pa.string()), "near_n": counts[b]},
                    schema=arrow("word string, n long, near string, near_n long"))


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n`` of all near words, each pair both ways."""
    groups = grouped(words)
    total = groups.agg(F.sum(F.length("word"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_CHARS))
    dealt = groups.withColumn("bucket", F.pmod("key", F.lit(buckets)))
    found = dealt.groupBy("bucket").applyInArrow(near_in_bucket, "word string, n long, near string, near_n long")
    # a pair may be found from both its ends; a word has few near words, so its pairs meet in one place
    return found.repartition("word").groupBy("word", "near").agg(F.first("n").alias("n"), F.first("near_n").alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words with a form: forms followed to the last, by pointer doubling."""
    links = settle(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-links")
    while not links.where("moved").isEmpty():
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = settle(links.select("word", "root").join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-links")
    return links.select("word", "root")


def forms(words: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of a vocabulary ``word, n`` (one row a word)."""
    words = settle(words, "vocabulary")
    best = near_pairs(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    kept = -F.col("best.less") >= 2 * F.col("n")
    formed = settle(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(kept, F.col("best.near")).alias("form"),
        F.when(kept, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def report(docs: DataFrame) -> DataFrame:
    """Spelling variants of the words of all documents."""
    return forms(vocabulary(docs))
