"""Language by cross-parsing: the language whose labelled text covers a text in the fewest longest-match phrases.

A suffix automaton per language recognises every substring of its sample. Each word, with the blanks around it, is cut
greedily into the longest pieces the automaton knows; log2(sample length) bits per phrase over the letters read give
the cross-parsing entropy in bits per letter. Phrases do not run across words, so a word's phrase counts depend on the word
alone and are computed once per worker.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .encoding import Memo
from .frames import map_slices, texts

#: The fit reads at most so many documents and letters of a language, those of least hash first, and of one document no
#: more than a ``PARTS``-th of the letters.
SAMPLE_DOCS, SAMPLE_CHARS, PARTS = 64, 30_000, 8
#: Letters of all languages together, shared evenly where there are many: the bound of what the driver holds.
ALL_CHARS = 64 * SAMPLE_CHARS
#: Sharpness of the score: base-2 weight of one bit per letter.
SHARPNESS = 8.0
#: Quantile of the labelled texts' entropies and the texts a length band needs for it; texts of fewer letters are not judged.
QUANTILE, BAND_DOCS, SHORT = 0.99, 20, 32
# Vowel signs, accents and joiners stand within words; re has no class of them.
_MARKS = "\u200c\u200d" + "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] == "M")
_LETTERS = re.compile(rf"[^\W\d_](?:[^\W\d_]|[{_MARKS}])*")
# Number forms such as fractions and circled digits are no letters, though \w has them; few texts hold any.
_NUMBERS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No"))
_STRICT = re.compile(rf"[^\W\d_{''.join(sorted(_NUMBERS))}](?:[^\W\d_{''.join(sorted(_NUMBERS))}]|[{_MARKS}])*")
#: Decimals of the entropies whose quantiles are taken: so many keep the aggregate of a band to some ten thousand numbers.
DECIMALS = 3
_FIELD = 44
_MASK = (1 << _FIELD) - 1


class Automaton:
    """Suffix automaton of a text: states as dictionaries of transitions."""

    def __init__(self, text: str):
        step: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new, p = len(step), last
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(step)
                    step.append(dict(step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[new] = copy
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = copy
                        p = link[p]
            last = new
        self.step = step

    def phrases(self, text: str) -> int:
        """Longest-match phrases that cover ``text``; an unknown character is a phrase."""
        step, n, i = self.step, 0, 0
        while i < len(text):
            state = step[0].get(text[i])
            i += 1
            n += 1
            while state is not None and i < len(text):
                state = step[state].get(text[i])
                if state is not None:
                    i += 1
        return n


def words_of(text: str) -> list[str]:
    """Runs of letters with their combining marks, in lower case."""
    return _runs(text.lower())


def _runs(text: str) -> list[str]:
    return (_LETTERS if _NUMBERS.isdisjoint(text) else _STRICT).findall(text)


def learn(docs: DataFrame) -> dict[str, str]:
    """``language -> sample`` from ``text`` and non-null ``lang`` of ``docs``: its words, joined by blanks.

    Reads the documents of least hash of each language, at most ``SAMPLE_DOCS``, until ``SAMPLE_CHARS`` letters.
    """
    return _learn(docs)[0]


def learn_bounded(docs: DataFrame) -> tuple[dict[str, str], dict[str, dict[int, float]]]:
    """The samples of ``learn`` and the most bits a letter of a text of each language, by length band.

    The bounds come from all labelled texts of ``docs`` outside the samples, each text once: their entropies under
    their own language, to ``DECIMALS``. Only quantiles reach the driver.
    """
    samples, read = _learn(docs)
    if not samples:
        return samples, {}
    known = _known(docs).where(F.col("lang").isin(list(samples))).withColumn("t", F.xxhash64("text")).where(~F.col("t").isin(sorted(read)))

    def step(batch):
        langs, bits, sizes = batch.column("lang").to_pylist(), [], []
        for lang, t in zip(langs, batch.column("text").to_pylist(), strict=True):
            letters, found = _parse(t, samples)
            bits.append(found.get(lang))
            sizes.append(band(letters))
        yield {"lang": langs, "t": batch.column("t").to_pylist(), "band": sizes, "entropy": bits}

    # texts do not leave their tasks
    parsed = map_slices(known.select("lang", "text", "t"), "lang string, t long, band int, entropy double", step).where("entropy is not null")
    rows = parsed.dropDuplicates(["lang", "t"]).groupBy("lang", "band").agg(
        F.count("*").alias("n"), F.percentile(F.round("entropy", DECIMALS), F.array(F.lit(0.5), F.lit(QUANTILE))).alias("q")).where(F.col("n") >= BAND_DOCS)
    most: dict[str, dict[int, float]] = {}
    for r in rows.collect():
        most.setdefault(r.lang, {})[r.band] = _most(*r.q, math.log2(len(samples[r.lang])))
    return samples, most


def _most(median: float, high: float, apart: float) -> float:
    return float(max(2 * high - median, (high + apart) / 2))


def bounds(rows: list[tuple[str, int, float]], apart: dict[str, float]) -> dict[str, dict[int, float]]:
    """``language -> length band -> most bits a letter`` from (language, letters, entropy) of labelled texts: what
    ``learn_bounded`` aggregates, over a list.

    Halfway from their ``QUANTILE`` to ``apart``, the bits of a text whose letters are phrases each, and at least as far
    beyond the quantile as that is from the median: the tail of odd texts of the language stays in, texts no part of
    which is known go. A band of fewer than ``BAND_DOCS`` texts has none.
    """
    bands: dict[tuple[str, int], list[float]] = {}
    for lang, letters, bits in rows:
        bands.setdefault((lang, band(letters)), []).append(bits)
    most: dict[str, dict[int, float]] = {}
    for (lang, k), bits in bands.items():
        if len(bits) >= BAND_DOCS:
            most.setdefault(lang, {})[k] = _most(np.median(bits), np.quantile(bits, QUANTILE), apart[lang])
    return most


def band(letters: int) -> int:
    """Length band: letters by powers of two."""
    return letters.bit_length()


def explained(letters: int, bits: float, own: dict[int, float]) -> bool:
    """Whether a text is within its language's bounds: that of its band, else of the next shorter one, whose texts vary more.

    True if there is none, or of fewer than ``SHORT`` letters.
    """
    k = max((k for k in own if k <= band(letters)), default=None)
    return letters < SHORT or k is None or bits <= own[k]


def _known(docs: DataFrame) -> DataFrame:
    return docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text", "doc_id").alias("h"))


def _learn(docs: DataFrame) -> tuple[dict[str, str], set[int]]:
    """Samples and the hashes of the texts they were read from; texts are cut to their share before they leave their task."""
    known = _known(docs)
    languages = known.select("lang").distinct().count()
    most = min(SAMPLE_CHARS, max(1, ALL_CHARS // max(1, languages)))
    share = -(-most // PARTS)

    def step(batch):
        cut = [" ".join(words_of(t))[:share] for t in batch.column("text").to_pylist()]
        yield {"lang": batch.column("lang").to_pylist(), "k": batch.column("k").to_pylist(), "words": cut, "t": batch.column("t").to_pylist()}

    top = Window.partitionBy("lang").orderBy("h", "text")
    picked = known.withColumn("k", F.row_number().over(top)).where(F.col("k") <= SAMPLE_DOCS).withColumn("t", F.xxhash64("text"))
    samples: dict[str, str] = {}
    read: set[int] = set()
    for lang, _, words, t in map_slices(picked, "lang string, k int, words string, t long", step).sort("lang", "k").toLocalIterator():
        if len(samples.get(lang, "")) < most:
            samples[lang] = samples.get(lang, " ") + words + " "
            read.add(t)
    return {lang: s[:most] for lang, s in samples.items() if s.strip()}, read


@lru_cache(maxsize=1)
def _parser(samples: tuple[tuple[str, str], ...]) -> tuple[Memo, list[float]]:
    own = [Automaton(s) for _, s in samples]

    def packed(word: str) -> int:
        # letters in the lowest field, then the phrases of each language; sums of these ints add field by field
        parts = _runs(word)
        n = sum(map(len, parts))
        for k, a in enumerate(own):
            n += sum(a.phrases(f" {p} ") for p in parts) << _FIELD * (k + 1)
        return n

    return Memo(lambda keys: [packed(k) for k in keys]), [math.log2(len(s)) for _, s in samples]


def _parse(text: str, samples: dict[str, str]) -> tuple[int, dict[str, float]]:
    """Letters of a text and its bits per letter under each language; none if it has no letter."""
    memo, bits = _parser(tuple(sorted(samples.items())))
    total = sum(memo.take([text.lower().split()])[0])
    letters = total & _MASK
    if not letters:
        return 0, {}
    return letters, {lang: bits[k] * (total >> _FIELD * (k + 1) & _MASK) / letters for k, lang in enumerate(sorted(samples))}


def entropies(text: str, samples: dict[str, str]) -> dict[str, float]:
    """Bits per letter under each language; empty if the text has no letter."""
    return _parse(text, samples)[1]


def decide(found: dict[str, float]) -> tuple[str, float]:
    """Language of least entropy (ties to the smaller name) and its share of the weights."""
    if not found:
        return "und", 0.0
    best = min(found, key=lambda k: (found[k], k))
    return best, 1 / sum(2 ** (SHARPNESS * (found[best] - h)) for h in found.values())


def predict(docs: DataFrame, samples: dict[str, str], most: dict[str, dict[int, float]] | None = None) -> DataFrame:
    """``doc_id, lang_pred, score, entropy, explained`` of every whole text.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learned. ``explained``: not beyond the
    bounds ``most`` of its language (see ``learn_bounded``). One row per input row; further columns are ignored.
    """

    def step(batch):
        said, score, bits, within = [], [], [], []
        for t in batch.column("text").to_pylist():
            letters, found = _parse(t, samples) if samples else (0, {})
            lang, s = decide(found)
            said.append(lang)
            score.append(s)
            bits.append(found.get(lang))
            within.append(lang in found and explained(letters, found[lang], (most or {}).get(lang, {})))
        yield {"doc_id": batch.column("doc_id"), "lang_pred": said, "score": score, "entropy": bits, "explained": within}

    return map_slices(texts(docs), "doc_id long, lang_pred string, score double, entropy double, explained boolean", step)
