"""Quality by pairwise preference: a Bradley-Terry model over surface features of whole texts.

Documents marked 1 are preferred to documents marked 0. The strength of a document is linear in its features; the
weights minimise the logistic loss of strength differences over preference pairs. A quantile of the training strengths
is the threshold, which the score maps to ``THRESHOLD``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .frames import map_slices, texts

#: Labelled rows of the fit per label, those of least hash first, and preference pairs drawn from them.
SAMPLE_ROWS, PAIRS = 4000, 40_000
STEPS, RATE, SHRINK = 600, 0.5, 1e-4
THRESHOLD = 0.7

_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_STOPS = b".,;:?"
_ODD = b"#$%&*+=<>@^_|~`/\\{}[]"
FEATURES = (
    "log_bytes", "upper", "root_upper", "digits", "odd", "root_odd", "bangs", "stops_per_word", "word_length", "short_words",
    "distinct_words", "distinct_long", "repeated_lines", "line_words", "no_text", "top_word", "closed")


def features(text: str) -> list[float]:
    """Surface measures of one whole text, all bounded or logarithmic."""
    raw = text.encode()
    n = max(len(raw), 1)

    def share(kinds: bytes) -> float:
        return (len(raw) - len(raw.translate(None, kinds))) / n

    words = text.split()
    nw = max(len(words), 1)
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    long = [w for w in words if len(w) > 6]
    upper, odd = share(_UPPER), share(_ODD)
    return [
        math.log1p(len(raw)), upper, math.sqrt(upper), share(_DIGITS), odd, math.sqrt(odd), min(text.count("!") / nw, 1.0),
        min((len(raw) - len(raw.translate(None, _STOPS))) / nw, 2.0), min(sum(map(len, words)) / nw, 30.0) / 10,
        sum(1 for w in words if len(w) <= 3) / nw, len(seen) / nw, len(set(long)) / max(len(long), 1),
        1 - len(set(lines)) / max(len(lines), 1), math.log1p(nw / max(len(lines), 1)), float(not words),
        max(seen.values(), default=0) / nw, float(text.rstrip()[-1:] in {".", "!", "?"})]


@dataclass(frozen=True)
class Ranking:
    """Fitted weights, centring of the features, and the map from strength to score."""

    mean: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]
    cut: float
    scale: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6) @ np.array(self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.strength(x) - self.cut) / self.scale + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray) -> Ranking:
    """Bradley-Terry weights from rows with labels 0 and 1; without both labels every score is the threshold."""
    width = len(FEATURES)
    if not len(x) or y.min() == y.max():
        return Ranking((0.0,) * width, (1.0,) * width, (0.0,) * width, 0.0, 1.0)
    mean, spread = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / spread, -6, 6)
    rng = np.random.default_rng(7)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    gap = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
    w, drift = np.zeros(width), np.zeros(width)
    for _ in range(STEPS):
        slope = -(gap * (1 / (1 + np.exp(np.clip(gap @ w, -40, 40))))[:, None]).mean(0) + SHRINK * w
        drift = 0.9 * drift + slope
        w = w - RATE * 0.1 * drift
    s = z @ w
    # the quantile that splits the labels best, middle of the best stretch
    grid = np.quantile(s, np.linspace(0.005, 0.995, 199))
    right = np.array([((s >= g) == (y == 1)).mean() for g in grid])
    best = np.flatnonzero(right >= right.max() - 1e-12)
    cut = float(grid[best[len(best) // 2]])
    return Ranking(tuple(mean.tolist()), tuple(spread.tolist()), tuple(w.tolist()), cut, float(s.std() / 2 + 1e-6))


def featured(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: the features of every whole text."""

    def step(batch):
        yield {"doc_id": batch.column("doc_id"), "x": [features(t) for t in batch.column("text").to_pylist()]}

    return map_slices(texts(docs), "doc_id long, x array<double>", step)


def learn(docs: DataFrame, labels: DataFrame) -> Ranking:
    """Fit on labelled documents: at most ``SAMPLE_ROWS`` of each label, those of least hash.

    Rows of ``labels`` with a null id, a null label or one other than 0 and 1 are left out.
    """
    marked = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("quality").alias("quality"))
    top = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = marked.withColumn("k", F.row_number().over(top)).where(F.col("k") <= SAMPLE_ROWS).drop("k")
    # at most 2 * SAMPLE_ROWS ids and labels
    few = F.broadcast(picked)
    rows = featured(texts(docs).join(few, "doc_id", "left_semi")).join(few, "doc_id").select("doc_id", "x", "quality")
    got = rows.sort("doc_id").toPandas()
    return fit(np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES)), got["quality"].to_numpy())


def score(docs: DataFrame, model: Ranking) -> DataFrame:
    """``doc_id, score, predicted`` of every whole text; null and empty texts are scored by their (zero) features."""

    def step(batch):
        p = model.score(np.array([features(t) for t in batch.column("text").to_pylist()], float).reshape(-1, len(FEATURES)))
        yield {"doc_id": batch.column("doc_id"), "score": p, "predicted": (p >= THRESHOLD).astype(int)}

    return map_slices(texts(docs), "doc_id long, score double, predicted int", step)
