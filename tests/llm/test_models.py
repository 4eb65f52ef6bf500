"""Language identification and quality: parsing against brute force, accuracy on documents kept from the fit."""

import math
import zlib

import numpy as np
import pytest

from cases import as_dicts, clashing, empty, odd_documents, rows
from tallyforge.llm import langid, quality
from tallyforge.llm.queries import QUERIES

LARGER = "/root/testdata/sf0.01"


def brute_phrases(sample: str, text: str) -> int:
    n = i = 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i:i + k + 1] in sample:
            k += 1
        i, n = i + k, n + 1
    return n


def test_phrases_are_longest_matches():
    r = np.random.default_rng(1)
    for _ in range(200):
        sample, text = ("".join(r.choice(list("ab c"), r.integers(1, 40))) for _ in range(2))
        assert langid.Automaton(sample).phrases(text) == brute_phrases(sample, text)


def test_entropy_adds_up_over_words():
    samples = {"x": " ab abc cab ", "y": " zz zy yz "}
    got = langid.entropies("Abc, zy! 12", samples)
    for lang, s in samples.items():
        n = brute_phrases(s, " abc ") + brute_phrases(s, " zy ")
        assert got[lang] == pytest.approx(math.log2(len(s)) * n / 5)
    assert langid.entropies("12 !!", samples) == {}


def test_words_keep_their_combining_marks():
    assert langid.words_of("नमस्ते, दुनिया! Cafe\u0301 x2") == ["नमस्ते", "दुनिया", "cafe\u0301", "x"]
    assert langid.words_of("\u0301 12 _") == []


def test_bounds_by_length_band():
    rows = [("x", 100, 1 + k / 100) for k in range(100)] + [("x", 5000, 9.0)]
    own = langid.bounds(rows, {"x": 12.0})["x"]
    assert set(own) == {langid.band(100)} and 6.9 < own[langid.band(100)] < 7
    assert 2.4 < langid.bounds(rows, {"x": 1.0})["x"][langid.band(100)] < 2.5
    assert langid.explained(100, 2.0, own) and not langid.explained(9999, 9.0, own)
    assert langid.explained(40, 9.0, own) and langid.explained(3, 99.0, own) and langid.explained(9999, 99.0, {})


def test_language_of_odd_rows(spark):
    docs = odd_documents(spark)
    samples = langid.learn(docs)
    out = as_dicts(langid.predict(clashing(docs), samples))
    assert len(out) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r["lang_pred"] in ("en", "und") and 0 <= r["score"] <= 1 for r in out)
    assert all((r["lang_pred"] == "und") == (not langid.words_of(texts[r["doc_id"]] or "")) for r in out if r["doc_id"] not in (7, None))
    assert langid.learn(empty(spark)) == {} and rows(langid.predict(empty(spark), samples)) == []
    assert {r["lang_pred"] for r in as_dicts(langid.predict(docs, {}))} == {"und"}


def test_language_on_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    out = as_dicts(QUERIES["op6_language"](spark, LARGER))
    assert len(out) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98


def test_quality_on_held_out_documents(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    out = as_dicts(QUERIES["op9_quality"](spark, LARGER))
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50 and all(r["predicted"] == (r["score"] >= 0.7) for r in out)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.93


def test_quality_of_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(4, 1, 0), (10, 0, 0), (10, 0, 1), (None, 1, 0), (5, None, 0), (6, 7, 0)], "doc_id long, quality int, toxic int")
    model = quality.learn(clashing(docs), labels)
    out = as_dicts(quality.score(clashing(docs), model))
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    score = {r["doc_id"]: r["score"] for r in out}
    assert score[4] > score[10]
    none = quality.learn(docs, labels.where("false"))
    assert all(r["score"] == pytest.approx(0.7) for r in as_dicts(quality.score(docs, none)))
    assert as_dicts(quality.score(empty(spark), model)) == []


def test_ranking_follows_preferences():
    r = np.random.default_rng(2)
    x = r.normal(size=(400, len(quality.FEATURES)))
    y = (x[:, 2] - x[:, 5] > 0).astype(int)
    model = quality.fit(x, y)
    assert np.mean((model.score(x) >= 0.7) == (y == 1)) > 0.95
    assert model.weights[2] > 0 > model.weights[5]


def test_features_of_empty_text():
    assert len(quality.features("")) == len(quality.FEATURES) == len(quality.features("A b.\nA b."))




def test_number_forms_are_no_letters(spark):
    for text in ("①", "½ ²", "Ⅷ ⅷ", "12 ¾", "_"):
        assert langid.words_of(text) == [] and langid.entropies(text, {"a": " a "}) == {}
    assert langid.words_of("x² Ⅷa") == ["x", "a"]


def test_every_one_of_seventy_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "ALL_CHARS", 70 * 400)
    r = np.random.default_rng(2)
    letters = {k: [chr(0x4E00 + 7 * k + j) for j in range(6)] for k in range(70)}
    text = lambda k: " ".join("".join(r.choice(letters[k], 4)) for _ in range(30))
    rows_ = [(k * 10 + i, text(k), f"l{k:02d}", None, None) for k in range(70) for i in range(4)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long")
    samples = langid.learn(docs)
    assert len(samples) == 70 and max(map(len, samples.values())) <= 400
    # a document fills no more than its share
    assert all(len({c for c in s if c != " "}) >= 4 for s in samples.values())
    fresh = spark.createDataFrame([(k, text(k), None, None, None) for k in range(70)], docs.schema)
    assert {(x["doc_id"], x["lang_pred"]) for x in as_dicts(langid.predict(fresh, samples))} == {(k, f"l{k:02d}") for k in range(70)}


def test_language_bounds_read_every_labelled_text(spark):
    import random

    from pyspark.sql import functions as F

    r = random.Random(11)
    words = ["".join(r.choice("abcdeinorst") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randrange(8, 40))), r.choice("xy")) for i in range(2600)]
    rows = spark.createDataFrame(docs + [(9000, *docs[0][1:])], "doc_id long, text string, lang string")
    samples, most = langid.learn_bounded(rows)
    read = langid._learn(rows)[1]
    hashed = rows.select("lang", "text", F.xxhash64("text").alias("t")).distinct().collect()
    found = [(x.lang, langid._parse(x.text, samples)) for x in hashed if x.t not in read]
    want = langid.bounds([(lang, n, bits[lang]) for lang, (n, bits) in found], {k: math.log2(len(s)) for k, s in samples.items()})
    assert {lang: sorted(own) for lang, own in most.items()} == {lang: sorted(own) for lang, own in want.items()}
    assert all(abs(most[lang][k] - v) < 0.002 for lang, own in want.items() for k, v in own.items())
