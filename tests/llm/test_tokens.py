"""Token counts, prefix tables, packing, token files and pieces against the public libraries."""

import itertools
import random
import sys
import zlib

import numpy as np
import pytest
import sentencepiece

from cases import SF, ODD_TEXTS, as_dicts, clashing, documents, empty, odd_documents, random_texts, rows
from tallyforge.llm import counts, encoding, packing, pieces, repair
from tallyforge.llm.queries import QUERIES

BYTE, WORD, PIECE = (encoding.default_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
PARTS = [*"ab cde'st r,.!?0129\n\t  éßñ中😀'\x1c\x01▁Σİ", "the", "ing", " the", "'ve", "'re", "<|endoftext|>", "  ", "\n\n", " \n", ", ", ". "]


def ids_of(path: str, text: str | None, end: int) -> np.ndarray:
    return np.array([*encoding.load(path).encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize(("path", "spaced"), [(BYTE, True), (WORD, False)])
def test_units_give_the_ids_of_the_library(path, spaced):
    texts = random_texts(5, 1500, PARTS, 30) + [t or "" for t in ODD_TEXTS]
    got = encoding.encoder(path, spaced)(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [
        encoding.load(path).encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize(("path", "spaced"), [(BYTE, True), (WORD, False)])
def test_plain_words_are_encoded_by_the_model_alone(path, spaced):
    assert encoding._whole_words(encoding.load(path), spaced)
    texts = ["Word WORD word \u4e2d Hello", "HELLO \u4e2d a.b", "x" * 300 + " y", ".start ,x _. a_. b.", "don't stop, it's one."]
    got = encoding.encoder(path, spaced)(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [
        encoding.load(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_vocabularies_that_split_words_are_not_taken_by_words():
    from tokenizers import Regex, Tokenizer, pre_tokenizers

    tok = Tokenizer.from_file(BYTE)
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex("th"), "isolated"), tok.pre_tokenizer])
    assert not encoding._whole_words(tok, True)


def test_memo_forgets_and_fills_again():
    asked = []
    memo = encoding.Memo(lambda ks: [asked.append(k) or k * 2 for k in ks], limit=2)
    assert memo.take([[1, 2, 1], [3]]) == [[2, 4, 2], [6]]
    assert memo.take([[4], [1]]) == [[8], [2]]
    memo.take([[5, 6, 7]])
    memo.take([[8]])
    assert memo.take([[2]]) == [[4]] and asked.count(2) == 2 and asked.count(1) == 1


def test_prefix_table_is_exact():
    own = counts.PrefixCounter(BYTE)
    for t in random_texts(9, 150, PARTS, 20):
        assert own.prefix_counts(t) == [len(encoding.load(BYTE).encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]


def test_counts_and_budgets(spark):
    docs = odd_documents(spark)
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(ids_of(BYTE, r.text, 0)) - 1) for r in docs.collect()), key=repr)
    assert rows(counts.token_counts(docs, BYTE).drop("over_limit")) == want
    assert rows(counts.token_counts(clashing(docs), BYTE)) == rows(counts.token_counts(docs, BYTE))
    assert rows(counts.token_counts(empty(spark), BYTE)) == []
    fit = as_dicts(counts.fit_budget(documents(spark, ["one two three", "", None]), BYTE, 2))
    assert [(r["fit_chars"], r["fit_tokens"]) for r in fit] == [(7, 2), (0, 0), (0, 0)]
    assert as_dicts(counts.prefix_table(documents(spark, ["ab"]), BYTE))[0]["prefix_tokens"] == [0, 1, 1]


def check_packing(out: list[dict], docs: list[tuple[int | None, str | None]], window: int) -> None:
    want = sorted((repr(i), zlib.crc32(ids_of(BYTE, t, 1).tobytes())) for i, t in docs)
    by_doc: dict = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert len([r for r in out if r["start"] == 0]) == len(want)
    seqs: dict = {}
    for r in out:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(seqs) == list(range(len(seqs)))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
    single = {i for i, _ in docs if [x for x, _ in docs].count(i) == 1}
    for i, t in docs:
        if i in single:
            ids, at = ids_of(BYTE, t, 1), 0
            for r in by_doc[i]:
                assert r["start"] == at and r["doc_tokens"] == len(ids)
                assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
                at += r["length"]
            assert at == len(ids)


def test_packing_of_odd_rows(spark):
    docs = odd_documents(spark)
    given = [(r.doc_id, r.text) for r in docs.collect()]
    check_packing(as_dicts(packing.pack(docs, BYTE)), given, 2048)
    check_packing(as_dicts(packing.pack(clashing(docs), BYTE, window=64)), given, 64)
    assert as_dicts(packing.pack(empty(spark), BYTE)) == []


def test_packing_query(spark):
    out = as_dicts(QUERIES["op5_packing"](spark, SF))
    check_packing(out, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], 2048)
    padded = {r["sequence_id"]: r["padded"] for r in out}
    assert sum(padded.values()) < 0.15 * sum(r["length"] for r in out)  # each shard of this small table ends in padding


def least_cost(cuts, costs, window):
    best = {0: 0}
    powers = {window >> k for k in range(1, packing.POWERS + 1)}
    for j, c in zip(cuts, costs, strict=True):
        best[j] = c + min(v + (0 if j - i in powers else window - (j - i)) for i, v in best.items() if 0 < j - i <= window)
    return best[cuts[-1]]


def test_cuts_are_the_cheapest_chain():
    r = np.random.default_rng(3)
    for _ in range(60):
        n, window = int(r.integers(1, 400)), 64
        ends = np.unique(r.integers(1, n + 1, 6))
        ends[-1] = n
        stops = np.unique(r.integers(1, n + 1, 10))
        cuts, costs = packing.allowed(np.unique(ends), stops, window)
        chain = packing.best_cuts(cuts, costs, window)
        cost_of, powers = dict(zip(cuts, costs, strict=True)), {window >> k for k in range(1, packing.POWERS + 1)}
        spent = sum(cost_of[j] + (0 if j - i in powers else window - (j - i)) for i, j in zip(chain, chain[1:], strict=False))
        assert spent == least_cost(cuts, costs, window)


def padded_by(ends, window):
    cuts, costs = packing.allowed(np.asarray(ends), np.array([], np.int64), window)
    chain = packing.best_cuts(cuts, costs, window)
    return sum(packing.padding(j - i, window) for i, j in zip(chain, chain[1:], strict=False))


def test_documents_without_sentence_ends_fill_their_windows():
    assert padded_by(np.arange(1, 101) * 1100, 2048) < 2048
    assert padded_by([2048 + 1024 + 512 + 16], 2048) == 0
    r = np.random.default_rng(5)
    for _ in range(5):
        ends = np.cumsum(r.integers(1, 3000, 30))
        assert padded_by(ends, 2048) < 0.02 * ends[-1]
        every = np.arange(1, ends[-1] + 1)  # every id may be cut
        cost = np.where(np.isin(every, ends), 0, packing.ID_COST)
        chains = [packing.best_cuts(*c) for c in (packing.allowed(ends, np.array([], np.int64)), (every.tolist(), cost.tolist()))]
        spent = [sum(packing.padding(j - i) + cost[j - 1] for i, j in zip(c, c[1:], strict=False)) for c in chains]
        assert spent[1] <= spent[0] <= 1.2 * spent[1]


def test_wide_stops_end_sentences():
    text = "日本語の文。次の文！終わり A.b c. d"
    ids = ids_of(BYTE, text, 1)
    heads = [encoding.load(BYTE).decode(ids[:k].tolist()) for k in packing.sentence_ends(ids, BYTE)]
    assert heads == ["日本語の文。", "日本語の文。次の文！", "日本語の文。次の文！終わり A.b c."]


def test_shards_decode_any_span():
    r = np.random.default_rng(4)
    for kind in (3, 50, 40_000):
        ids = r.integers(0, kind, 20_000).astype(np.uint32)
        ids[5000:9000] = 7
        shard = repair.Shard(repair.write_shard([1, None], [12_000, 8_000], ids))
        assert (shard.ids(0, len(ids)) == ids).all() and shard.doc_ids == [1, None]
        for a in r.integers(0, len(ids), 50).tolist():
            assert (shard.ids(a, 37) == ids[a:a + 37]).all()
    again = np.tile(r.integers(0, 9, 50), 400).astype(np.uint32)
    assert len(repair.compress(again, 9)[1]) < len(again) / 4
    assert len(repair.Shard(repair.write_shard([], [], again[:0])).symbols) == 0


def check_files(got: list[dict], docs) -> None:
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    at, want = 0, []
    for i, t in order:
        ids = ids_of(WORD, t, 2)
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=lambda r: r[1]) == want


def test_token_files(spark, monkeypatch):
    docs = odd_documents(spark)
    given = [(r.doc_id, r.text) for r in docs.collect()]
    check_files(as_dicts(repair.read_token_files(repair.write_token_files(docs, WORD))), given)
    check_files(as_dicts(repair.read_token_files(repair.write_token_files(clashing(docs), WORD))), given)
    assert as_dicts(repair.read_token_files(repair.write_token_files(empty(spark), WORD))) == []
    check_files(as_dicts(QUERIES["op7_token_files"](spark, SF)), [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])


def test_pieces_equal_the_library():
    sp, own = sentencepiece.SentencePieceProcessor(model_file=PIECE), pieces.transducer(PIECE)
    for t in random_texts(8, 1500, [*PARTS, "    ", "<s>", "<unk>", "\x00"], 30) + [t or "" for t in ODD_TEXTS]:
        ids = np.frombuffer(own.encode(t), "<u4").tolist()
        assert ids == sp.encode(t) and own.decode(ids) == sp.decode(ids)


def test_free_paths_are_found_without_weighing_all_arcs(monkeypatch):
    import sentencepiece

    own = pieces.Transducer(PIECE)
    weighed = []
    monkeypatch.setattr(own, "arcs", lambda unit, end: weighed.append(unit) or pieces.Transducer.arcs(own, unit, end))
    text = "plain words, in one Sentence"
    want = sentencepiece.SentencePieceProcessor(model_file=PIECE).encode(text)
    assert np.frombuffer(own.encode(text), "<u4").tolist() == want and not weighed


def test_piece_queries(spark):
    docs, sp = odd_documents(spark), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    encoded = pieces.encode(clashing(docs), PIECE)
    assert rows(pieces.decode(encoded, PIECE)) == sorted(((r.doc_id, sp.decode(sp.encode(r.text or ""))) for r in docs.collect()), key=repr)
    assert rows(pieces.summary(empty(spark), PIECE)) == []
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in as_dicts(QUERIES["op10_pieces"](spark, SF)):
        ids = sp.encode(texts[r["doc_id"]])
        assert (r["n_pieces"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r["decoded_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())


def test_counts_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in as_dicts(QUERIES["op8_token_counts"](spark, SF)):
        assert r["n_tokens"] == len(ids_of(BYTE, texts[r["doc_id"]], 0)) - 1 and r["over_limit"] == (r["n_tokens"] > 1024)


def joined(own, vocab, hold, monkeypatch):
    r = random.Random(12)
    short = [v for v in vocab if len(v) < 4]
    pairs = [(r.choice(vocab), r.choice(short)) for _ in range(1500)] + [(r.choice(short), r.choice(short)) for _ in range(1500)]
    pairs += [(a * 2, a) for a in "aeo=-"] + [("a", "a"), ("t", "he"), ("th", "e")]
    want = [own.merged(a + b) == [a, b] for a, b in pairs]
    merged, tokens = [], set(vocab)
    real = own.merged
    monkeypatch.setattr(own.joints, "merged", lambda text, log: merged.append(text) or real(text, log))
    assert [hold(a, b) for a, b in pairs] == want and len(set(want)) == 2
    # tokens are merged once each, no pair is
    assert set(merged) <= tokens and len(merged) == len(set(merged))


def test_pairs_are_told_without_merging_them_anew(monkeypatch):
    count, piece = counts.PrefixCounter(BYTE), pieces.Transducer(PIECE)
    joined(count, sorted(count.vocab), count.fits, monkeypatch)
    joined(piece, sorted(piece.pieces), piece.may_follow, monkeypatch)


def test_joints_of_merges_that_do_not_ascend():
    # "bc" is made late, but "abc" of it ranks first
    ranks = {("b", "c"): 5, ("a", "bc"): 1, ("c", "d"): 3, ("d", "a"): 2, ("bc", "d"): 0}

    def merged(text, log=None):
        parts = list(text)
        while found := [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks]:
            i = min(found)[1]
            if log is not None:
                log.append((parts[i], parts[i + 1]))
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    own = encoding.Joints(lambda a, b: ranks.get((a, b)), merged)
    tokens = ["a", "b", "c", "d", "bc", "abc", "cd", "da", "bcd"]
    for a, b in itertools.product(tokens, tokens):
        assert own.hold(a, b) == (merged(a + b) == [a, b]), (a, b)


def test_only_lengths_that_occur_are_tried():
    own = pieces.Transducer(PIECE)
    for last in ("ing", "e", "▁q", "zqj", "\U0001f600"):
        assert own.ends(last) == sorted({len(p) for p in own.pieces if p == last[-len(p):] or len(p) > 3 and p.endswith(last) and len(last) == 3}, reverse=True)


def test_a_memo_asks_no_function_for_each_key():
    memo, calls = encoding.Memo(lambda keys: list(map(len, keys))), []
    keys = [[f"{i}-{k % 50}" for k in range(100)] for i in range(20)]
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event == "call" else None)
    got = memo.take(keys)
    sys.setprofile(None)
    assert got == [[len(k) for k in ks] for ks in keys] and len(calls) < 20
    memo.limit = 10
    assert memo.take([["0-1", "new"]]) == [[3, 3]] and set(memo) == {"0-1", "new"} and len(memo.old) == 1000


def test_one_unbroken_text_keeps_one_state_a_character():
    own, text = pieces.Transducer(PIECE), "".join(random.Random(4).choice("abcde") for _ in range(3000))
    want = sentencepiece.SentencePieceProcessor(model_file=PIECE).encode(text)
    assert np.frombuffer(own.encode(text), "<u4").tolist() == want
    assert sum(len(piece) for _, _, piece, _ in own.states) < 16 * len(text)
    for unit in ("\u2581therefore", "\u2581there", "\u2581thermal", "\u2581x", "\u2581therefore"):
        assert own.shortest(unit) == pieces.Transducer(PIECE).shortest(unit) and len(own.states) == len(unit) + 1
