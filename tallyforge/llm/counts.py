"""Exact token counts by prefix dynamic programming over a byte-level merge vocabulary.

The canonical encoding of a prefix is the canonical encoding of a shorter prefix plus one token, and a chain of
tokens is canonical exactly if each adjacent pair is (merging the pair's characters anew gives the pair back). So the
table "last token and number of tokens of every prefix" is filled left to right, each entry from an earlier one, and
answers how many tokens any prefix has and which prefix fits a budget without encoding again. Words share the
entries of their common beginnings.
"""

from __future__ import annotations

import json
from functools import cache

import regex
from pyspark.sql import DataFrame

from .encoding import Joints, Memo, spaced_units, unit_text
from .frames import map_slices, texts

#: Split pattern of byte-level vocabularies of this family (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of the prefix and pair tables kept per worker before they start anew.
TABLE_LIMIT = 400_000


def _byte_letters() -> dict[int, str]:
    """Byte -> letter of such vocabulary files: printable bytes stand for themselves, the others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PrefixCounter:
    """Prefix tables of one vocabulary."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.vocab: set[str] = set(model["vocab"])
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        # longest token that ends in the given two letters (or is the one)
        self.reach: dict[str, int] = {}
        for t in self.vocab:
            self.reach[t[-2:]] = max(self.reach.get(t[-2:], 1), len(t))
        self.specials = [a["content"] for a in spec["added_tokens"]]
        self.letters = _byte_letters()
        self.split = regex.compile(PATTERN)
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        self.table: dict[str, tuple[str, int]] = {"": ("", 0)}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.joints = Joints(self.rank, self.merged)

    def rank(self, left: str, right: str) -> int | None:
        """Place of a merge, the least first."""
        return self.ranks.get((left, right))

    def spelled(self, piece: str) -> str:
        """A piece in the letters of the vocabulary file, one per byte."""
        return piece if piece.isascii() and piece.isalnum() else "".join(map(self.letters.__getitem__, piece.encode()))

    def merged(self, letters: str, log: list | None = None) -> list[str]:
        """Merges by rank until none applies; ``log`` takes them in order."""
        parts = list(letters)
        while len(parts) > 1:
            rank, i = min((self.ranks.get((a, b), 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 40:
                break
            if log is not None:
                log.append((parts[i], parts[i + 1]))
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether ``right`` may follow ``left`` in a canonical chain."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > TABLE_LIMIT:
                self.pairs.clear()
            known = self.pairs[key] = self.joints.hold(left, right)
        return known

    def last(self, letters: str, end: int) -> tuple[str, int]:
        """Last token and number of tokens of the prefix of ``end`` letters; shorter prefixes are in the table."""
        vocab, table, pairs = self.vocab, self.table, self.pairs
        for start in range(max(0, end - self.reach.get(letters[max(0, end - 2):end], 1)), end):
            token = letters[start:end]
            if token in vocab:
                before, n = table[letters[:start]]
                if not before:
                    return token, n + 1
                free = pairs.get((before, token))
                if free or free is None and self.fits(before, token):
                    return token, n + 1
        raise ValueError(f"no token covers {letters[:end]!r}")

    def fill(self, letters: str) -> int:
        """Complete the table for one word; number of tokens of the word."""
        table = self.table
        known = table.get(letters)
        if known is None:
            end = len(letters) - 1
            while letters[:end] not in table:
                end -= 1
            # an entry is looked up by its prefix, so all shorter ones are there as well
            for e in range(end + 1, len(letters) + 1):
                known = table[letters[:e]] = self.last(letters, e)
        return known[1]

    def prune(self) -> None:
        if len(self.table) > TABLE_LIMIT:
            self.table = {"": ("", 0)}

    def pieces(self, text: str) -> list[tuple[str, bool]]:
        """Pieces that are encoded on their own, and whether each is a special token."""
        out, at = [], 0
        for m in self.at_special.finditer(text):
            out += [(p, False) for p in self.split.findall(text[at:m.start()])] + [(m[0], True)]
            at = m.end()
        return out + [(p, False) for p in self.split.findall(text[at:])]

    def count(self, text: str) -> int:
        """Number of tokens of a text."""
        return sum(1 if special else self.fill(self.spelled(p)) for p, special in self.pieces(text))

    def prefix_counts(self, text: str) -> list[int]:
        """Number of tokens of ``text[:k]`` for k = 0..len(text), each as if that prefix were encoded alone."""
        out, done, before = [0], 0, ""
        pieces, i = self.pieces(text), 0
        while i < len(pieces):
            piece, special = pieces[i]
            i += 1
            if special:
                # unfinished, its characters join the piece before them
                known = self.count(before)
                out += [done - known + self.count(before + piece[:k]) for k in range(1, len(piece))] + [done + 1]
                done, before = done + 1, ""
                continue
            told = 0  # characters of the piece that the run before it has answered
            if piece.isspace():
                # a run of white space is one piece as long as nothing follows it
                run, n = piece, self.count(piece)
                while i < len(pieces) and not pieces[i][1] and pieces[i][0].isspace():
                    run, n, i = run + pieces[i][0], n + self.count(pieces[i][0]), i + 1
                word = pieces[i][0] if i < len(pieces) and not pieces[i][1] and pieces[i][0][:1] == " " else ""
                out += [done + self.count((run + word[:1])[:k]) for k in range(1, len(run + word[:1]) + 1)]
                done, before = done + n, run
                if not word:
                    continue
                piece, i, told = word, i + 1, 1
            if piece[:1] == "'":
                out += [done + self.count(piece[:k]) for k in range(1, len(piece) + 1)]
            else:
                letters, at = self.spelled(piece), 0
                self.fill(letters)
                for k, c in enumerate(piece):
                    at += len(c.encode())
                    if k >= told:
                        out.append(done + self.table[letters[:at]][1])
            done, before = out[-1], piece
        self.prune()
        return out


@cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


@cache
def _unit_counts(path: str) -> Memo:
    own = counter(path)

    def fill(keys: list) -> list[int]:
        own.prune()
        return [own.count(unit_text(k)) for k in keys]

    return Memo(fill)


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text.

    A null or empty text has 0 bytes and 0 tokens; every input row gives one row, repeated ids included; further
    columns of the input are ignored. Special strings inside a text count as their one token.
    """

    def step(batch):
        memo = _unit_counts(path)
        rows = batch.column("text").to_pylist()
        n = [sum(values) for values in memo.take(map(spaced_units, rows))]
        yield {"doc_id": batch.column("doc_id"), "n_bytes": [len(t.encode()) for t in rows], "n_tokens": n,
               "over_limit": [x > limit for x in n]}

    return map_slices(texts(docs), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", step)


def prefix_table(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, prefix_tokens``: element k is the exact number of tokens of the first k characters."""

    def step(batch):
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            yield {"doc_id": [i], "prefix_tokens": [counter(path).prefix_counts(t)]}

    return map_slices(texts(docs), "doc_id long, prefix_tokens array<int>", step)


def fit_budget(docs: DataFrame, path: str, budget: int) -> DataFrame:
    """``doc_id, fit_chars, fit_tokens``: the longest prefix of at most ``budget`` tokens, from the prefix table."""

    def step(batch):
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            n = counter(path).prefix_counts(t)
            k = max(k for k, x in enumerate(n) if x <= budget)
            yield {"doc_id": [i], "fit_chars": [k], "fit_tokens": [n[k]]}

    return map_slices(texts(docs), "doc_id long, fit_chars long, fit_tokens long", step)
