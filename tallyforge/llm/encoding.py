"""Token ids of whole texts by a public tokenizer, each distinct blank-delimited unit encoded once per worker.

A byte-level vocabulary never joins characters across the start of a run of white space, and a word-end
vocabulary drops white space, so a text's ids are its units' ids in order. Units are encoded by the tokenizers
library itself; a two-generation memo of bounded size keeps recent ones.
"""

from __future__ import annotations

import math
import os
import re
from array import array
from collections.abc import Callable, Iterable
from functools import cache
from itertools import chain

import numpy as np

#: Units encoded by one call of the library.
CALL_UNITS = 1000
#: Opens the key of a unit that no blank precedes.
LITERAL = "\x01"
_RUN = re.compile(r"\s\s")
_BEYOND_LATIN = re.compile("[^\x00-\xff]")
#: A stop or comma that another mark precedes belongs to a run of marks.
_MARKS = re.compile(r"[.,](?<![^\W_][.,])(?<![ \n][.,])")
#: Or stands apart from the word before it.
_APART = re.compile(r"[.,](?<![^\W_][.,])")
_BEFORE_RUN = re.compile(r"(?<=\S)(?=\s)")


def default_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo(dict):
    """Bounded memo: two generations of about ``limit`` keys; a key asked for again moves to the new one.

    A worker serves many operators in turn; only the memo in use keeps its keys.
    """

    in_use: Memo | None = None

    def __init__(self, fill: Callable[[list], Iterable], limit: int = 300_000):
        super().__init__()
        self.fill, self.limit, self.old = fill, limit, {}

    def take(self, keys: Iterable[list]) -> list[list]:
        """Values of each list of keys; those not known are filled in one call."""
        if Memo.in_use is not self:
            if Memo.in_use is not None:
                Memo.in_use.clear()
                Memo.in_use.old = {}
            Memo.in_use = self
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        keys = list(keys)
        todo = [k for k in dict.fromkeys(chain.from_iterable(keys)) if k not in self]
        if self.old:
            self.update((k, self.old[k]) for k in todo if k in self.old)
            todo = [k for k in todo if k not in self]
        if todo:
            self.update(zip(todo, self.fill(todo), strict=True))
        return [list(map(self.__getitem__, ks)) for ks in keys]


class Joints:
    """Whether two tokens of a merge vocabulary stay apart when their characters are merged anew.

    Merges are undone from the last one back, each token by its own last merge; between two of them the tokens at the joint
    meet, and would merge if that merge ranks before the next (of equal rank, the left one goes first). This holds for
    tokens that are made by merges of ascending rank; with any other the characters are merged. ``rank(left, right)`` is
    a merge's place or null, ``merged(text, log)`` merges a text and logs the pairs.
    """

    def __init__(self, rank: Callable[[str, str], float | None], merged: Callable[[str, list], list[str]]):
        self.rank, self.merged = rank, merged
        self.undone: dict[str, tuple] = {}

    def undo(self, token: str) -> tuple:
        """Parts and rank of a token's last merge (no parts: one character; no rank: merging never gives it), and whether
        its merges ascend."""
        known = self.undone.get(token)
        if known is None:
            log: list = []
            made = self.merged(token, log) == [token]
            ranks = [self.rank(*pair) for pair in log]
            ascend = ranks == sorted(ranks)
            known = (None, None, None, ascend) if not made else (*log[-1], ranks[-1], ascend) if log else (None, None, -math.inf, True)
            self.undone[token] = known
        return known

    def hold(self, left: str, right: str) -> bool:
        first, second = self.undo(left), self.undo(right)
        if first[2] is None or second[2] is None:
            return False
        if not (first[3] and second[3]):
            return self.merged(left + right, []) == [left, right]
        limit, ties = math.inf, False
        while True:
            met = self.rank(left, right)
            if met is not None and (met < limit or ties and met == limit):
                return False
            # of two merges of equal rank the right one is the later
            if second[0] is not None and second[2] >= first[2]:
                limit, ties, right = second[2], True, second[0]
                second = self.undo(right)
            elif first[0] is not None:
                limit, ties, left = first[2], False, first[1]
                first = self.undo(left)
            else:
                return True


def spaced_units(text: str) -> list:
    """Keys of the units of a text for a vocabulary that keeps white space; see ``unit_text``.

    Where no mark precedes them, stops and commas at a word's end are units of their own, which leaves fewer words.
    """
    if not _RUN.search(text) and LITERAL not in text:
        if not _APART.search(text):
            for mark in (". ", ", ", ".\n", ",\n"):
                text = text.replace(mark, f" {LITERAL}{mark}")
        first, *rest = text.replace("\n", " \n").split(" ")
        return [(first,), *rest] if first else rest
    out: list = []
    for u in _BEFORE_RUN.split(text):
        if not u[:1].isspace() or LITERAL in u:
            out.append((u,))
        elif u[0] == " " and not u[1:2].isspace():
            out.append(u[1:])
        else:
            out.append(u)
    return out


def unit_text(key) -> str:
    """The characters a key stands for: a tuple and what follows ``LITERAL`` or begins with white space is literal, any
    other key follows one blank."""
    if isinstance(key, tuple):
        return key[0]
    if key[:1] == LITERAL:
        return key[1:]
    return key if key[:1].isspace() else " " + key


def blank_units(text: str) -> list[str]:
    """Units of a text for a lower-casing vocabulary that drops white space.

    In plain Western text the case is dropped and a full stop or comma at a word's end is parted here, which leaves fewer
    different units; the library does the same to any other text.
    """
    if not _BEYOND_LATIN.search(text) and not _MARKS.search(text):
        text = text.lower()
        for mark in (". ", ", ", ".\n", ",\n"):
            text = text.replace(mark, f" {mark}")
    return text.replace("\n", " ").split(" ")


@cache
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _whole_words(tok, spaced: bool) -> bool:
    """Whether the model alone gives the library's ids of plain words, tried on words of every letter and length."""
    if type(tok.model).__name__ != "BPE":
        return False
    letters = "abcdefghijklmnopqrstuvwxyz"
    tried = [(letters * 3)[k:k + n] for k in range(26) for n in (1, 2, 3, 5, 8, 13, 26, 52)] + ["the", "and", "of", "information"]
    tried += [t.capitalize() for t in tried] + [t.upper() for t in tried] if spaced else []
    opening = "\u0120" if spaced else ""
    whole = tok.encode_batch_fast([" " * spaced + t for t in tried], add_special_tokens=False)
    return all([t.id for t in tok.model.tokenize(opening + word)] == e.ids for word, e in zip(tried, whole, strict=True)) and not any(
        a.content.isalpha() and a.content.isascii() for a in tok.get_added_tokens_decoder().values())


@cache
def encoder(path: str, spaced: bool) -> Callable[[list[str]], list[bytes]]:
    """``texts -> ids of each as little-endian unsigned 32-bit bytes``, one per worker and vocabulary."""
    tok = load(path)

    # the library encodes what stands between two special tokens as a text of its own: many units go in one call
    mark = next((a.content for a in tok.get_added_tokens_decoder().values() if a.special), None)
    mark_id = None if mark is None else tok.token_to_id(mark)

    def alone(units: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast(units, add_special_tokens=False)]

    # the model alone encodes a word that the vocabulary's normaliser and pre-tokenizer leave whole
    model = tok.model
    opening = "\u0120" if spaced else ""

    def words(units: list[str]) -> list[bytes]:
        return [array("I", [t.id for t in model.tokenize(opening + u)]).tobytes() for u in units]

    def fill(keys: list) -> list[bytes]:
        # of a vocabulary without blanks only what its normaliser cannot change
        plain = [k for k in keys if isinstance(k, str) and k.isalpha() and k.isascii() and (spaced or k.islower())] if by_words else []
        known = dict(zip(plain, words(plain), strict=True))
        rest = [k for k in keys if k not in known]
        known.update(zip(rest, marked([unit_text(k) for k in rest] if spaced else rest), strict=True))
        return [known[k] for k in keys]

    def marked(units: list[str]) -> list[bytes]:
        if mark is None or any(mark in u for u in units):
            return alone(units)
        out: list[bytes] = []
        for at in range(0, len(units), CALL_UNITS):
            part = units[at:at + CALL_UNITS]
            ids = np.asarray(tok.encode_batch_fast([mark.join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = [-1, *np.flatnonzero(ids == mark_id).tolist(), len(ids)]
            raw = ids.tobytes()
            out += [raw[4 * a + 4:4 * b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    by_words = _whole_words(tok, spaced)
    memo, cut = Memo(fill), spaced_units if spaced else blank_units
    return lambda texts: [b"".join(values) for values in memo.take(map(cut, texts))]
