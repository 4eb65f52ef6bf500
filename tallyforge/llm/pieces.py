"""SentencePiece encoding and decoding as the shortest path through a weighted transducer.

Three transducers are compiled from the model: the normaliser (blank marker before the text, blanks to markers), the pieces,
and a byte fallback for characters no piece covers. Composed with an input they form a lattice whose arcs are pieces over
spans of the text; paths have tropical weights, pairs ``(barred arcs, score lost)`` added along a path and compared
lexicographically. In a model of merges an arc may follow another exactly if merging the two pieces' characters anew gives the same two
pieces; any other succession is barred. One path of each prefix then has no barred arc, and it is the encoding; in a unigram
model no succession is barred and the scores decide alone. Pieces never run across the start of a run of markers, so each marked
unit is composed once per worker.
"""

from __future__ import annotations

import zlib
from array import array
from functools import cache

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame

from .encoding import Joints, Memo
from .frames import map_slices, texts

MARK = "▁"
TABLE_LIMIT = 300_000
#: Wire format of a model file: where the trainer and normaliser settings stand (fixed values).
TRAINER, NORMALISER = 2, 3
MODEL_TYPE, CHARSMAP, DUMMY_PREFIX, EXTRA_BLANKS = 3, 2, 3, 4
MERGES = 2


def _fields(raw: bytes) -> dict[int, object]:
    """Last value of each field of one protocol buffer message."""
    out, at = {}, 0

    def number() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = number()
        kind = tag & 7
        if kind == 0:
            out[tag >> 3] = number()
        else:
            n = number() if kind == 2 else 8 if kind == 1 else 4
            out[tag >> 3] = raw[at:at + n]
            at += n
    return out


class Transducer:
    """Normaliser, pieces and byte fallback of one model file."""

    def __init__(self, path: str):
        raw = open(path, "rb").read()
        model = _fields(raw)
        trainer, norm = _fields(model.get(TRAINER, b"")), _fields(model.get(NORMALISER, b""))
        if norm.get(CHARSMAP) or norm.get(EXTRA_BLANKS, 1):
            raise ValueError("only models that keep characters and blanks as they are")
        self.prefix = bool(norm.get(DUMMY_PREFIX, 1))
        self.merges = trainer.get(MODEL_TYPE, 1) == MERGES
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.unknown = sp.get_piece_size(), sp.unk_id()
        self.names = [sp.id_to_piece(i) for i in range(self.size)]
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(self.size) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        plain = [i for i in range(self.size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.pieces = {self.names[i]: (i, sp.get_score(i)) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece runs into the next unit")
        # lengths of the pieces that end in the given three characters (or fewer, if they are the piece)
        self.lengths: dict[str, set[int]] = {}
        for p in self.pieces:
            self.lengths.setdefault(p[-3:], set()).add(len(p))
        self.ending: dict[str, list[int]] = {}
        # the unit last composed, and the state of each of its prefixes: barred arcs, score lost, last piece and its start
        self.unit, self.states = "", [(0, 0.0, "", 0)]
        self.written = [self._spelled(i) for i in range(self.size)]
        self.follows: dict[tuple[str, str], bool] = {}
        self.joints = Joints(self.rank, self.merged)
        self.memo = Memo(self.composed)

    def normalised(self, text: str) -> str:
        """Marker for every blank and one before a text that is not empty."""
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def units(self, text: str) -> list[str]:
        """Cuts of the normalised text before every run of markers."""
        norm = self.normalised(text)
        if MARK * 2 not in norm:
            first, *rest = norm.split(MARK)
            return ([first] if first else []) + [MARK + r for r in rest]
        out, at = [], 0
        for i in range(1, len(norm)):
            if norm[i] == MARK and norm[i - 1] != MARK:
                out.append(norm[at:i])
                at = i
        return [*out, norm[at:]]

    def rank(self, left: str, right: str) -> float | None:
        """Place of a merge, the least first."""
        known = self.pieces.get(left + right)
        return None if known is None else -known[1]

    def merged(self, chars: str, log: list | None = None) -> list[str]:
        """Merges of the best-scored adjacent pair, the leftmost of equals, until no pair is a piece; ``log`` takes them."""
        parts = list(chars)
        while len(parts) > 1:
            found = [(-self.pieces[a + b][1], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.pieces]
            if not found:
                break
            i = min(found)[1]
            if log is not None:
                log.append((parts[i], parts[i + 1]))
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def may_follow(self, left: str, right: str) -> bool:
        if not self.merges:
            return True
        known = self.follows.get((left, right))
        if known is None:
            if len(self.follows) > TABLE_LIMIT:
                self.follows.clear()
            known = self.follows[left, right] = self.joints.hold(left, right)
        return known

    def ends(self, last: str) -> list[int]:
        """Lengths, longest first, of the pieces that may end where the text's last three characters (or all) are ``last``."""
        known = self.ending.get(last)
        if known is None:
            if len(self.ending) > TABLE_LIMIT:
                self.ending.clear()
            known = self.ending[last] = sorted(set().union(*(self.lengths.get(last[k:], ()) for k in range(len(last)))), reverse=True)
        return known

    def arcs(self, unit: str, end: int):
        """Arcs into ``end``, longest first: start, piece, lost score; a character that is no piece has one of its own."""
        for n in self.ends(unit[max(0, end - 3):end]):
            piece = unit[end - n:end] if n <= end else None
            known = self.pieces.get(piece)
            if known:
                yield end - n, piece, -known[1]
        if unit[end - 1:end] not in self.pieces:
            yield end - 1, unit[end - 1:end], 0.0

    def lightest(self, unit: str, end: int) -> tuple[int, float, str, int]:
        """State of the lightest path to ``end``; those of shorter prefixes are there."""
        top = None
        for start, piece, lost in self.arcs(unit, end):
            barred, weight, before, _ = self.states[start]
            barred += bool(before) and not self.may_follow(before, piece)
            if top is None or (barred, weight + lost) < top[:2]:
                top = barred, weight + lost, piece, start
        return top

    def free(self, unit: str, end: int) -> tuple[int, float, str, int] | None:
        """State of the one path of merges to ``end`` without barred arcs: the first that is found ends the search."""
        pieces, states, follows = self.pieces, self.states, self.follows
        last = unit[end - 3:end] if end > 3 else unit[:end]
        for n in self.ending.get(last) or self.ends(last):
            if n <= end and (known := pieces.get(piece := unit[end - n:end])):
                barred, weight, before, _ = states[end - n]
                if barred:
                    continue
                fits = not before or follows.get((before, piece))
                if fits or fits is None and self.may_follow(before, piece):
                    return 0, weight - known[1], piece, end - n
        return None

    def shortest(self, unit: str) -> list[int]:
        """Ids along the lightest path of the lattice of one unit; it keeps the states of what it shares with the unit before."""
        states, n = self.states, min(len(unit), len(self.unit))
        k = n if unit[:n] == self.unit[:n] else next(k for k in range(n) if unit[k] != self.unit[k])
        self.unit = unit[:k]
        del states[k + 1:]
        for end in range(k + 1, len(unit) + 1):
            states.append(self.merges and self.free(unit, end) or self.lightest(unit, end))
        self.unit = unit
        out, at = [], len(unit)
        while at:
            _, _, piece, at = states[at]
            known = self.pieces.get(piece)
            if known:
                out.append(known[0])
            else:
                out += self.emitted(piece)[::-1]
        return out[::-1]

    def composed(self, units: list[str]) -> list[bytes]:
        """Ids of each unit; in their order, as units share the states of their common beginnings."""
        found = {u: array("I", self.shortest(u)).tobytes() for u in sorted(units)}
        return [found[u] for u in units]

    def emitted(self, piece: str) -> list[int]:
        """Ids of an arc: the piece, else the bytes of its character, else the unknown id."""
        known = self.pieces.get(piece)
        if known:
            return [known[0]]
        raw = piece.encode()
        return [self.bytes[b] for b in raw] if all(b in self.bytes for b in raw) else [self.unknown]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit bytes."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return [b"".join(values) for values in self.memo.take(map(self.units, texts))]

    def _spelled(self, i: int) -> bytes:
        if i in self.byte_of:
            return bytes([self.byte_of[i]])
        return self.names[i].encode() if self.names[i] in self.pieces else b" \xe2\x81\x87 "

    def decode(self, ids: list[int]) -> str:
        """The inverse transducer: bytes joined, markers to blanks, the leading one dropped."""
        text = b"".join(map(self.written.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


@cache
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` (little-endian unsigned 32-bit) of every whole text; null and empty texts have no ids."""

    def step(batch):
        own = transducer(path)
        yield {"doc_id": batch.column("doc_id"), "ids": own.encode_all(batch.column("text").to_pylist())}

    return map_slices(texts(docs), "doc_id long, ids binary", step)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of encoded rows; no ids give the empty text, null ids too."""

    def step(batch):
        own = transducer(path)
        ids = [np.frombuffer(x or b"", "<u4").tolist() for x in batch.column("ids").to_pylist()]
        yield {"doc_id": batch.column("doc_id"), "text": [own.decode(x) for x in ids]}

    return map_slices(encoded.select("doc_id", "ids"), "doc_id long, text string", step)


def summary(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_pieces, n_bytes_fallback, ids_crc32, decoded_crc32`` of every whole text: its encoding, and the text
    that decoding the ids gives."""

    def step(batch):
        own = transducer(path)
        fallback = np.zeros(own.size, bool)
        fallback[list(own.byte_of)] = True
        raw = own.encode_all(batch.column("text").to_pylist())
        ids = [np.frombuffer(x, "<u4") for x in raw]
        yield {"doc_id": batch.column("doc_id"), "n_pieces": [len(x) for x in ids],
               "n_bytes_fallback": [int(fallback[x].sum()) for x in ids], "ids_crc32": [zlib.crc32(x) for x in raw],
               "decoded_crc32": [zlib.crc32(own.decode(x.tolist()).encode()) for x in ids]}

    return map_slices(texts(docs), "doc_id long, n_pieces long, n_bytes_fallback long, ids_crc32 long, decoded_crc32 long", step)
