"""Literals that every match of a regex must hold, read off its parse tree."""

from __future__ import annotations

import warnings
from re import _constants as op, _parser

#: Literals kept per pattern; an alternation with more branches counts as having none.
MOST = 64


def _ascii(code: int) -> bool:
    return 0 < code < 128


def _better(a: list[str], b: list[str]) -> list[str]:
    """Of two sets that hold full grams the one of fewer literals, else the one whose shortest is longer; an empty set
    says nothing."""
    if not a or not b:
        return a or b
    return max((a, b), key=lambda s: (min(3, *map(len, s)), -len(s), min(map(len, s))))


def _required(nodes) -> list[str]:
    """Literals of which every match holds at least one."""
    best: list[str] = []
    run = ""

    def close() -> None:
        nonlocal run, best
        if run:
            best = _better(best, [run])
        run = ""

    for kind, arg in nodes:
        if kind is op.LITERAL and _ascii(arg):
            run += chr(arg).lower()
            continue
        close()
        if kind is op.SUBPATTERN:
            best = _better(best, _required(arg[3]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and arg[0] > 0:
            best = _better(best, _required(arg[2]))
        elif kind is op.ATOMIC_GROUP:
            best = _better(best, _required(arg))
        elif kind is op.BRANCH:
            branches = [_required(b) for b in arg[1]]
            if all(branches):
                every = sorted({w for b in branches for w in b})
                if len(every) <= MOST:
                    best = _better(best, every)
    close()
    return best


def required_literals(pattern: str | None) -> list[str]:
    """Lower-case ASCII literals, at least one of which every matching text holds when lower-cased too.

    Empty if there is none, or if the pattern is beyond the dialect this reads.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return _required(_parser.parse(pattern))
    except Exception:  # any pattern it cannot read is searched without a literal
        return []
