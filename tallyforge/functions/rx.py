"""Regex dialect helper.

The patterns in this library assume ASCII word boundaries. The JVM engine of older Java
releases treats accented letters as word characters for ``\\b`` but not for ``\\w``, so
boundaries are spelled out: one look-around where a neighbour is certainly a word character,
both otherwise.
"""

from __future__ import annotations

import re

_BOUND = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_START = r"(?<!\w)"
_END = r"(?!\w)"
# one pattern element: escape, class, or any single character
_ELEMENT = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|.", re.S)


def _is_word(element: str) -> bool:
    if element in (r"\w", r"\d"):
        return True
    if element.startswith("[") and not element.startswith("[^"):
        return re.fullmatch(r"\[(?:\\w|\\d|\w-\w|\w)+\]", element, re.A) is not None
    return len(element) == 1 and re.match(r"\w", element, re.A) is not None


def _close(parts: list[str], at: int) -> int:
    """Index of the parenthesis closing the one at ``at``."""
    depth = 0
    for i in range(at, len(parts)):
        depth += (parts[i] == "(") - (parts[i] == ")")
        if depth == 0:
            return i
    return len(parts)


def _branches(parts: list[str]) -> list[list[str]]:
    """Top-level alternatives of a group body."""
    out, depth = [[]], 0
    for p in parts:
        depth += (p == "(") - (p == ")")
        if p == "|" and depth == 0:
            out.append([])
        else:
            out[-1].append(p)
    return out


def _body(parts: list[str]) -> list[str] | None:
    """Group content without ``?:``; None for look-arounds and flags."""
    if parts[:1] != ["?"]:
        return parts
    return parts[2:] if parts[1:2] == [":"] else None


def _starts_word(parts: list[str]) -> bool:
    """Every match of this sequence begins with a word character."""
    if not parts:
        return False
    if parts[0] == "(":
        end = _close(parts, 0)
        body = _body(parts[1:end])
        if body is None or parts[end + 1 : end + 2] in (["?"], ["*"], ["{"]):
            return False
        return all(_starts_word(b) for b in _branches(body))
    return _is_word(parts[0]) and parts[1:2] not in (["?"], ["*"], ["{"])


def _ends_word(parts: list[str]) -> bool:
    """Every match of this sequence ends with a word character."""
    while parts and parts[-1] == "+":
        parts = parts[:-1]
    if not parts or parts[-1] in ("?", "*", "}"):
        # an optional word element is certain when what precedes it ends with one too
        if parts and parts[-1] in ("?", "*") and len(parts) > 1 and _is_word(parts[-2]):
            return _ends_word(parts[:-2])
        return False
    if parts[-1] == ")":
        depth = 0
        for i in range(len(parts) - 1, -1, -1):
            depth += (parts[i] == ")") - (parts[i] == "(")
            if depth == 0:
                body = _body(parts[i + 1 : -1])
                return body is not None and all(_ends_word(b) for b in _branches(body))
        return False
    return _is_word(parts[-1])


def ascii_bounds(pattern: str) -> str:
    """Replace every ``\\b`` with an explicit ASCII word boundary."""
    parts = _ELEMENT.findall(pattern)
    out = []
    for i, p in enumerate(parts):
        if p != r"\b":
            out.append(p)
        elif _starts_word(parts[i + 1 :]):
            out.append(_START)
        elif _ends_word(parts[:i]):
            out.append(_END)
        else:
            out.append(_BOUND)
    return "".join(out)


def glob_regex(glob: str) -> str:
    """Anchored regex of a path glob: ``**/`` any folders, ``**`` anything, ``*`` within one folder."""
    steps = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*"}
    body = re.sub(
        r"\*\*/|\*\*|\*|[^*]+", lambda m: steps.get(m.group(0)) or re.escape(m.group(0)), glob
    )
    return f"^{body}$"


def literal_regex(text: str) -> str:
    return re.escape(text)
