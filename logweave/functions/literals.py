"""Texts that a match of a pattern must hold, read from the pattern."""

from __future__ import annotations

import re
from re import _constants as c
from re import _parser

#: Texts of one pattern at most; a pattern with more is always tried.
MAX_TEXTS = 64


def required_texts(pattern: str) -> tuple[frozenset[str], bool] | None:
    """Texts of which every match of ``pattern`` holds at least one, and whether they are in lower case (any case matches).

    None if the pattern has no such texts, or is not understood: then any line may match.
    """
    try:
        parsed = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    lower = bool(parsed.state.flags & re.IGNORECASE)
    if "(?" in pattern.replace("(?:", "").replace("(?P<", "").replace("(?<", "") and not pattern.startswith("(?i)"):
        return None  # flags, lookaround and the like inside: try every line
    found = _of(parsed)
    if found is None or (lower and not all(t.isascii() for t in found)):
        return None
    return frozenset(t.lower() for t in found) if lower else found, lower


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """The choice whose shortest text is longer (of equal ones, the smaller choice)."""
    if a is None or b is None:
        return a or b
    return max(a, b, key=lambda s: (min(map(len, s)), -len(s)))


def _of(parsed) -> frozenset[str] | None:
    best, run = None, ""
    for op, value in [*parsed, (None, None)]:
        if op is c.LITERAL:
            run += chr(value)
            continue
        if run:
            best, run = _better(best, frozenset([run])), ""
        if op is c.SUBPATTERN:
            best = _better(best, _of(value[3]) if not value[1] and not value[2] else None)
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and value[0] >= 1:
            best = _better(best, _of(value[2]))
        elif op is c.BRANCH:
            each = [_of(branch) for branch in value[1]]
            if all(each) and sum(map(len, each)) <= MAX_TEXTS:
                best = _better(best, frozenset().union(*each))
    return best
