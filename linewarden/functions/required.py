"""Texts of which a match of a pattern must hold one: what a scan can look for before it tries the pattern."""

from __future__ import annotations

import re
from re import _constants as C  # the parsed form of a pattern
from re import _parser

#: More alternatives than this say little; the pattern counts as one without required texts.
MOST = 16


def _plain(code: int, fold: bool) -> str | None:
    """The folded letter, if no other letter than its two cases can stand for it."""
    letter = chr(code)
    if not letter.isascii() or letter == "\n" or fold and letter in "iI":  # other letters fold to an i
        return None
    return letter.lower()


def _text(nodes, fold: bool) -> str | None:
    """The one text of nodes that are all letters."""
    out = ""
    for op, value in nodes:
        if op is C.SUBPATTERN and not value[1] and not value[2]:
            part = _text(value[3], fold)
        else:
            part = _plain(value, fold) if op is C.LITERAL else None
        if part is None:
            return None
        out += part
    return out


def _better(a: tuple[str, ...] | None, b: tuple[str, ...] | None) -> tuple[str, ...] | None:
    """The choice whose shortest text is longer; of equal ones that with fewer texts."""
    if not a or not b:
        return a or b
    return max(a, b, key=lambda x: (min(map(len, x)), -len(x)))


def _required(nodes, fold: bool) -> tuple[str, ...] | None:
    best, run = None, ""
    for op, value in [*nodes, (None, None)]:
        part = None
        if op is C.LITERAL:
            part = _plain(value, fold)
        elif op is C.SUBPATTERN and not value[1] and not value[2]:
            part = _text(value[3], fold)
        elif op is C.AT:
            continue  # a place between letters
        if part is not None:
            run += part
            continue
        best = _better(best, (run,) if run else None)
        run = ""
        if op is C.SUBPATTERN and not value[1] and not value[2]:
            best = _better(best, _required(value[3], fold))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] > 0:
            best = _better(best, _required(value[2], fold))
        elif op is C.BRANCH:
            each = [_required(branch, fold) for branch in value[1]]
            if all(each):
                together = tuple(sorted({text for texts in each for text in texts}))
                best = _better(best, together if len(together) <= MOST else None)
    return best


def required_texts(pattern: str) -> tuple[str, ...]:
    """Lower-case texts of which every matched line holds one, its case folded; () if none is known."""
    try:
        tree = _parser.parse(pattern)
    except (re.error, OverflowError):
        return ()
    if tree.state.flags & re.VERBOSE:
        return ()
    return _required(tree, bool(tree.state.flags & re.IGNORECASE)) or ()
