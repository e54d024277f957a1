"""Name matching on plain strings, for the ordered fold; equal to the expressions of ``functions.text``, which fold by the same table."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from mnemograph.functions.text import FOLDS

_TABLE = str.maketrans(FOLDS)


def lower_tokens(text: str) -> list[str]:
    """Lower-case runs of letters, marks and digits."""
    out, run = [], []
    for c in text.lower():
        if unicodedata.category(c)[0] in "LMN":
            run.append(c)
        elif run:
            out.append("".join(run))
            run = []
    return [*out, "".join(run)] if run else out


def fold(text: str) -> str:
    """Lower case without diacritics."""
    return text.lower().translate(_TABLE)


@lru_cache(100_000)
def _tokens(name: str) -> tuple[str, ...]:
    return tuple(t for t in lower_tokens(fold(name)) if len(t) > 1)


def name_tokens(name: str) -> frozenset[str]:
    """Folded tokens of two characters or more."""
    return frozenset(_tokens(name))


def initials(name: str) -> str:
    """First letters; empty for fewer than two tokens."""
    own = _tokens(name)
    return "".join(t[0] for t in own) if len(own) > 1 else ""


def matches(a: str, b: str) -> bool:
    """Equal token sets, a subset, or one token that is the other's initials."""
    x, y = name_tokens(a), name_tokens(b)
    if not x or not y:
        return False
    return x <= y or y <= x or (len(x) == 1 and next(iter(x)) == initials(b)) or (len(y) == 1 and next(iter(y)) == initials(a))
