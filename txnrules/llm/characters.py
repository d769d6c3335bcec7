"""Kinds of characters by Unicode category, for whole arrays of code points."""

from __future__ import annotations

import unicodedata

import numpy as np

OTHER, LETTER, NUMBER, WHITE, UNKNOWN = range(5)
# The characters that Unicode calls white space.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Code point to its kind; built once per worker."""
    if not _kinds:
        of = {"L": LETTER, "N": NUMBER}
        found = np.array([UNKNOWN if (k := unicodedata.category(chr(c))) == "Cn" else of.get(k[0], OTHER) for c in range(0x110000)], np.uint8)
        found[WHITE_SPACE] = WHITE
        _kinds.append(found)
    return _kinds[0]
