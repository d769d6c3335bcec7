"""Parts of a text that byte-level and piece-wise tokenizers encode independently of each other."""

from __future__ import annotations

import re

UNCLEAN = re.compile(r"\s \s|  |^ | $")


def stretches(text: str) -> list[str]:
    """Parts of the text, without the space that each but the first begins with: cuts are before a space that has no space beside it, nor white space on both sides.

    No word of a byte-level tokenizer reaches over such a place, as a word has a space at its start only, and a run of white space gives its last space to the word after it.
    """
    parts = text.split(" ")
    if not UNCLEAN.search(text):
        return parts
    out = parts[:1]
    for part in parts[1:]:
        if part and out[-1] and out[-1][-1] != " " and not (out[-1][-1].isspace() and part[0].isspace()):
            out.append(part)
        else:
            out[-1] += " " + part
    return out
