"""Texts that a regular expression cannot match without.

`required` gives literals of which at least one occurs in every text that the pattern matches, ignoring case, or nothing if it can't tell. It looks at printable ASCII
alone: what else a pattern has (classes, other alphabets, optional parts, look-arounds to the left out) only splits its literals. Patterns are read with Python's re; where
Java's dialect may mean something else (inline flags, nested classes, quoting), nothing is told, which is always right.
"""

from __future__ import annotations

import re
from re import _constants as K
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAM = 3
SIZES = (3, 4, 5, 6, 8, 16)  # characters of the keys that literals are looked up by
MOST = 8  # alternatives that are looked for one by one
# The characters outside ASCII that Java matches with an ASCII letter when it ignores case.
SAME_LETTERS = ("ſKıİ", "skii")
_UNICODE_CLASS = re.compile(r"\\[pP](?:\{[^}]*\}|\w)")
_OTHER_MEANING = re.compile(r"\\[0QEGRXZzhHvVkK]|\(\?(?![:=!<P])|\[[^\]]*\[|&&|\\x\{")


def folded(text: Column | str) -> Column:
    """Text as literals are compared: lower case, with the letters that count as ASCII ones."""
    return F.lower(F.translate(text if isinstance(text, Column) else F.col(text), *SAME_LETTERS))


def required(pattern: str | None) -> list[str] | None:
    """Lower-case literals of GRAM characters and more, one of which is in every match; None if there is no telling."""
    return max(choices(pattern), key=_worth, default=None)


def choices(pattern: str | None) -> list[list[str]]:
    """All sets of such literals that are known: of each set, one literal is in every match."""
    if pattern is None or _OTHER_MEANING.search(pattern):
        return []
    read = _UNICODE_CLASS.sub(".", pattern)
    if "(?<=" not in read and "(?<!" not in read:
        read = read.replace("(?<", "(?P<")  # a named group in Java's form
    try:
        parsed = _parser.parse(read)
    except (re.error, OverflowError, RecursionError):
        return []
    return [sorted(set(option)) for option in _options(parsed) if option and _worth(option)[0] >= GRAM]


def _worth(option: list[str]) -> tuple[int, int]:
    """Longer literals first, then fewer."""
    return min(map(len, option)), -len(option)


def _options(parsed) -> list[list[str]]:
    """Sets of literals, each of which holds one that every match has."""
    found: list[list[str]] = []
    run: list[str] = []

    def ended():
        if run:
            found.append(["".join(run)])
            run.clear()

    def walk(items):
        for kind, value in items:
            if kind is K.LITERAL and 32 <= value < 127:
                run.append(chr(value).lower())
            elif kind is K.SUBPATTERN:
                walk(value[3])
            elif kind is K.BRANCH:
                ended()
                each = [max(_options(branch), key=_worth, default=None) for branch in value[1]]
                if all(each) and sum(map(len, each)) <= MOST:
                    found.append([x for option in each for x in option])
            else:
                ended()
                if kind in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and value[0] > 0:
                    found.extend(_options(value[2]))
                elif kind is K.ATOMIC_GROUP:
                    found.extend(_options(value))
                elif kind is K.ASSERT:
                    found.extend(_options(value[1]))
        return found

    walk(parsed)
    ended()
    return found


def grams(text: Column) -> Column:
    """Distinct sequences of GRAM characters of an array of characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(text) - GRAM), lambda i: F.concat(*[F.get(text, i + k) for k in range(GRAM)])))


def key_size(literal: Column | str) -> Column:
    """The largest of SIZES that isn't longer than the literal."""
    size = F.lit(SIZES[0])
    for k in SIZES[1:]:
        size = F.when(F.length(literal) >= k, k).otherwise(size)
    return size


def keys(text: Column | str, sizes: Column) -> Column:
    """Distinct parts of a text, of as many characters as any of the sizes."""
    text = text if isinstance(text, Column) else F.col(text)
    starts = lambda n: F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(sizes, lambda n: F.transform(starts(n), lambda i: F.substring(text, i, n)))))
