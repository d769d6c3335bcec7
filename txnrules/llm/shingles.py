"""Shingle sets, MinHash signatures and exact Jaccard links, in numpy over batches of texts."""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5  # words of a shingle
CHARS = 7  # characters of a character shingle
AT_ONCE = 1_000_000  # bytes of text hashed at a time
SPREAD = np.uint64(0x9E3779B97F4A7C15)
LOWER_OR_SPACE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_rng = np.random.default_rng(77)
_PLACE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_FLIP = _rng.integers(0, 1 << 32, 256, dtype=np.uint32)
_TIMES = _rng.integers(0, 1 << 32, 256, dtype=np.uint32) | np.uint32(1)


def normal_words(text: str | None) -> bytes:
    """Words (ASCII letters lower-cased, digits, all non-ASCII characters) joined by one space."""
    return b" ".join((text or "").encode().translate(LOWER_OR_SPACE).split())


def digest(text: bytes) -> bytes:
    return hashlib.md5(text, usedforsecurity=False).digest()


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * SPREAD
    return h ^ (h >> np.uint64(29))


def runs(texts: list[bytes]):
    """Slices of texts of about AT_ONCE bytes."""
    start, total = 0, 0
    for k, t in enumerate(texts):
        if total and total + len(t) > AT_ONCE:
            yield start, k
            start, total = k, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def word_hashes(joined: bytes, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and first byte of every word, and its text, of texts of these sizes joined; blanks and line ends part words."""
    b = np.frombuffer(joined, np.uint8)
    space = (b == 32) | (b == 10)
    inside = ~space
    start = np.flatnonzero(inside & np.concatenate([[True], space[:-1]]))
    if not len(start):
        return np.zeros(0, np.uint64), start, start
    place = np.arange(len(b)) - np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [len(b)]])))
    word = mixed(np.add.reduceat(np.where(inside, (b.astype(np.uint64) + np.uint64(1)) * _PLACE[place & 255], np.uint64(0)), start))
    return word, start, np.searchsorted(np.cumsum(sizes), start, "right")


def word_shingles(texts: list[bytes], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of texts from normal_words, one text after the other, and each text's number of them.

    A text of fewer words, but not none, is one shingle.
    """
    word, start, doc = word_hashes(b"\n".join(texts) + b"\n", [len(t) + 1 for t in texts])
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    words = np.bincount(doc, minlength=len(texts))
    size = np.minimum(words, n)
    counts = words - size + (words > 0)
    first = np.cumsum(words) - words
    of = np.repeat(np.arange(len(texts)), counts)
    at = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        more = k < size[of]
        h = np.where(more, h * np.uint64(0x100000001B3) + word[np.minimum(at + k, len(word) - 1)], h)
    return mixed(h), counts


def char_shingles(texts: list[bytes], n: int = CHARS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-character windows (code points) of each text, and how many; a shorter text, but not an empty one, is one window."""
    joined = b"".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    if joined.isascii():
        c = np.frombuffer(joined, np.uint8)
    else:
        starts = np.cumsum(np.concatenate([[0], (np.frombuffer(joined, np.uint8) & 0xC0) != 0x80]))
        ends = np.cumsum(sizes)
        sizes = starts[ends] - starts[ends - sizes]
        c = np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32)
    c = np.concatenate([c.astype(np.uint64) + np.uint64(1), np.zeros(n, np.uint64)])
    counts = np.maximum(sizes - n, -1) + 1 + ((sizes > 0) & (sizes < n))
    first = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(texts)), counts)
    at = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    window = np.zeros(len(c) - n + 1, np.uint64)
    for k in range(n):
        window = window * SPREAD + c[k : k + len(window)]
    h = window[at]
    ends = np.cumsum(counts)
    for k in np.flatnonzero((sizes > 0) & (sizes < n)).tolist():  # without the characters of the next text
        own = 0
        for x in [*c[first[k] : first[k] + sizes[k]].tolist(), *[0] * (n - int(sizes[k]))]:
            own = (own * int(SPREAD) + x) & 0xFFFFFFFFFFFFFFFF
        h[ends[k] - 1] = own
    return h, counts


def signatures(shingles: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """`size` MinHash values per set; a set without members has zeros."""
    out = np.zeros((len(counts), size), np.uint32)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    x = (mixed(shingles) >> np.uint64(32)).astype(np.uint32)
    first = np.cumsum(counts[some]) - counts[some]
    for k in range(size):
        out[some, k] = np.minimum.reduceat((x ^ _FLIP[k]) * _TIMES[k], first)
    return out


def band_hashes(signature: np.ndarray, rows: int) -> np.ndarray:
    """One hash per band of `rows` values."""
    n, size = signature.shape
    bands = size // rows
    h = np.tile(np.arange(bands, dtype=np.uint64) + np.uint64(1), (n, 1))
    parts = signature[:, : bands * rows].reshape(n, bands, rows)
    for k in range(rows):
        h = h * np.uint64(0x100000001B3) + parts[:, :, k]
    return mixed(h).view(np.int64)


def split_sets(shingles: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct members of each set."""
    return [np.unique(x) for x in np.split(shingles, np.cumsum(counts)[:-1])] if len(counts) else []


def similar_pairs(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, over: int, under: int) -> np.ndarray:
    """Which pairs (a[k], b[k]) have an exact Jaccard similarity of at least over / under."""
    if not len(a):
        return np.zeros(0, bool)
    sizes = np.array([len(s) for s in sets])
    used = np.unique(np.concatenate([a, b]))
    if len(a) * int(sizes[used].mean() + 1) < 50_000 or len(a) < 2 * len(used):
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)])
    else:
        common = _common(sets, used, sizes)[np.searchsorted(used, a), np.searchsorted(used, b)]
    return (under * common >= over * (sizes[a] + sizes[b] - common)) & (common > 0)


def _common(sets: list[np.ndarray], used: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sizes of all intersections, from the members that at least two sets share, a block of members at a time."""
    members, column, times = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(used)), sizes[used])
    shared = times[column] > 1
    number = np.cumsum(times > 1) - 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(used), len(used)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 1024):
        lo, hi = np.searchsorted(column, [at, at + 1024])
        m = np.zeros((len(used), 1024), np.float32)
        m[row[lo:hi], column[lo:hi] - at] = 1
        total += m @ m.T
    return total.astype(np.int64)
