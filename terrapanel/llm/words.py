"""Words of many texts at once, as numbers: what the operators on words share inside a task."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(0, bool)


def spaces() -> np.ndarray:
    """Which code points are white space."""
    global _SPACE
    if not len(_SPACE):
        _SPACE = np.fromiter((chr(c).isspace() for c in range(0x110000)), bool, 0x110000)
    return _SPACE


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


@dataclass(frozen=True)
class Words:
    """Words between white space: ``doc`` (row), ``start`` and ``end`` (places in ``codes``) and a 64-bit ``hash`` of each.

    ``codes`` holds the code points of all texts, each after one space.
    """

    codes: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def read(texts: list[str | None], lower: bool = False) -> Words:
    joined = [" " + (t.lower() if lower else t) if t else " " for t in texts]
    sizes = np.fromiter(map(len, joined), np.int64, len(joined))
    codes = np.frombuffer(("".join(joined) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    space = spaces()[codes]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    if not len(start):
        return Words(codes, start, start, end, np.zeros(0, np.uint64))
    doc = np.searchsorted(np.cumsum(sizes), start, side="right")
    size = end - start
    inside = np.flatnonzero(~space)
    first = np.cumsum(size) - size
    place = np.arange(len(inside)) - np.repeat(first, size)
    power = np.cumprod(np.full(int(size.max()), _BASE, np.uint64), dtype=np.uint64)
    value = (codes[inside].astype(np.uint64) + np.uint64(1)) * power[place]
    return Words(codes, doc, start, end, mixed(np.add.reduceat(value, first)))


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of every run of ``width`` words, and of the whole text where it has fewer (but some)."""
    n, doc, h = len(words.hash), words.doc, words.hash
    if not n:
        return doc, h
    out = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        out = out * _BASE + h[k : k + len(out)]
    inside = doc[: len(out)] == doc[width - 1 :]
    docs, count = np.unique(doc, return_counts=True)
    first = np.cumsum(count) - count
    short = count < width
    docs, first, count = docs[short], first[short], count[short]
    extra = np.zeros(len(docs), np.uint64)
    for k in range(width - 1):
        there = count > k
        extra[there] = extra[there] * _BASE + h[first[there] + k] + np.uint64(7)
    return np.r_[doc[: len(out)][inside], docs.astype(doc.dtype)], mixed(np.r_[out[inside], extra])
