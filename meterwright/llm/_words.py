"""Word and word-window hashes of texts, in NumPy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Fixed odd multipliers of the polynomial and the mixer.
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as bytes; bytes.split() and lower() know ASCII only, as is wanted."""
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= _MIX
    return h ^ (h >> np.uint64(32))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive words: a polynomial put together from windows of 1, 2, 4 ... words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out, done, part, width, factor = None, 0, hashes, 1, _STEP
    while width <= size:
        if size & width:
            piece = part[done : done + n]
            out = piece.copy() if out is None else out * factor + piece
            done += width
        if 2 * width <= size:
            part = part[: len(part) - width] * factor + part[width:]
        with np.errstate(over="ignore"):
            factor = factor * factor
        width *= 2
    return _mixed(out)


def second_hashes(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same words, for a second hash of their windows."""
    return _mixed(hashes * _MIX + _STEP)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's lower-cased word shingles; a shorter text is one shingle, one without words none."""
    words = words_of(text, lower=True)
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = word_hashes(words)
    return np.unique(window_hashes(hashes, min(size, len(words))))


def first_of_equal(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every element: whether it is the first of its value, and how often the value is there. The order stays:
    rows of one document go out together, which shuffles in half the bytes."""
    order = np.argsort(values, kind="stable")
    head = np.ones(len(values), dtype=bool)
    head[1:] = values[order][1:] != values[order][:-1]
    run = np.cumsum(head) - 1
    first, held = np.empty(len(values), dtype=bool), np.empty(len(values), dtype=np.int64)
    first[order] = head
    held[order] = np.bincount(run)[run] if len(run) else 0
    return first, held
