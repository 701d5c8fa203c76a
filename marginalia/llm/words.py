"""Words of a batch of texts as 64-bit hashes, by numpy over the bytes of all texts at once.

A word is ``[^\\x20\\x09-\\x0D]+``. Its hash is a polynomial over the bytes, each byte mapped to a
random 64-bit number, modulo 2**64, with a finaliser. Two seeds give independent hashes.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words(NamedTuple):
    """start, end: byte positions of each word; doc: its text's index; first: the first word of each text, and the number of words."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def split(body: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of all texts in ``body``; a text's end also ends a word."""
    n_docs = len(offsets) - 1
    if len(body) == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(n_docs + 1, np.int64))
    gap = SPACE[body]
    begins = np.zeros(len(body) + 1, bool)
    begins[offsets] = True
    after = gap.copy()
    after[1:] = gap[:-1]
    after[0] = True
    start = np.flatnonzero(~gap & (after | begins[:-1]))
    before = gap.copy()
    before[:-1] = gap[1:]
    before[-1] = True
    end = np.flatnonzero(~gap & (before | begins[1:])) + 1
    first = np.searchsorted(start, offsets).astype(np.int64)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    return Words(start, end, doc, first)


@lru_cache(maxsize=8)
def _seeded(seed: int) -> tuple[np.ndarray, int]:
    rng = np.random.default_rng(0xB17E5 + seed)
    byte = rng.integers(1, 2**64 - 1, 256, dtype=np.uint64) | np.uint64(1)
    return byte, int(rng.integers(2**40, 2**64 - 1, dtype=np.uint64)) | 5


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


def hashes(body: np.ndarray, words: Words, lower: bool = False, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; ``lower`` maps A-Z to a-z first."""
    if len(words.start) == 0:
        return np.zeros(0, np.uint64)
    byte, base = _seeded(seed)
    byte = byte[_LOWER] if lower else byte.copy()
    byte[SPACE] = 0
    size = words.end - words.start
    longest, begin = int(size.max()), int(words.start[0])
    place = np.arange(begin, len(body), dtype=np.int32)
    place -= np.repeat(words.start.astype(np.int32), np.diff(np.append(words.start, len(body))))
    np.minimum(place, longest - 1, out=place)  # only white space is beyond, which counts nothing
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(longest - 1, np.uint64(base))]))
        h = np.add.reduceat(byte[body[begin:]] * power[place], words.start - begin)
    return mix(h ^ (words.end - words.start).astype(np.uint64))


def windows(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each ``n`` consecutive entries of ``h``, crossing texts; shorter by n - 1."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64(_seeded(seed + 101)[1])
    with np.errstate(over="ignore"):
        acc = h[:m].copy()
        for k in range(1, n):
            acc *= base
            acc += h[k : k + m]
    return mix(acc)
