"""Words and word shingles as 64-bit hashes, vectorised over a batch of texts.

Words are the maximal runs of letters and digits of the lower-cased text. Null text has no words.
Hashes are functions of the words alone, so every task of every run gives the same values.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import chain

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_KEEP = 1_000_000  # chunks kept by a worker before it starts afresh


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Chunks(dict):
    """Hashes of the words of each chunk between white space; most chunks of a text were seen before."""

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        if len(self) > _KEEP:
            self.clear()
        v = self[chunk] = self.hashes(chunk)
        return v

    def hashes(self, chunk: str) -> tuple[int, ...]:
        return tuple(map(xxhash.xxh3_64_intdigest, WORD.findall(chunk)))


_chunks = Chunks()


def hashed(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after another, and the number of words of each text."""
    out, sizes, before = [], [], 0
    for t in texts:
        if t:
            out.extend(chain.from_iterable(map(_chunks.__getitem__, t.lower().split())))
        sizes.append(len(out) - before)
        before = len(out)
    return np.array(out, dtype=np.uint64), np.array(sizes, dtype=np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k successive values (len - k + 1 of them); order counts."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    acc = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        return mix(acc)


def shingles(texts: Iterable[str | None], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, text number of each, words of each text); a text of fewer than k words has none."""
    h, sizes = hashed(texts)
    s = rolled(h, k)
    own = np.repeat(np.arange(len(sizes)), sizes)
    if not len(s):
        return s, own[:0], sizes
    inside = own[: len(s)] == own[k - 1 :]
    return s[inside], own[: len(s)][inside], sizes


def signed(h: np.ndarray) -> np.ndarray:
    """As Spark's signed longs."""
    return h.astype(np.uint64).view(np.int64)
