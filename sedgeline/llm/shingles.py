"""Sets of word sequences as sorted 64-bit hashes, computed for a batch of texts at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Words whose hashes a worker keeps.
_CACHED = 500_000


class _Hashes(dict):
    """The hash of each word met so far."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_cache = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    if len(_cache) > _CACHED:
        _cache.clear()
    return np.fromiter(map(_cache.__getitem__, words), np.uint64, len(words))


def batch_words(texts: list[str | None], split: Callable[[str], list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts, number of words of each text); null has none."""
    flat: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            w = split(t)
            counts[i] = len(w)
            flat.extend(w)
    return word_hashes(flat), counts


def sequences(h: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every sequence of n successive words; none crosses texts."""
    if len(h) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    x = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        x = mix(x * _MIX + h[k : len(h) - n + 1 + k])
    inside = doc[: len(x)] == doc[n - 1 :]
    return x[inside], doc[: len(x)][inside]


def distinct(x: np.ndarray, doc: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes without repeats in a text, sorted in each text; how many each text has)."""
    order = np.lexsort((x, doc))
    x, doc = x[order], doc[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    return x[new], np.bincount(doc[new], minlength=texts)
