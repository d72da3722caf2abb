"""Hashes of words and of word n-grams for whole batches of texts."""

from __future__ import annotations

import numpy as np

SLICE = 1 << 20
RATIO = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(RATIO), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose outcomes look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(fold_case: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=np.uint64) * RATIO)
    if fold_case:
        table[65:91] = table[97:123]
    return table


PLAIN, FOLDED = byte_values(False), byte_values(True)


def words(data: np.ndarray, offsets: np.ndarray, fold_case: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without ASCII white space), offsets of each text among them, and where each starts."""
    n = len(data)
    solid = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = solid & (edge[:-1] | np.concatenate([[True], ~solid[:-1]])) if n else solid
    last = solid & (edge[1:] | np.concatenate([~solid[1:], [True]])) if n else solid
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    powers = np.cumprod(np.full(n + 1, RATIO)) if n else np.zeros(1, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((FOLDED if fold_case else PLAIN)[data] * powers[:n])])
    down = np.cumprod(np.full(n + 1, INVERSE)) if n else powers
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    return hashes, np.searchsorted(starts, offsets), starts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the offsets of each text among them.

    A text of fewer than ``size`` words has its whole sequence as one shingle, without words none.
    """
    hashes, bounds, _ = words(data, offsets)
    counts = np.diff(bounds)
    factor = mix(np.arange(1, size + 1, dtype=np.uint64) * RATIO)
    total = max(0, len(hashes) - size + 1)
    rolled = np.zeros(total, np.uint64)
    for j in range(size):
        rolled += hashes[j : j + total] * factor[j]
    text = np.repeat(np.arange(len(counts)), counts)
    inside = text[:total] == text[size - 1 :] if total else np.zeros(0, bool)
    short = np.flatnonzero((counts > 0) & (counts < size))
    whole = np.zeros(len(short), np.uint64)
    for j in range(size - 1):
        has = counts[short] > j
        whole[has] += hashes[bounds[short[has]] + j] * factor[j]
    whole += counts[short].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    keys, text = mix(np.concatenate([rolled[inside], whole])), np.concatenate([text[:total][inside], short])
    order = np.lexsort((keys, text))
    keys, text = keys[order], text[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    return keys[new], np.searchsorted(text[new], np.arange(len(offsets)))


def set_keys(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit number for each set, the same for equal sets; 0 for an empty one."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(keys ^ RATIO))])
    return np.where(np.diff(bounds) > 0, mix(sums[bounds[1:]] - sums[bounds[:-1]]), np.uint64(0)).astype(np.int64)
