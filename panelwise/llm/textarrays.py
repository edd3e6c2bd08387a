"""Words and word windows of many texts as flat numpy arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from panelwise.llm.common import code_points

GOLDEN = 0x9E3779B97F4A7C15
POWERS = np.cumprod(np.full(64, GOLDEN, np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over all places."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def segment_hashes(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each (non-empty) segment of an array: the sum of its mixed values and places."""
    n = ends - begins
    if not len(n):
        return np.zeros(0, np.uint64)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    x = values[np.repeat(begins, n) + place].astype(np.uint64)
    x = mixed(x + POWERS[place & 63] + (place.astype(np.uint64) << np.uint64(32)))
    return mixed(np.add.reduceat(x, np.cumsum(n) - n))


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words (runs without ASCII white space): hash, first and last-plus-one character in its text; and words per text."""
    flat, at = code_points([t + "\n" for t in texts])
    solid = (flat != 32) & ((flat < 9) | (flat > 13))
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    counts = np.diff(np.searchsorted(begins, at))
    origin = np.repeat(at[:-1], counts)
    return segment_hashes(flat, begins, ends), begins - origin, ends - origin, counts


def windows(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `size` words within each text, and windows per text; a shorter text is one window, if it has words."""
    n = len(hashes)
    ends = np.cumsum(counts)
    begins = ends - counts
    many = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    first = np.repeat(begins, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    stop = np.repeat(ends, many)
    x = np.zeros(len(first), np.uint64)
    for k in range(size):
        inside = first + k < stop
        x += np.where(inside, hashes[np.minimum(first + k, max(n - 1, 0))] if n else x, np.uint64(k + 1)) * POWERS[k]
    return mixed(x), many
