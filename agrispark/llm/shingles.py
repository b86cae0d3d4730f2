"""Shingle sets of texts and their circulant MinHash signatures."""

from __future__ import annotations

import numpy as np
import xxhash

from agrispark.llm.words import mixed

ROWS = 4  # minimum hashes per band
BANDS = 28
HASHES = ROWS * BANDS
_BLOCK = 512
_SHIFTS = np.arange(HASHES, dtype=np.uint32)[:, None]


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of the whole sequence if it is shorter; none without words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, np.uint64(size))
    for k in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[k:len(words) - size + 1 + k])
    return np.unique(out)


def set_id(shingles: np.ndarray) -> bytes:
    """128-bit name of a set: equal sets have equal names."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _second(x: np.ndarray) -> np.ndarray:
    """The second permutation, of 32-bit numbers; works in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    return x


def signature(shingles: np.ndarray) -> np.ndarray:
    """Circulant MinHash: the first permutation scatters the shingles over a circle of 2^32 places, the second one is
    shifted along the circle by one place per coordinate; each coordinate is the least image under it."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    places = (mixed(shingles) >> np.uint64(32)).astype(np.uint32)  # the first permutation
    for at in range(0, len(places), _BLOCK):
        images = _second(places[None, at:at + _BLOCK] + _SHIFTS)
        np.minimum(out, images.min(1), out=out)
    return out


def bands(sign: np.ndarray) -> np.ndarray:
    """One 64-bit bucket per band, different for equal rows of different bands."""
    rows = sign.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    if percent * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
