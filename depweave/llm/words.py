"""Words and shingles of whole texts, hashed inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers that mix two neighbouring word hashes.
_LEFT, _RIGHT, _ONE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, which is what the pattern asks for.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(text: str | None, size: int = 2) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; fewer words make one shingle of them all,
    no words an empty set."""
    hashes = word_hashes(text)
    n = len(hashes)
    if not n:
        return hashes
    width = min(size, n)
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out = out * _LEFT + hashes[i : n - width + 1 + i] * _RIGHT
        out ^= out >> np.uint64(29)
    out = np.sort(mixed(out + _ONE))
    return out[np.concatenate(([True], out[1:] != out[:-1]))]
