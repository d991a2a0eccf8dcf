"""Fingerprints of byte strings, for every position of a buffer at once.

The hash of ``text[i:j]`` is a polynomial in an odd base modulo 2**64, taken from running sums, so
any substring costs O(1). The strings compared here are shorter than 2,048 bytes, below which no
structured collision of this family is known; callers compare two such numbers together where a
chance collision would change a result.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15  # odd
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; a bijection."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Hashes:
    """Hashes of the substrings of one buffer."""

    def __init__(self, data: bytes):
        codes = np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(codes * powers(BASE, self.n), out=self.sums[1:])
        self.back = powers(INVERSE, self.n + 1)

    def at(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hash of the ``length`` bytes from each ``start``."""
        return mix((self.sums[start + length] - self.sums[start]) * self.back[start])

    def every(self, length: int) -> np.ndarray:
        """Hash of the ``length`` bytes from every position that has as many."""
        count = max(0, self.n - length + 1)
        return mix((self.sums[length : length + count] - self.sums[:count]) * self.back[:count])
