"""The binary Golay code [23, 12, 7] as a fuzzy hash, vectorised over arrays of words.

The code is perfect: every 23-bit word is within 3 bits of exactly one codeword. A word's keys
are the indices of all codewords within 4 bits: one key if the nearest is within 2 bits, six
otherwise. Two words that differ in at most 2 bits always have a key in common:
  - if one of them is within 2 bits of its codeword, the other is within 4 of the same one;
  - else both have distance 3; the seven-element differences between codewords through the
    three error positions split the other 20 positions into five blocks of four, and the block
    of a changed position leads to a codeword within 4 bits of both.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, the code's generator polynomial.
GENERATOR = 0b110001110101
BITS = 23
TOLERANCE = 2


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders by the upper 12 bits; for each syndrome the lightest error, and the errors of
    weight 4 (zero where the lightest weighs less than 3)."""
    high = np.zeros(4096, np.int64)
    for i in range(4096):
        r = i << 11
        for bit in range(22, 10, -1):
            if r >> bit & 1:
                r ^= GENERATOR << (bit - 11)
        high[i] = r

    def syndrome(e: int) -> int:
        return int(high[e >> 11]) ^ (e & 0x7FF)

    near = np.zeros(2048, np.int64)
    far: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for places in combinations(range(BITS), weight):
            e = sum(1 << p for p in places)
            if weight < 4:
                near[syndrome(e)] = e
            else:
                far[syndrome(e)].append(e)
    wide = np.zeros((2048, 5), np.int64)
    for s, errors in enumerate(far):
        if errors:
            wide[s] = errors
    return high, near, wide


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For int64 words of 23 bits: (row numbers, codeword indices of 12 bits), a row for each key."""
    high, near, wide = _tables()
    s = high[words >> 11] ^ (words & 0x7FF)
    rows = np.arange(len(words))
    extra = np.flatnonzero(wide[s, 0])
    more = (words[extra, None] ^ wide[s[extra]]) >> 11
    return np.concatenate([rows, np.repeat(extra, 5)]), np.concatenate([(words ^ near[s]) >> 11, more.ravel()])
