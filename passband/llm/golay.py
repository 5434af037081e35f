"""The binary Golay code of length 23: nearest codewords of 23-bit words, over whole arrays.

The code is perfect: every word lies within three bits of exactly one codeword.  A word at distance
three has five more codewords at distance four, and no other word has any.  So if two words differ
in at most one bit, the nearest codeword of either is among the near codewords of the other.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LENGTH, CHECK = 23, 11
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, a generator of the code.
GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for shift in range(LENGTH - 1, CHECK - 1, -1):
        if word >> shift & 1:
            word ^= GENERATOR << (shift - CHECK)
    return word


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and of the high 11 bits, and per remainder up to six error words."""
    low = np.array([_remainder(x) for x in range(1 << 12)], np.int32)
    high = np.array([_remainder(x << 12) for x in range(1 << 11)], np.int32)
    errors: list[list[int]] = [[] for _ in range(1 << CHECK)]
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            error = sum(1 << b for b in bits)
            found = errors[int(low[error & 0xFFF] ^ high[error >> 12])]
            if weight < 4 or found[0].bit_count() == 3:
                found.append(error)
    table = np.full((1 << CHECK, 6), -1, np.int32)
    for i, found in enumerate(errors):
        table[i, : len(found)] = found
    return low, high, table


def near(words: np.ndarray) -> np.ndarray:
    """Per word six columns of codeword indices (12 bits): the nearest first, -1 where there are fewer."""
    low, high, table = _tables()
    words = words.astype(np.int32)
    errors = table[low[words & 0xFFF] ^ high[words >> 12]]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> CHECK)
