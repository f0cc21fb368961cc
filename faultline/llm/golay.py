"""Keys of 23-bit words from the perfect binary Golay code.

Every 23-bit word lies within three bits of exactly one codeword. A word's own key is the 12-bit index of the
codeword nearest to it, and its parity; its near keys are the own keys of itself and of each word one bit away: two
or seven of them. Words that differ in at most one bit hold each other's own key among their near keys.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, a factor of x^23 + 1
WIDTH, PARITY = 23, 11


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(syndrome of each single bit, error pattern of each syndrome)."""
    single = np.zeros(WIDTH, dtype=np.uint32)
    for bit in range(WIDTH):
        rest = 1 << bit
        for top in range(bit, PARITY - 1, -1):
            if rest >> top & 1:
                rest ^= GENERATOR << (top - PARITY)
        single[bit] = rest
    errors = np.zeros(1 << PARITY, dtype=np.uint32)
    for weight in (1, 2, 3):
        for bits in combinations(range(WIDTH), weight):
            at = 0
            for b in bits:
                at ^= int(single[b])
            errors[at] = sum(1 << b for b in bits)
    return single, errors


def syndromes(words: np.ndarray) -> np.ndarray:
    single, _ = tables()
    out = np.zeros(len(words), dtype=np.uint32)
    for bit in range(WIDTH):
        out ^= np.where(words >> np.uint32(bit) & np.uint32(1), single[bit], np.uint32(0))
    return out


def parity(words: np.ndarray) -> np.ndarray:
    for shift in (16, 8, 4, 2, 1):
        words = words ^ (words >> np.uint32(shift))
    return words & np.uint32(1)


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(own key of 13 bits, sorted near keys of shape (n, 24)); equal near keys repeat."""
    single, errors = tables()
    words = words.astype(np.uint32)
    at, odd = syndromes(words), parity(words)
    index = lambda x: (x >> np.uint32(PARITY)) << np.uint32(1)
    own = index(words ^ errors[at]) | odd
    near = np.empty((len(words), WIDTH + 1), dtype=np.uint32)
    near[:, WIDTH] = own
    for bit in range(WIDTH):
        near[:, bit] = index(words ^ np.uint32(1 << bit) ^ errors[at ^ single[bit]]) | (odd ^ np.uint32(1))
    return own, np.sort(near, axis=1)
