"""The binary Golay code of length 23, as a means to find bit strings that nearly agree.

Every 23-bit string is within 3 bits of exactly one codeword. keys() gives the indices of all codewords within 4 bits:
the nearest, and if that is 3 bits away, five more. Two strings that differ in at most 2 bits have a string between
them that is at most 1 bit from each; its nearest codeword is within 4 bits of both. So they share a key.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LENGTH, DATA, CHECK = 23, 12, 11
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each bit its remainder; for each syndrome its error, and what to add to the nearest codeword's index."""
    remainder = np.zeros(LENGTH, np.int64)
    value = 1
    for bit in range(LENGTH):
        remainder[bit] = value
        value <<= 1
        if value >> CHECK:
            value ^= GENERATOR
    error = np.zeros(1 << CHECK, np.int64)
    for size in range(4):
        for bits in combinations(range(LENGTH), size):
            s = 0
            for b in bits:
                s ^= int(remainder[b])
            error[s] = sum(1 << b for b in bits)
    index = np.arange(1 << DATA)
    check = np.zeros(1 << DATA, np.int64)
    for b in range(DATA):
        check ^= np.where(index >> b & 1, remainder[CHECK + b], 0)
    light = (index << CHECK | check)[np.bitwise_count(index << CHECK | check) == 7]
    more = np.full((1 << CHECK, 6), -1, np.int64)
    more[:, 0] = 0
    for s in np.flatnonzero(np.bitwise_count(error) == 3):
        more[s, 1:] = light[light & error[s] == error[s]] >> CHECK
    return remainder, error, more


def keys(strings: np.ndarray) -> np.ndarray:
    """For each 23-bit string the indices of the codewords within 4 bits, in 6 columns; -1 where there are fewer."""
    remainder, error, more = tables()
    strings = strings.astype(np.int64)
    syndrome = np.zeros(len(strings), np.int64)
    for bit in range(LENGTH):
        syndrome ^= np.where(strings >> bit & 1, remainder[bit], 0)
    nearest = (strings ^ error[syndrome]) >> CHECK
    extra = more[syndrome]
    return np.where(extra < 0, -1, nearest[:, None] ^ extra)
