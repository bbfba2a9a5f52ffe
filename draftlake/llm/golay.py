"""The perfect binary Golay code: 4,096 words of 23 bits, any two of which differ in at least seven."""

from __future__ import annotations

from functools import cache

import numpy as np

BITS = 23
GENERATOR = 0b101011100011  # polynomial of the code


@cache
def codewords() -> np.ndarray:
    """The word of each index; indices below 2,048 and their complements are the whole code."""
    index = np.arange(4096, dtype=np.int64)
    code = np.zeros(4096, np.int64)
    for bit in range(12):
        code ^= np.where(index >> bit & 1, GENERATOR << bit, 0)
    return code


@cache
def golay_index() -> np.ndarray:
    """For each word of 23 bits the index of the codeword within three bits of it."""
    one = 1 << np.arange(BITS, dtype=np.int64)
    two = (one[:, None] | one)[np.triu_indices(BITS, 1)]
    three = np.unique((two[:, None] | one).ravel())
    three = three[np.bitwise_count(three.astype(np.uint32)) == 3]
    table = np.empty(1 << BITS, np.int16)
    for error in np.concatenate([[0], one, two, three]):
        table[codewords() ^ error] = np.arange(4096)
    return table
