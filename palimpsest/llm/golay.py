"""The binary [23, 12] Golay code as a fuzzy hash.

The code is perfect: every 23-bit vector lies within distance 3 of exactly one
codeword, so decoding always succeeds and yields a 12-bit codeword index.
``fuzzy_keys`` decodes a vector and every vector one bit away.  Two vectors at
distance 2 or less have a vector within one bit of both, hence share a key, and
a vector has at most 6 different keys (5 when its distance from the code is 3,
plus its own codeword; one otherwise).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH, DATA = 23, 12
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, a generator of the code.
GENERATOR = 0b101011100011


def _remainder(v: int) -> int:
    for i in range(LENGTH - 1, LENGTH - DATA - 1, -1):
        if v >> i & 1:
            v ^= GENERATOR << (i - (LENGTH - DATA))
    return v


#: Syndrome of the upper 12 bits; the lower 11 bits are their own remainder.
UPPER = np.array([_remainder(v << (LENGTH - DATA)) for v in range(1 << DATA)], dtype=np.int32)


def _patterns() -> np.ndarray:
    """The one error pattern of weight 3 or less for each of the 2,048 syndromes."""
    table = np.zeros(1 << (LENGTH - DATA), dtype=np.int32)
    for weight in (1, 2, 3):
        for places in combinations(range(LENGTH), weight):
            e = sum(1 << p for p in places)
            table[_remainder(e)] = e
    return table


ERRORS = _patterns()


def decode(v: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit vector."""
    v = np.asarray(v, dtype=np.int32)
    syndrome = UPPER[v >> (LENGTH - DATA)] ^ (v & ((1 << (LENGTH - DATA)) - 1))
    return (v ^ ERRORS[syndrome]) >> (LENGTH - DATA)


def encode(index: np.ndarray) -> np.ndarray:
    """Codeword of each 12-bit index."""
    index = np.asarray(index, dtype=np.int32)
    return index << (LENGTH - DATA) | UPPER[index]


def fuzzy_keys(v: np.ndarray, width: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs: the distinct codeword indices around each vector.

    ``width``: how many low bits are in use; the others are zero in all vectors.
    """
    v = np.asarray(v, dtype=np.int32)
    near = np.sort(decode(np.concatenate([v[:, None], v[:, None] ^ (1 << np.arange(width, dtype=np.int32))], axis=1)), axis=1)
    fresh = np.concatenate([np.ones((len(v), 1), dtype=bool), near[:, 1:] != near[:, :-1]], axis=1)
    row, _ = np.nonzero(fresh)
    return row, near[fresh]
