"""The perfect binary Golay code [23, 12, 7]: every 23-bit word lies within 3 bits of exactly one codeword."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

BITS = 23
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


@lru_cache(maxsize=1)
def decode_table() -> np.ndarray:
    """For each 23-bit word, the 12-bit index of its codeword (the top bits of the corrected word)."""
    unit = []
    for i in range(BITS):
        s = 1 << i
        for k in range(BITS - 1, 10, -1):
            if s >> k & 1:
                s ^= GENERATOR << (k - 11)
        unit.append(s)
    error = np.zeros(2048, dtype=np.uint32)
    for weight in (1, 2, 3):
        for places in combinations(range(BITS), weight):
            s = e = 0
            for p in places:
                s ^= unit[p]
                e |= 1 << p
            error[s] = e
    words = np.arange(1 << BITS, dtype=np.uint32)
    syndrome = np.zeros(1 << BITS, dtype=np.uint16)
    for i in range(BITS):
        syndrome[1 << i : 2 << i] = syndrome[: 1 << i] ^ np.uint16(unit[i])
    return ((words ^ error[syndrome]) >> 11).astype(np.uint16)


def fuzzy_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices of each word and of its 23 neighbours at one bit: (row numbers, indices), each pair once.
    Two words that differ in at most two bits have a neighbour in common, and so an index."""
    table, words = decode_table(), words.astype(np.uint32)
    near = np.concatenate([[0], 1 << np.arange(BITS)]).astype(np.uint32)
    found = np.sort(table[words[:, None] ^ near[None, :]], axis=1)
    first = np.ones(found.shape, dtype=bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    rows, at = np.nonzero(first)
    return rows, found[rows, at]
