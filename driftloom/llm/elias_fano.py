"""Elias-Fano coding of a non-decreasing sequence, with access, rank and search for whole arrays of queries at once.

n values below u take about 2 + log2(u / n) bits each: the low bits side by side, the high bits in unary (one 1 for each
value, one 0 for each step of the high part), and a running count of zeros for each 64-bit word as a directory.
Arrays lie in one buffer, so a file can be memory-mapped and used as it is.
"""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)
#: For each byte and k, the place of its k-th one bit (8 if there is none); built from the rule.
ONE_PLACE = np.full((256, 9), 8, dtype=np.uint8)
for _byte in range(256):
    for _k, _p in enumerate([p for p in range(8) if _byte >> p & 1]):
        ONE_PLACE[_byte, _k] = _p
EACH, TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
ODD, PAIRS, NIBBLES = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)


def packed(values: np.ndarray, width: int) -> np.ndarray:
    """Values of ``width`` bits side by side in 64-bit words (one spare word at the end)."""
    out = np.zeros(len(values) * width // 64 + 2, dtype=np.uint64)
    if width:
        at = np.arange(len(values), dtype=np.uint64) * np.uint64(width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(out, word, values << shift)
        over = shift + np.uint64(width) > np.uint64(64)
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return out


def unpacked(words: np.ndarray, width: int, index: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(index), dtype=np.uint64)
    at = index.astype(np.uint64) * np.uint64(width)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return (low | high) & (((ONE << np.uint64(width)) - ONE) if width < 64 else ~np.uint64(0))


def place_in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th one in each 64-bit word: running bit counts of the eight octets stand in the octets of one word,
    and comparing them all with k at once tells the octet."""
    k = k.astype(np.uint64)
    s = words - ((words >> np.uint64(1)) & ODD)
    s = (s & PAIRS) + ((s >> np.uint64(2)) & PAIRS)
    ends = ((s + (s >> np.uint64(4))) & NIBBLES) * EACH
    octet = np.minimum(np.bitwise_count(((k * EACH | TOPS) - ends) & TOPS), 7).astype(np.uint64)
    shift = octet << np.uint64(3)
    before = ((ends << np.uint64(8)) >> shift) & np.uint64(255)
    own = (words >> shift) & np.uint64(255)
    return shift.astype(np.int64) + ONE_PLACE[own.astype(np.intp), np.minimum(k - before, np.uint64(8)).astype(np.intp)]


class EliasFano:
    """header: n, low width, number of low words, number of high words."""

    HEAD = 4

    def __init__(self, buffer: np.ndarray):
        """``buffer``: the uint64 array that ``encode`` made."""
        n, width, lows, highs = (int(x) for x in buffer[: self.HEAD])
        self.n, self.width = n, width
        at = self.HEAD
        self.low = buffer[at : at + lows]
        self.high = buffer[at + lows : at + lows + highs]
        self.zeros = buffer[at + lows + highs : at + lows + highs + highs // 2 + 1].view(np.uint32)[: highs + 1]

    @staticmethod
    def encode(values: np.ndarray, universe: int | None = None) -> np.ndarray:
        values = np.ascontiguousarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        universe = max(top + 1, universe or 0)
        width = max(0, (universe // max(1, n)).bit_length() - 1)
        low = packed(values & np.uint64((1 << width) - 1), width)
        parts = values >> np.uint64(width)
        size = n + (top >> width) + 2
        size += -size % 128 + 64
        size += -(size // 64) % 2 * 64
        bits = np.zeros(size, dtype=np.uint8)
        bits[parts.astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        zeros = np.zeros(len(high) + 2 - len(high) % 2, dtype=np.uint32)
        zeros[1 : len(high) + 1] = np.cumsum(64 - np.bitwise_count(high).astype(np.int64))
        return np.concatenate([np.array([n, width, len(low), len(high)], dtype=np.uint64), low, high, zeros.view(np.uint64)])

    def start_of(self, part: np.ndarray) -> np.ndarray:
        """Place in the high bits just after the zero that precedes the values whose high part is ``part``."""
        part = part.astype(np.int64)
        word = np.searchsorted(self.zeros, part, side="left") - 1
        word = np.where(part > 0, word, 0)
        k = part - 1 - self.zeros[word].astype(np.int64)
        at = 64 * word + place_in_word(~self.high[word], np.maximum(k, 0)) + 1
        return np.where(part > 0, at, 0)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The index of each value, or -1: successor search, by bisection among the values of the same high part, of which a
        dense stretch of the sequence has many."""
        values = np.asarray(values, dtype=np.uint64)
        out = np.full(len(values), -1, dtype=np.int64)
        part = values >> np.uint64(self.width)
        live = np.flatnonzero(part < np.uint64(self.zeros[-1]))
        if not live.size or not self.n:
            return out
        wanted, part = values[live] & np.uint64((1 << self.width) - 1), part[live].astype(np.int64)
        at = self.start_of(part)
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        bits = (self.high[word] >> shift) | np.where(shift > 0, self.high[np.minimum(word + 1, len(self.high) - 1)] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        run = np.bitwise_count(bits & ~(bits + ONE)).astype(np.int64)  # ones up to the next zero; the last word has none
        long = np.flatnonzero(run == 64)
        run[long] = self.start_of(part[long] + 1) - at[long] - 1
        first = at - part
        last = first + run
        some = first < last
        live, wanted, first, last = live[some], wanted[some], first[some], last[some]
        low, high = first, last.copy()
        open_ = np.flatnonzero(high - low > 1)
        while open_.size:  # the last value that is not above the wanted one lies in [low, high)
            mid = (low[open_] + high[open_]) >> 1
            above = unpacked(self.low, self.width, mid) > wanted[open_]
            high[open_] = np.where(above, mid, high[open_])
            low[open_] = np.where(above, low[open_], mid)
            open_ = open_[high[open_] - low[open_] > 1]
        same = unpacked(self.low, self.width, low) == wanted
        out[live[same]] = low[same]
        return out

    def access(self, index: np.ndarray) -> np.ndarray:
        """The values at these indices."""
        index = np.asarray(index, dtype=np.int64)
        ones = 64 * np.arange(len(self.zeros), dtype=np.int64) - self.zeros.astype(np.int64)
        word = np.searchsorted(ones, index, side="right") - 1
        at = 64 * word + place_in_word(self.high[word], index - ones[word])
        return ((at - index).astype(np.uint64) << np.uint64(self.width)) | unpacked(self.low, self.width, index)

    def all(self) -> np.ndarray:
        """Every value."""
        places = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
        index = np.arange(self.n)
        return ((places - index).astype(np.uint64) << np.uint64(self.width)) | unpacked(self.low, self.width, index)
