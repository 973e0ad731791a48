"""Elias-Fano sequences and a trie of n-grams over them, queried where they lie."""

from __future__ import annotations

import struct
import tempfile

import numpy as np

#: Bits of an n-gram key that stand for its last two words, and for the word before them.
PAIR_BITS, BEFORE_BITS = 42, 22
CODES = 65_535
#: Values worked on at once: as many as stay in a processor's cache, whatever the length of a sequence. They fill whole bytes, whatever the bits.
PIECE = 1 << 16
#: The place of the r-th set bit of each byte.
PLACE = np.array([[([k for k in range(8) if b >> k & 1] + [8] * 8)[r] for r in range(8)] for b in range(256)], np.uint8)


def _pieces(n: int):
    """Slices of PIECE of n values."""
    return (slice(at, min(n, at + PIECE)) for at in range(0, n, PIECE))


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of the values, one after the other."""
    if not bits or not len(values):
        return np.zeros(8, np.uint8)
    parts, size = [], -(-bits // 8)
    for x in _pieces(len(values)):
        part = values[x].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]
        parts.append(np.packbits(np.unpackbits(np.ascontiguousarray(part), axis=1, bitorder="little")[:, :bits], bitorder="little"))
    return np.concatenate([*parts, np.zeros(8, np.uint8)])  # so that 8 bytes can be read anywhere


def encode(values: np.ndarray, universe: int) -> bytes:
    """The bytes of a sequence of values that never fall, all below universe: low bits packed, high parts in unary, and the ones before each 64-bit word of these."""
    values = values.astype(np.uint64, copy=False)
    n = len(values)
    low = max(0, (universe // max(1, n)).bit_length() - 1)
    lows = _pack(values, low)
    lows = np.concatenate([lows, np.zeros(-len(lows) % 8, np.uint8)])
    size = n + (universe >> low) + 2
    high = np.zeros(-(-size // 64) * 64 + 64, np.uint8)
    for x in _pieces(n):
        high[(values[x] >> np.uint64(low)).astype(np.int64) + np.arange(x.start, x.stop)] = 1
    highs = np.packbits(high, bitorder="little")
    directory = np.concatenate([[0], np.cumsum(np.bitwise_count(highs.view("<u8")), dtype=np.int64)]).astype("<i8")
    return struct.pack("<qqqqq", n, low, len(lows), len(highs), len(directory) * 8) + lows.tobytes() + highs.tobytes() + directory.tobytes()


class Sequence:
    """Random access and successor search in an encoded sequence at an offset of a byte array, which may be a memory map; nothing is decoded but what is asked."""

    HEAD = 40

    def __init__(self, data: np.ndarray, at: int = 0):
        self.n, self.low, lows, highs, directory = struct.unpack("<qqqqq", data[at : at + self.HEAD].tobytes())
        at += self.HEAD
        self.lows = data[at : at + lows]
        self.unary = data[at + lows : at + lows + highs]
        self.words = self.unary.view("<u8")
        self.ones = data[at + lows + highs : at + lows + highs + directory].view("<i8")
        self.zeros = np.arange(len(self.ones)) * 64 - self.ones
        self.end = at + lows + highs + directory

    def _place(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """The place in the unary part of the k-th (from 0) one or zero: its word by the directory, then its byte by halving."""
        before = self.ones if ones else self.zeros
        at = np.searchsorted(before, k, "right") - 1
        rest, x, place = k - before[at], self.words[at], at << 6
        if not ones:
            x = ~x
        for width in (32, 16, 8):
            low = x & np.uint64((1 << width) - 1)
            n = np.bitwise_count(low)
            above = rest >= n
            rest = rest - n * above
            x = np.where(above, x >> np.uint64(width), low)
            place += above * width
        return place + PLACE[x.astype(np.int64), rest]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.int64)
        bit = i * self.low
        eight = np.ascontiguousarray(self.lows[(bit >> 3)[:, None] + np.arange(8)]).view("<u8").ravel()
        return ((eight >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low) - 1)).astype(np.int64)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return (self._place(i, True) - i) << self.low | self._low(i)

    def bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[first, stop) of the values whose high part is the one asked: the ones between two zeros."""
        place = np.where(high > 0, self._place(np.maximum(high - 1, 0), False) + 1, 0)
        eight = np.ascontiguousarray(self.unary[(place >> 3)[:, None] + np.arange(8)]).view("<u8").ravel() >> (place & 7).astype(np.uint64)
        zeros = ~eight
        n = np.bitwise_count((zeros & (~zeros + np.uint64(1))) - np.uint64(1)).astype(np.int64)  # ones up to the first zero
        first = place - high
        stop = first + n
        if len(long := np.flatnonzero(n > 56)):  # beyond what was read
            stop[long] = self._place(high[long], False) - high[long]
        return first, stop

    def find(self, first: np.ndarray | int, stop: np.ndarray | int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, whether it holds the value) of the successor of each value in [first, stop): the least index there whose value is at least the one asked, or stop.

        Only the bucket of the value's high part inside [first, stop) is searched, by halving, in the packed low bits.
        """
        a, b = self.bucket(values >> self.low)
        a, b = np.minimum(np.maximum(a, first), stop), np.maximum(np.minimum(b, stop), first)
        end, sought = b.copy(), values & ((1 << self.low) - 1)
        while len(rows := np.flatnonzero(a < b)):
            middle = (a[rows] + b[rows]) >> 1
            less = self._low(middle) < sought[rows]
            a[rows[less]] = middle[less] + 1
            b[rows[~less]] = middle[~less]
        found = np.flatnonzero(a < end)
        held = np.zeros(len(values), bool)
        held[found] = self._low(a[found]) == sought[found]
        return a, held


def _codebook(weights: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Weights as 16-bit codes on an even scale between their least and greatest."""
    least, most = (float(weights.min()), float(weights.max())) if len(weights) else (0.0, 0.0)
    step = (most - least) / CODES or 1.0
    codes = np.empty(len(weights), "<u2")
    for x in _pieces(len(weights)):
        codes[x] = np.rint((weights[x] - least) / step)
    return struct.pack("<dd", least, step), codes


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of values that never fall, and the number of each one's."""
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    number = np.cumsum(new)
    number -= 1
    return values[new], number


class Trie:
    """Two levels over n-gram keys: the last two words, and under each the words before them, relative to their parent.

    A node of the lower level has the value parent << BEFORE_BITS | word; monotone pointers give each parent's children.
    Weights of both levels are quantised to 16 bits.
    """

    @staticmethod
    def build(keys: np.ndarray, second: np.ndarray, third: np.ndarray) -> bytes:
        """keys: rising (pair << BEFORE_BITS | word before), unsigned; second: a weight for each distinct pair; third: one for each key."""
        pair, parent = _distinct(keys >> np.uint64(BEFORE_BITS))
        start = np.searchsorted(parent, np.arange(len(pair)))
        below = parent.view(np.uint64)
        below <<= np.uint64(BEFORE_BITS)
        for x in _pieces(len(keys)):
            below[x] |= keys[x] & np.uint64((1 << BEFORE_BITS) - 1)
        parts = [encode(pair, 1 << PAIR_BITS), encode(np.append(start, len(keys)), len(keys) + 1), encode(below, max(1, len(pair)) << BEFORE_BITS)]
        for weights in (second, third):
            scale, codes = _codebook(weights)
            parts.append(scale + codes.tobytes() + bytes(-len(codes) * 2 % 8))
        return b"".join(parts)

    def __init__(self, data: bytes):
        self.file = tempfile.TemporaryFile()  # without a name, so it goes with the task
        self.file.write(data)
        self.file.flush()
        mapped = np.memmap(self.file, np.uint8, "r")
        self.pairs = Sequence(mapped)
        self.pointers = Sequence(mapped, self.pairs.end)
        self.below = Sequence(mapped, self.pointers.end)
        at, self.scales, self.codes = self.below.end, [], []
        for n in (self.pairs.n, self.below.n):
            self.scales.append(struct.unpack("<dd", mapped[at : at + 16].tobytes()))
            self.codes.append(mapped[at + 16 : at + 16 + 2 * n].view("<u2"))
            at += 16 + -(-2 * n // 8) * 8

    def weights(self, keys: np.ndarray) -> np.ndarray:
        """For each key (rising, unsigned) the weight of its pair plus its own, zero for what the trie lacks."""
        out = np.zeros(len(keys))
        for x in _pieces(len(keys) if self.pairs.n else 0):
            out[x] = self._weights(keys[x])
        return out

    def _weights(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        pair, spread = _distinct(keys >> np.uint64(BEFORE_BITS))
        node, held = self.pairs.find(0, self.pairs.n, pair.astype(np.int64))
        out += np.where(held, self._weight(0, np.where(held, node, 0)), 0.0)[spread]
        rows = np.flatnonzero(held[spread])
        own = node[spread[rows]]
        parents, spread = _distinct(own)
        start, stop = self.pointers[parents][spread], self.pointers[parents + 1][spread]
        before = (keys[rows] & np.uint64((1 << BEFORE_BITS) - 1)).astype(np.int64)
        node, held = self.below.find(start, stop, own << BEFORE_BITS | before)
        out[rows[held]] += self._weight(1, node[held])
        return out

    def _weight(self, level: int, node: np.ndarray) -> np.ndarray:
        least, step = self.scales[level]
        return least + step * self.codes[level][node]
