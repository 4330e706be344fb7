"""Elias-Fano sequences of rising numbers, over plain (memory-mapped) arrays.

A value's low bits are packed; its high bits are a one in a bit vector after as
many zeros.  Where the h-th zero or one stands is found from a count before each
64-bit word and a byte table, for many queries at once.
"""

from __future__ import annotations

import numpy as np

_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
_AT = np.full((256, 8), 8, np.uint8)
for _b in range(256):
    for _i, _p in enumerate(p for p in range(8) if _b >> p & 1):
        _AT[_b, _i] = _p


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Numbers of `width` bits one after another, in 64-bit words, with one word to spare."""
    out, words = [], len(values) * width // 64 + 2
    for a in range(0, len(values), 1 << 16):
        part = values[a : a + (1 << 16)]
        out.append(np.packbits((part[:, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).reshape(-1), bitorder="little"))
    raw = np.concatenate(out) if out and width else np.zeros(0, np.uint8)
    return np.append(raw, np.zeros(words * 8 - len(raw), np.uint8)).view(np.uint64)


def build(values: np.ndarray, top: int) -> list[np.ndarray]:
    """Arrays of a sequence of rising numbers, all at most top: head, low bits, high bits, ones before each word."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    width = max(0, (int(top) // max(1, n)).bit_length() - 1)
    high = (values >> np.uint64(width)).astype(np.int64)
    size = n + (int(top) >> width) + 1
    bits = np.zeros(-(-size // 64) * 64, np.uint8)
    bits[high + np.arange(n)] = 1
    packed = np.packbits(bits, bitorder="little")
    before = np.concatenate([[0], np.cumsum(_ONES[packed].reshape(-1, 8).sum(1, dtype=np.int64))])
    low = _pack(values & np.uint64((1 << width) - 1), width)
    return [np.array([n, width], np.int64), low, packed, before.astype(np.int64)]


class Sequence:
    """Access and search in the arrays that `build` made."""

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.n, self.width = int(head[0]), int(head[1])
        self.low, self.high, self.before = low, high, before
        self.words = high.view(np.uint64)
        self.zeros = None

    def _select(self, rank: np.ndarray, one: bool) -> np.ndarray:
        """Place of the rank-th (from 0) one or zero."""
        if one:
            counts = self.before
        else:
            if self.zeros is None:
                self.zeros = 64 * np.arange(len(self.before), dtype=np.int64) - self.before
            counts = self.zeros
        word = np.searchsorted(counts, rank, "right") - 1
        left = (rank - counts[word]).astype(np.int64)
        bits = self.words[word]
        if not one:
            bits = ~bits
        place = word << 6
        for half in (32, 16, 8):  # which half holds the one that is left-th
            n = np.bitwise_count(bits & np.uint64((1 << half) - 1)).astype(np.int64)
            up = left >= n
            left -= n * up
            place += up * half
            bits = bits >> (up * half).astype(np.uint64)
        return place + _AT[(bits & np.uint64(255)).astype(np.int64), left]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.uint64) * np.uint64(self.width)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        up = np.where(shift > 0, self.low[word + 1] << (np.uint64(63) - shift) << np.uint64(1), np.uint64(0))
        return (self.low[word] >> shift | up) & np.uint64((1 << self.width) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        high = (self._select(i, True) - i).astype(np.uint64)
        return high << np.uint64(self.width) | self._lows(i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, or -1: its bucket by the high bits, then the successor of its low bits."""
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.width)).astype(np.int64)
        low = values & np.uint64((1 << self.width) - 1)
        last = len(self.high) * 8 - self.n - 1
        ok = high <= last
        h = np.where(ok, high, 0)
        start = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) - np.maximum(h - 1, 0), 0)
        end = self._select(h, False) - h
        place = successor(self._lows, start, end, low)
        hit = ok & (place < end)
        out = np.full(len(values), -1, np.int64)
        k = np.flatnonzero(hit)
        k = k[self._lows(place[k]) == low[k]]
        out[k] = place[k]
        return out


def successor(get, start: np.ndarray, end: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """First place in [start, end) whose value is at least the wanted one (else end); values rise within each range."""
    out = start.copy()
    todo = np.flatnonzero(start < end)
    a, b, wanted = start[todo], end[todo], wanted[todo]
    while len(todo):
        middle = (a + b) >> 1
        less = get(middle) < wanted
        a, b = np.where(less, middle + 1, a), np.where(less, b, middle)
        open_ = a < b
        out[todo] = a
        todo, a, b, wanted = todo[open_], a[open_], b[open_], wanted[open_]
    return out


def save(arrays: list[np.ndarray]) -> bytes:
    """Arrays as one file: number and sizes, kinds, then contents at multiples of 8."""
    heads, parts = [], []
    for x in arrays:
        raw = np.ascontiguousarray(x).tobytes()
        heads.append((len(raw), "u1 u2 u4 u8 i8 f4".split().index(x.dtype.str[1:])))
        parts.append(raw + b"\0" * (-len(raw) % 8))
    return np.array([len(arrays), *[v for h in heads for v in h]], np.int64).tobytes() + b"".join(parts)


def load(data: np.ndarray) -> list[np.ndarray]:
    """Views into the bytes of a saved file."""
    count = int(data[:8].view(np.int64)[0])
    heads = data[8 : 8 + 16 * count].view(np.int64).tolist()
    at, out = 8 + 16 * count, []
    for size, kind in zip(heads[::2], heads[1::2]):
        out.append(data[at : at + size].view("u1 u2 u4 u8 i8 f4".split()[kind]))
        at += size + -size % 8
    return out
