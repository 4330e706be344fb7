"""Vectorised text kernels: words, word hashes and shingles over Arrow buffers.

A word is a run of bytes other than space and 9 to 13, with A-Z lower-cased.
Its hash is a 64-bit polynomial over mixed byte values, taken from prefix sums,
so that a block of text costs a few numpy passes instead of a loop over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
MASK = (1 << 64) - 1


def mix_int(x: int) -> int:
    """splitmix64 of a Python integer."""
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, elementwise; returns a new array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_P = mix_int(101) | 1
_PINV = pow(_P, -1, 1 << 64)
_Q = mix_int(202) | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.array([mix_int(1000 + i) for i in range(256)], dtype=np.uint64)
_BYTE_LOWER, _BYTE_PLAIN = _RANDOM[_LOWER], _RANDOM
_WORD = np.ones(256, dtype=bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
BLOCK = 1 << 19


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i up to n, grown when first needed."""
    while len(_tables[0]) <= n:
        k = len(_tables[0])
        for i, base in enumerate((_P, _PINV)):
            _tables[i] = np.concatenate([_tables[i], _tables[i] * U64(pow(base, k, 1 << 64))])
    return _tables[0], _tables[1]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    return buf, off - off[0]


def row_blocks(column, size: int = 1 << 20):
    """Slices of a string column whose rows have about `size` bytes together, one row at least."""
    _, off = utf8(column)
    a, n = 0, len(column)
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        yield column.slice(a, b - a)
        a = b


def pieces(word: np.ndarray, n: int):
    """Cut [0, n) into blocks of about BLOCK bytes, each cut before a separator."""
    a = 0
    while a < n:
        b = min(n, a + BLOCK)
        if b < n:
            back = np.flatnonzero(~word[a + 1 : b])
            if len(back):
                b = a + 1 + int(back[-1])
            else:
                ahead = np.flatnonzero(~word[b:])
                b = b + int(ahead[0]) if len(ahead) else n
        yield a, b
        a = b


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hash of each span [start, end) of buf; spans are sorted and lie within one block."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lo, hi = int(starts[0]), int(ends[-1])
    up, down = _powers(hi - lo)
    x = (_BYTE_LOWER if lower else _BYTE_PLAIN)[buf[lo:hi]]
    x *= up[: hi - lo]
    sums = np.zeros(hi - lo + 1, np.uint64)
    np.cumsum(x, out=sums[1:])
    s = starts - lo
    return mix((sums[ends - lo] - sums[s]) * down[s])


def words(buf: np.ndarray, off: np.ndarray, spans: bool = False):
    """Word hashes in order and words per row; with spans also each word's start and end byte."""
    n, hashes, starts, ends = len(buf), [], [], []
    is_word = _WORD[buf]
    first = off[:-1][off[1:] > off[:-1]]
    for a, b in pieces(is_word, n):
        w = is_word[a:b]
        begin = w.copy()
        begin[1:] &= ~w[:-1]
        last = w.copy()
        last[:-1] &= ~w[1:]
        f = first[np.searchsorted(first, a) : np.searchsorted(first, b)] - a
        begin[f] = w[f]
        f = f[f > 0] - 1
        last[f] = w[f]
        s, e = np.flatnonzero(begin) + a, np.flatnonzero(last) + a + 1
        hashes.append(span_hashes(buf, s, e, lower=True))
        starts.append(s)
        if spans:
            ends.append(e)
    cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    h, s = cat(hashes, np.uint64), cat(starts, np.int64)
    counts = np.diff(np.searchsorted(s, off))
    return (h, counts, s, cat(ends, np.int64)) if spans else (h, counts)


def shingles(h: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles in order and their number per row.

    A row of fewer than k words (at least one) is one shingle; one without words has none.
    """
    total = len(h)
    out_counts = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    at = np.concatenate([[0], np.cumsum(counts)])
    out_at = np.concatenate([[0], np.cumsum(out_counts)])
    out = np.empty(int(out_at[-1]), np.uint64)
    if total >= k:
        acc = h[: total - k + 1].copy()
        for j in range(1, k):
            acc *= U64(_Q)
            acc += h[j : total - k + 1 + j]
        # a shingle starts in the row where its last word lies as well
        ok = np.ones(len(acc), bool)
        for j in range(1, k):
            cut = at[1:-1] - j
            ok[cut[(cut >= 0) & (cut < len(ok))]] = False
        # rows shorter than k lose all their starts to the rows around them
        whole = np.repeat(counts >= k, counts)[: len(acc)]
        long_rows = np.repeat(counts >= k, out_counts)
        out[long_rows] = acc[ok & whole]
    for n in range(1, k):
        rows = np.flatnonzero(counts == n)
        if len(rows):
            acc = h[at[rows]].copy()
            for j in range(1, n):
                acc = acc * U64(_Q) + h[at[rows] + j]
            out[out_at[rows]] = acc + U64(mix_int(n))
    return mix(out), out_counts


def distinct_sorted(v: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row, the sorted distinct values; v is overwritten."""
    at = np.concatenate([[0], np.cumsum(counts)])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a > 1:
            v[a:b].sort()
    keep = np.ones(len(v), bool)
    if len(v) > 1:
        keep[1:] = v[1:] != v[:-1]
        keep[at[:-1][counts > 0]] = True
    rows = np.repeat(np.arange(len(counts)), counts)
    return v[keep], np.bincount(rows[keep], minlength=len(counts)).astype(np.int64)
