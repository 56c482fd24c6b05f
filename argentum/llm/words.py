"""Texts of an Arrow column as numpy arrays of bytes and words; nothing here runs once per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes that end a word ([\x20\x09-\x0D]).
SPACES = (9, 10, 11, 12, 13, 32)

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: The first n bytes of a little-endian block.
_TAIL = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers = np.array([1], np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base modulo 2**64."""
    global _powers
    while len(_powers) < n:
        top = np.uint64(int(_powers[-1]) * _BASE & _MASK)
        _powers = np.concatenate([_powers, _powers * top])
    return _powers[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n+1 offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count or not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets and len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    first, last = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
    return data[first:last], offsets - first


class Words:
    """Words of a batch: `start`, `end` (bytes), `of` (n+1 offsets of documents into words)."""

    def __init__(self, column: pa.Array, lower: bool = False):
        data, self.bounds = buffers(column)
        self.data = _LOWER[data] if lower else data
        n = len(data)
        self.count = len(self.bounds) - 1
        if not n:
            self.start = self.end = np.zeros(0, np.int64)
        else:
            word = ~_SPACE[data]
            first = word.copy()
            first[1:] &= ~word[:-1]
            edges = self.bounds[:-1]
            edges = edges[edges < n]
            first[edges] = word[edges]
            last = word.copy()
            last[:-1] &= ~word[1:]
            edges = self.bounds[1:] - 1
            edges = edges[edges >= 0]
            last[edges] = word[edges]
            self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.of = np.searchsorted(self.start, self.bounds)

    def __len__(self) -> int:
        return len(self.start)

    def blocks(self) -> np.ndarray:
        """The eight bytes from each place on, zeros behind the last."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        return np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes and length: its blocks of eight bytes are mixed one by one, then their sum."""
        size = self.end - self.start
        out, blocks = np.empty(len(size), np.uint64), self.blocks()
        step = 1 << 17  # words at a time, so that temporary arrays stay small
        for a in range(0, len(out), step):
            s, k = self.start[a : a + step], size[a : a + step]
            n = (k + 7) >> 3
            first = np.cumsum(n) - n
            j = np.arange(int(n.sum())) - np.repeat(first, n)
            value = blocks[np.repeat(s, n) + 8 * j] & _TAIL[np.minimum(np.repeat(k, n) - 8 * j, 8)]
            out[a : a + step] = np.add.reduceat(mix(value ^ mix(j.astype(np.uint64) + np.uint64(_BASE))), first)
        return mix(out ^ (size.astype(np.uint64) << np.uint64(56)))

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a and b have the same bytes, pair by pair."""
        size, blocks = self.end[a] - self.start[a], self.blocks()
        out = size == self.end[b] - self.start[b]
        live, at = np.flatnonzero(out), 0
        while len(live):
            x, y, k = self.start[a[live]] + at, self.start[b[live]] + at, size[live] - at
            ok = (blocks[x] ^ blocks[y]) & _TAIL[np.minimum(k, 8)] == 0
            out[live[~ok]] = False
            live, at = live[ok & (k > 8)], at + 8
        return out

    def numbers(self) -> tuple[np.ndarray, np.ndarray]:
        """(first, number): the different words by one place of each, and which one each word is. Bytes decide, hashes only group.

        Words of one block have equal hashes and sizes only if they are equal, as mixing is one to one; longer ones are compared.
        """
        h = self.hashes()
        order = np.argsort(h)
        h = h[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        first, number = order[new], np.empty(len(h), np.int64)
        number[order] = np.cumsum(new) - 1
        size, other = self.end - self.start, first[number]
        differ = size != size[other]
        long = np.flatnonzero((size > 8) & ~differ & (other != np.arange(len(h))))
        differ[long] = ~self.same(long, other[long])
        odd = np.flatnonzero(differ)
        if len(odd):  # words that share another one's hash
            found: dict[bytes, int] = {}
            number[odd] = [found.setdefault(self.text(i, i + 1), len(first) + len(found)) for i in odd.tolist()]
            first = np.concatenate([first, odd[np.unique(number[odd], return_index=True)[1]]])
        return first, number

    def doc(self) -> np.ndarray:
        """The row in the batch of each word."""
        return np.repeat(np.arange(self.count), np.diff(self.of))

    def text(self, a: int, b: int) -> bytes:
        return self.data[self.start[a] : self.end[b - 1]].tobytes() if b > a else b""


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive values; the result is k-1 shorter."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n, out = len(h) - k + 1, np.zeros(len(h) - k + 1, np.uint64)
    power = powers(k)
    for j in range(k):
        out += h[j : j + n] * power[j]
    return mix(out)


def inside(of: np.ndarray, k: int, total: int) -> np.ndarray:
    """Which of the total-k+1 windows of k values lie in one document; `of`: offsets of documents."""
    n = total - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    out = np.ones(n + k, bool)
    for edge in np.unique(of[1:-1]):
        out[max(0, edge - k + 1) : edge] = False
    return out[:n]
