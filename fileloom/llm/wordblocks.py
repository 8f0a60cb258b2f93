"""Vectorised word kernel: words, lines and their hashes for a whole block of texts at once.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. As those are ASCII, cutting UTF-8 by bytes equals
cutting by code points. A span's 64-bit hash is a polynomial over a pseudo-random value per byte, taken from
prefix sums, then mixed; equal spans have equal hashes in every task and run.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUES = mix((np.arange(256, dtype=np.uint64) + U(1)) * U(BASE))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = np.full(n, BASE, dtype=np.uint64), np.full(n, INVERSE, dtype=np.uint64)
    base[0] = inverse[0] = 1
    return np.cumprod(base), np.cumprod(inverse)


@dataclass
class Block:
    """Texts end to end: ``data`` bytes; text i is data[offsets[i]:offsets[i+1]] (empty where null)."""

    data: np.ndarray
    offsets: np.ndarray
    valid: np.ndarray

    def __len__(self) -> int:
        return len(self.valid)

    @classmethod
    def of(cls, column: pa.Array) -> "Block":
        n = len(column)
        valid = np.ones(n, dtype=bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
        buffers = column.buffers()
        offsets = np.frombuffer(buffers[1], dtype=np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
        lo, hi = int(offsets[0]), int(offsets[-1])
        data = np.frombuffer(buffers[2], dtype=np.uint8)[lo:hi] if buffers[2] is not None else np.zeros(0, np.uint8)
        return cls(data, offsets - lo, valid)

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of bytes where ``inside``, none crossing a text: starts, ends, first run of each text."""
        n = len(self.data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self.offsets), np.int64)
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.offsets] = True
        before = np.empty(n, dtype=bool)
        before[0], before[1:] = False, inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:n]))
        after = np.empty(n, dtype=bool)
        after[-1], after[:-1] = False, inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.runs(~SPACE[self.data])

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        total = np.zeros(len(per_byte) + 1, dtype=np.int64)
        np.cumsum(per_byte, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """Hash of each span; with ``lower``, A-Z count as a-z."""
        n = len(self.data)
        if not len(starts):
            return np.zeros(0, dtype=np.uint64)
        base, inverse = _powers(1 << max(10, int(n - 1).bit_length()))
        total = np.zeros(n + 1, dtype=np.uint64)
        values = BYTE_VALUES[LOWER] if lower else BYTE_VALUES
        np.cumsum(values[self.data] * base[:n], out=total[1:])
        return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k-word windows that lie in one text: hash, index of the first word, first window of each text."""
    counts = np.diff(first)
    n = np.maximum(counts - k + 1, 0)
    begin = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(first[:-1] - begin[:-1], n) + np.arange(begin[-1])
    out = np.zeros(len(at), dtype=np.uint64)
    for j in range(k):
        out = out * U(BASE) + hashes[at + j]
    return mix(out + U(k)), at, begin


def spread(counts: np.ndarray) -> np.ndarray:
    """The row's number, repeated ``counts`` times."""
    return np.repeat(np.arange(len(counts)), counts)


def order_by(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Indexes that sort by ``owner``, then by ``value`` (64 bits, unsigned); equal pairs stand in any order.

    One sort of numbers that hold the owner and the value's first 44 bits, which is several times as fast as a sort by two keys; where values
    that differ only further on come out in the wrong order, that sort is made after all.
    """
    if len(owner) and int(owner.max()) >> 20 == 0:
        code = owner.astype(np.uint64) << U(44) | value >> U(20)
        order = np.argsort(code)
        c, v = code[order], value[order]
        if not ((c[1:] == c[:-1]) & (v[1:] < v[:-1])).any():
            return order
    return np.lexsort((value, owner))
