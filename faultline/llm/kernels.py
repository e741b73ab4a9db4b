"""Vectorised text kernels over Arrow string arrays: no per-character Python.

Words are runs of bytes other than ASCII white space (0x20, 0x09-0x0D); only A-Z is lower-cased.  A word's identity is
a 64-bit hash, sum of R[b_i] * P^i modulo 2^64 with random R, then mixed: for 10^7 distinct words, the chance that any
two collide is below 10^-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(P, -1, 1 << 64)
_R = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POW: dict[str, np.ndarray] = {}
#: Bytes of text handled at once; longer texts are cut at white space into pieces that are handled one after another.
BLOCK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: all bits of the result depend on all bits of ``h``."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) < n:
        m = max(n, 1 << 16)
        _POW["p"] = np.concatenate(([U(1)], np.cumprod(np.full(m - 1, P, dtype=np.uint64), dtype=np.uint64)))
        _POW["i"] = np.concatenate(([U(1)], np.cumprod(np.full(m - 1, _P_INV, dtype=np.uint64), dtype=np.uint64)))
    return _POW["p"][:n], _POW["i"]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of length n + 1) of a string array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = column.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def blocks(data: np.ndarray, off: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """(first row, rows, bytes, offsets, whether the last row ends) of pieces of about ``size`` bytes: whole rows, or
    white-space-ended parts of one row that is longer (the piece then has one row; its pieces follow each other)."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        s, e = int(off[i]), int(off[j])
        if e - s <= 2 * size:
            yield i, j - i, data[s:e], off[i : j + 1] - s, True
        else:
            while s < e or s == off[i]:
                t = min(e, s + size)
                while t < e and not _SPACE[data[t]]:
                    t += 1
                yield i, 1, data[s:t], np.array([0, t - s], np.int64), t >= e
                s = t
                if s >= e:
                    break
        i = j


class Words:
    """Words of a piece: ``start``, ``end`` (byte positions), ``row`` (number within the piece), ``hash``; ``low``: the
    lower-cased bytes; ``first``: index of each row's first word (length rows + 1)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, boundary: np.ndarray | None = None):
        n = len(data)
        self.low = _LOWER[data]
        inside = np.empty(n + 2, bool)
        inside[0] = inside[-1] = False
        np.logical_not((_SPACE if boundary is None else boundary)[data], out=inside[1:-1])
        a, b = inside[1:-1], inside[:-2]
        start = a & ~b
        cut = off[1:-1]
        cut = cut[cut < n]
        start[cut] = a[cut]  # a row's first byte begins a word even if the row before it ends with one
        end = a & ~inside[2:]
        last = off[1:-1] - 1
        last = last[last >= 0]
        end[last] = a[last]
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.row = np.searchsorted(off, self.start, "right") - 1
        self.first = np.searchsorted(self.start, off, "left")
        self._sum: np.ndarray | None = None

    def prefix_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each [start, end): equal strings have equal hashes wherever they stand."""
        n = len(self.low)
        if self._sum is None:
            p, _ = _powers(n + 1)
            self._sum = np.zeros(n + 1, np.uint64)
            np.cumsum(_R[self.low] * p[:n], out=self._sum[1:], dtype=np.uint64)
        _, inv = _powers(n + 1)
        return mix((self._sum[end] - self._sum[start]) * inv[start] + (end - start).astype(np.uint64))

    @property
    def hash(self) -> np.ndarray:
        return self.prefix_hash(self.start, self.end)


def counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and how often each occurs."""
    if len(h) == 0:
        return h, np.zeros(0, np.int64)
    h = np.sort(h)
    at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[at], np.diff(np.append(at, len(h)))


class Index:
    """Lookup of 64-bit hashes in a fixed sorted table: position, or -1.  A table of leading bits narrows the search."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys.astype(np.uint64))
        bits = max(8, int(np.ceil(np.log2(max(1, len(keys))))) + 3)
        self.shift = U(64 - bits)
        slot = (self.keys >> self.shift).astype(np.int64)
        self.at = np.searchsorted(slot, np.arange((1 << bits) + 1)).astype(np.int32)
        self.most = int(np.max(np.diff(self.at))) if len(keys) else 0
        self.padded = np.concatenate((self.keys, np.zeros(self.most + 1, np.uint64)))

    def __getstate__(self) -> np.ndarray:
        return self.keys  # the rest is made again: it is larger than the keys

    def __setstate__(self, keys: np.ndarray) -> None:
        self.__init__(keys)

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        if not len(self.keys):
            return out
        slot = (h >> self.shift).astype(np.int64)
        at, end = self.at[slot].astype(np.int64), self.at[slot + 1].astype(np.int64)
        for _ in range(self.most):
            hit = (at < end) & (self.padded[at] == h)
            out[hit] = at[hit]
            at += 1
        return out
