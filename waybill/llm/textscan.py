"""Vectorised word scanning of Arrow text columns.

A word is a maximal run of bytes other than space and U+0009..U+000D, so word
borders can be found on the UTF-8 bytes without decoding.  Everything works on
whole texts; a batch is cut between documents so that the scratch arrays stay
near ``CHUNK_BYTES`` (one longer document is handled alone).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.ones(n + 1, dtype=np.uint64), np.ones(n + 1, dtype=np.uint64)
    np.multiply.accumulate(np.full(n, _BASE, dtype=np.uint64), out=up[1:])
    np.multiply.accumulate(np.full(n, inverse, dtype=np.uint64), out=down[1:])
    return up, down


def _powers_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = CHUNK_BYTES + (CHUNK_BYTES >> 2)
    while size < n:
        size *= 2
    return _powers(size)


class Scan:
    """Words of a run of documents.

    ``first[i]:first[i + 1]`` are the words of document ``i``; ``start`` and
    ``end`` are byte positions in ``data``; ``origin[i]`` is where document
    ``i`` begins in ``data``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool):
        self.data = _FOLD[data] if fold else data
        self.origin = offsets.astype(np.int64)
        n = len(data)
        self.n_docs = len(offsets) - 1
        ink = ~_SPACE[data]
        left = np.empty(n + 1, dtype=bool)
        left[0] = left[n] = False
        left[1:n] = ink[: n - 1]
        inner = self.origin[:-1][self.origin[:-1] < n]
        left[inner] = False
        right = np.empty(n, dtype=bool)
        if n:
            right[: n - 1] = ink[1:]
            right[n - 1] = False
            tails = self.origin[1:] - 1
            right[tails[(tails >= 0) & (tails < n)]] = False
        self.start = np.flatnonzero(ink & ~left[:n])
        self.end = np.flatnonzero(ink & ~right) + 1
        self.first = np.searchsorted(self.start, self.origin)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.first))

    def word_hashes(self) -> np.ndarray:
        """A 64-bit hash for each word, the same in every document and chunk."""
        n = len(self.data)
        up, down = _powers_for(n)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[self.data] * up[:n], out=total[1:])
        value = (total[self.end] - total[self.start]) * down[self.start]
        return mix64(value + (self.end - self.start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def scans(column: pa.Array | pa.ChunkedArray, fold: bool, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, Scan]]:
    """Scans of runs of rows with the number of the first row; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if n == 0:
        return
    _, off, buf = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + chunk_bytes, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, Scan(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], fold)
        at = to


def shingle_hashes(scan: Scan, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document.

    Returns ``values`` and ``first`` such that ``values[first[i]:first[i+1]]``
    are the sorted distinct 64-bit hashes of document ``i``: one for each run of
    ``width`` words, or one for its whole sequence if it has fewer.
    """
    words, first = scan.word_hashes(), scan.first
    count = np.diff(first)
    step = [mix64(np.array([j + 1], dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))[0] | np.uint64(1) for j in range(width)]
    n = len(words)
    docs = np.arange(scan.n_docs)
    if n >= width:
        value = np.zeros(n - width + 1, dtype=np.uint64)
        for j in range(width):
            value += words[j : n - width + 1 + j] * step[j]
        owner = np.repeat(docs, count)
        whole = owner[: n - width + 1] == owner[width - 1 :]
        value, owner = mix64(value[whole]), owner[: n - width + 1][whole]
    else:
        value, owner = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        for j in range(width - 1):
            has = count[short] > j
            extra[has] += words[first[short[has]] + j] * step[j]
        extra = mix64(extra ^ (count[short].astype(np.uint64) << np.uint64(56)))
        value, owner = np.concatenate([value, extra]), np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    if len(value):
        fresh = np.ones(len(value), dtype=bool)
        fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[fresh], owner[fresh]
    return value, np.searchsorted(owner, np.arange(scan.n_docs + 1))
