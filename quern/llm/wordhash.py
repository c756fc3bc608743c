"""Vectorised words and word-window hashes over Arrow string columns.

Words are the runs of ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes. Hashes are
64-bit polynomial prefix hashes, mixed, so every window of a text costs the same
few array operations whatever its length. Equal word sequences always have equal
hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MASK = (1 << 64) - 1
_BYTE_K = 0x9E3779B97F4A7C15
_WORD_K = 0xC2B2AE3D27D4EB4F
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of k and of its inverse modulo 2**64, at least n of each."""
    have = _powers.get(k)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (k, pow(k, -1, 1 << 64)):
            p = np.empty(size, np.uint64)
            p[0] = 1
            done = 1
            while done < size:
                step = min(done, size - done)
                p[done : done + step] = p[:step] * np.uint64(pow(base, done, 1 << 64))
                done += step
            out.append(p)
        _powers[k] = have = (out[0], out[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """Hashes of values[s:e] for each pair, by prefix sums modulo 2**64."""
    power, inverse = _tables(k, len(values) + 1)
    prefix = np.empty(len(values) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(values * power[: len(values)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def byte_chunks(texts: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of rows with at most ``limit`` bytes, one row at least; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Words:
    """The words of one run of rows: byte starts and ends, and each row's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(data), bool)
        after = np.empty(len(data), bool)
        if len(data):
            before[0] = after[-1] = True
            before[1:] = ~solid[:-1]
            after[:-1] = ~solid[1:]
        self.starts = np.flatnonzero(solid & (before | edge[:-1]))
        self.ends = np.flatnonzero(solid & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data.astype(np.uint64) + np.uint64(1), self.starts, self.ends, _BYTE_K)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, row, hash) of every window of ``size`` words inside one row."""
        n = len(hashes)
        row = np.repeat(np.arange(len(self.first) - 1), self.counts())
        if n < size:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, np.uint64)
        at = np.arange(n - size + 1)
        at = at[row[: n - size + 1] == row[size - 1 :]]
        return at, row[at], span_hashes(hashes, at, at + size, _WORD_K)
