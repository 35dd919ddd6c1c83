"""Whole Arrow batches of texts as byte arrays: word spans and 64-bit hashes without Python strings.

A batch is worked through in slices of whole texts of about half a megabyte, which bounds the memory of the
helper arrays; a longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: The bytes that separate words: space and \x09-\x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Everything that is neither a letter, a digit nor part of a multi-byte character.
NON_LETTERS = np.ones(256, bool)
NON_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, one to one."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _inverse(a: int) -> int:
    x = a
    for _ in range(6):
        x = x * (2 - a * x) % 2**64
    return x


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n + 1 of each."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n + 1, 2 * SLICE_BYTES)
        _POWERS.clear()
        for base in (_BASE, _inverse(_BASE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


class Hasher:
    """Hashes of any substring of a byte array from one running sum."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        powers, self._inverse = _powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        values = _BYTE[_LOWER[data] if lower else data]
        values *= powers[: len(data)]
        np.cumsum(values, out=self.sums[1:])

    def between(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self._inverse[starts] + (ends - starts).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        """The hash of every substring of the given width."""
        n = len(self.sums) - width
        if n <= 0:
            return np.empty(0, np.uint64)
        return mix((self.sums[width:] - self.sums[:-width]) * self._inverse[:n] + _U(width))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    if len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of at most ``limit`` bytes, or of one longer text."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        last = min(last, n)
        yield first, last
        first = last


def parts(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of at most ``limit`` bytes of a text column, or of one longer text."""
    _, at = buffers(batch.column(column))
    for first, last in slices(at, limit):
        yield batch.slice(first, last - first)


def word_spans(data: np.ndarray, at: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of the texts that ``at`` cuts ``data`` into, and how many each text has."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~separators[data]
    edge = at[(at > 0) & (at < n)]
    opens = inside[1:-1] & ~inside[:-2]
    opens[edge] = inside[edge + 1]
    closes = inside[1:-1] & ~inside[2:]
    closes[edge - 1] = inside[edge]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.diff(np.searchsorted(starts, at))


def runs(counts: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each of consecutive groups of the given sizes."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
