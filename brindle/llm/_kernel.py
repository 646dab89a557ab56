"""Whole Arrow batches of texts as numpy arrays: words, their 64-bit hashes, and shingle sets.

A batch is handled in chunks of a few hundred kilobytes, so memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n + n // 4 + 16, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads each bit over all 64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls become empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last document (exclusive), bytes and offsets of pieces of at most `size` bytes, or of one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """Words of a chunk: byte starts and ends, the document of each, and where each document's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = ~_SPACE[data]
        first = inside[1:-1] & ~inside[:-2]
        last = inside[1:-1] & ~inside[2:]
        border = offsets[1:-1]
        border = border[(border > 0) & (border < len(data))]
        first[border] = inside[1:-1][border]
        last[border - 1] = inside[1:-1][border - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * power[:-1], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * inverse[starts]
    return mix64(raw + (ends - starts).astype(np.uint64))


_STEP = np.array([0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 4) -> Iterator[np.ndarray]:
    """For each document of a chunk, the sorted distinct hashes of its `width`-word shingles.

    ASCII letters are lower-cased. A document with fewer words has its whole sequence as its only
    shingle; one without words has none.
    """
    words = Words(data, offsets, lower=True)
    h = words.hashes()
    n = len(h)
    rolled = np.zeros(max(0, n - width + 1), dtype=np.uint64)
    for k in range(width):
        rolled += (h[k : n - width + 1 + k] ^ _STEP[k % 4]) * _STEP[(k + 1) % 4]
        rolled ^= rolled >> np.uint64(29)
    rolled = mix64(rolled)
    for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        if b - a >= width:
            s = np.sort(rolled[a : b - width + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            x = np.uint64(b - a)
            for w in h[a:b]:
                x = mix64((np.atleast_1d(x) * _STEP[0]) ^ w)[0]
            yield np.array([x], dtype=np.uint64)
        else:
            yield np.zeros(0, np.uint64)
