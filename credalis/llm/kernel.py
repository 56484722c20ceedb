"""Array kernels shared by the text operators: words, spans and 64-bit hashes over UTF-8 bytes.

A text column arrives as an Arrow string array. Its bytes and offsets are used in place and cut into
slices of about ``SLICE`` bytes, so the working arrays of one slice stay small whatever the batch holds;
a text longer than that makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19

_rng = np.random.default_rng(20240229)
_R = np.uint64(0x9E3779B97F4A7C15 | 5)
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Word bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.
ALNUM = np.array([b >= 128 or 48 <= b <= 57 or 97 <= (b + 32 if 65 <= b <= 90 else b) <= 122 for b in range(256)])
#: Word bytes of ``[^\\x20\\x09-\\x0D]+``.
NON_SPACE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)

_powers = {"r": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        base = np.full(max(n, SLICE + 65536), _R if kind == "r" else _RINV, np.uint64)
        base[0] = 1
        have = _powers[kind] = np.cumprod(base, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each, never splitting a row."""
    size = size or SLICE
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, n, i + 20_000)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the total) of the words; a word never crosses rows."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = is_word[data]
    begin = inside[:n].copy()
    begin[1:] &= ~inside[: n - 1]
    cuts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[cuts] = inside[cuts]
    starts = np.flatnonzero(begin)
    stop = inside[:n] & ~inside[1:]
    stop[cuts[1:] - 1] = inside[cuts[1:] - 1]
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def running(data: np.ndarray, lower: bool = True) -> np.ndarray:
    """Running sums from which the hash of any span follows; A-Z are lower-cased first."""
    code = BYTE_CODE[LOWER] if lower else BYTE_CODE
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(code[data] * _power("r", len(data)), out=total[1:])
    return total


def span_hashes(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of the bytes that ``running`` read."""
    return mix((total[ends] - total[starts]) * _power("i", len(total))[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    return span_hashes(running(data, lower), starts, ends)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive words (of all rows; the caller leaves out runs across rows)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, k, np.uint64)
    for j in range(k):
        total += words[j : j + n] * STEP[j]
    return mix(total)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row, the sorted distinct hashes of its k-word shingles: the whole sequence if it has fewer words, nothing without words."""
    starts, ends, first = word_spans(data, offsets, NON_SPACE)
    words = word_hashes(data, starts, ends)
    grams = gram_hashes(words, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            g = np.sort(grams[a : b - k + 1])
            out.append(g[np.concatenate(([True], g[1:] != g[:-1]))])
        elif b > a:
            out.append(gram_hashes(words[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
