"""Hashes of words, word shingles and byte windows over Arrow batches, by array arithmetic on the bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
BYTE_CODES = _RNG.integers(0, 2**64, 256, np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
#: White space beyond ASCII, as a pattern.
WIDE_SPACE = "[\u0085   -     　]"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_POWERS: dict[bool, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**i (or its inverse) for i < n, modulo 2**64; kept between calls."""
    have = _POWERS.get(inverse)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), BASE_INVERSE if inverse else BASE, np.uint64)
        step[0] = 1
        have = _POWERS[inverse] = np.cumprod(step, dtype=np.uint64)
    return have[:n]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20):
    """Parts of a batch with about `most` bytes in a column (a larger value is a part of its own)."""
    size = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts back to back, and n + 1 offsets; null is empty."""
    column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def prefix(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of code(byte k) * BASE**k over i <= k < j; times BASE**-i a hash of the bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * powers(len(data)), dtype=np.uint64, out=out[1:])
    return out


def spans(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, from the prefix sums; equal spans anywhere have equal hashes."""
    inverse = powers(len(h), True)
    return mix64((h[end] - h[start]) * inverse[start] + (end - start).astype(np.uint64))


def all_spans(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all spans of one size, for comparison with each other only."""
    x = (h[size:] - h[:-size]) * powers(len(h) - size, True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased white-space separated words of all texts, and n + 1 offsets into them; long columns in parts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.nbytes > 3 << 20 and len(column) > 1:
        parts = [words(b.column(0)) for b in slices(pa.record_batch([column], ["text"]), most=2 << 20)]
        counts = np.concatenate([np.diff(at) for _, at in parts])
        return np.concatenate([w for w, _ in parts]), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    column = pc.utf8_lower(pc.fill_null(column, ""))
    if pc.any(pc.match_substring_regex(column, WIDE_SPACE)).as_py():
        column = pc.replace_substring_regex(column, WIDE_SPACE, " ")
    data, offsets = utf8(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]  # a text's end ends a word
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return spans(prefix(data), start, end), np.searchsorted(start, offsets).astype(np.int64)


def shingles(column: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text, and n + 1 offsets.

    A text of 1 to k - 1 words has one shingle, of all its words; a text without words has none.
    """
    w, at = words(column)
    n = len(at) - 1
    count = np.diff(at)
    have = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(have, out=offsets[1:])
    total = int(offsets[-1])
    if not total:
        return np.zeros(0, np.uint64), offsets
    doc = np.repeat(np.arange(n), have)
    start = at[:-1][doc] + np.arange(total) - offsets[:-1][doc]
    size = np.minimum(count, k)[doc]
    padded = np.concatenate([w, np.zeros(k, np.uint64)])
    value = size.astype(np.uint64)
    for j in range(k):
        value = np.where(j < size, value * BASE + padded[start + j], value)
    value = mix64(value)
    order = np.lexsort((value, doc))
    value = value[order]
    new = np.ones(total, bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    offsets = np.searchsorted(doc[new], np.arange(n + 1)).astype(np.int64)
    return value[new], offsets
