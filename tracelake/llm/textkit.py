"""Vectorised tokenising and hashing of Arrow string columns (numpy over the raw UTF-8 buffers).

Tokens are hashes of 50 bits. With 10^10 distinct tokens two given sets of 1,000 tokens collide with odds below 10^-9, so set sizes and intersections
are exact in practice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKEN_BITS = 50
TOKEN_MASK = np.uint64((1 << TOKEN_BITS) - 1)
SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
MULT = np.uint64(0x9E3779B97F4A7C15)
SHINGLE_MULT = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: `[^\x20\x09-\x0D]`
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values one after another, and where each begins (one more than values); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES, rows: int = 1 << 14):
    """Parts of a batch with about `most` bytes of text (at least one row each), so memory follows the longest text only."""
    if not batch.num_rows:
        return
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64))
    begin = 0
    while begin < batch.num_rows:
        floor = size[begin - 1] if begin else 0
        end = min(max(begin + 1, int(np.searchsorted(size, floor + most, "right"))), begin + rows, batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end
    # Arrow keeps freed memory for itself; between batches a worker gives it back.
    pa.default_memory_pool().release_unused()


_pow = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """MULT^0 .. MULT^(n-1), modulo 2^64."""
    global _pow
    if len(_pow) < n:
        _pow = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 1024), MULT))])
    return _pow[:n]


def word_spans(data: np.ndarray, at: np.ndarray, is_word: np.ndarray = NOT_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word (byte runs of is_word that stay within a text), and each text's first word (one more than texts)."""
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return begin, end, np.searchsorted(begin, at)


def word_hashes(low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of lower-cased bytes."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    size = end - begin
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    codes = BYTE_CODE[low[place + np.repeat(begin, size)]] * powers(int(size.max()))[place]
    return mix(np.add.reduceat(codes, first) + size.astype(np.uint64))


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """50-bit hashes of each text's runs of `width` words and where each text's begin; a text of fewer words gives its whole sequence, one without words
    nothing."""
    count = np.diff(first)
    made = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(made)])
    total = int(at[-1])
    pos = np.arange(total) - np.repeat(at[:-1], made) + np.repeat(first[:-1], made)
    have = np.repeat(np.minimum(count, width), made)
    h = have.astype(np.uint64) * SHINGLE_MULT[15]
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for j in range(width):
        h += np.where(have > j, padded[pos + j], np.uint64(0)) * SHINGLE_MULT[j]
    return mix(h) >> np.uint64(64 - TOKEN_BITS), at


def shingles(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """shingle_hashes of the blank-separated, A-Z lower-cased words of each text."""
    data, at = flat(column)
    low = LOWER[data]
    begin, end, first = word_spans(low, at)
    return shingle_hashes(word_hashes(low, begin, end), first, width)


PLACE_BITS = 24


def minimum_runs(values: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of `width` values within one text: where each smallest value stands (leftmost of equal ones, by 40 bits), and the first and last window
    that it is the smallest of. These are the nodes of the texts' Cartesian trees whose subtree has at least `width` values."""
    empty = (np.zeros(0, np.int64),) * 3
    n = len(values)
    if n < width:
        return empty
    ok = np.zeros(n - width + 1, bool)
    size = np.diff(at)
    edge = np.zeros(n + 1, np.int64)
    long = size >= width
    np.add.at(edge, at[:-1][long], 1)
    np.add.at(edge, (at[1:] - width + 1)[long], -1)
    ok = np.cumsum(edge)[: n - width + 1] > 0
    step, found = (1 << PLACE_BITS) - width, []
    for base in range(0, n - width + 1, step):
        part = values[base : base + step + width - 1]
        low = (part >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(part), dtype=np.uint64)
        reach = 1
        while 2 * reach <= width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < width:
            low = np.minimum(low[: -(width - reach)], low[width - reach :])
        place = (low & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64) + base
        good = ok[base : base + len(place)]
        start = good.copy()
        start[1:] &= (place[1:] != place[:-1]) | ~good[:-1]
        stop = good.copy()
        stop[:-1] &= (place[1:] != place[:-1]) | ~good[1:]
        first, last = np.flatnonzero(start), np.flatnonzero(stop)
        found.append((place[first], first + base, last + base))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else empty
