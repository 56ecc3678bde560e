"""Vectorised words and shingles over Arrow text columns: whole batches as byte arrays, no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_SPACES = (9, 10, 11, 12, 13, 32)
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(_SPACES)] = False
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
#: One random 64-bit value a byte, and an odd base with its inverse modulo 2**64, for hashes of byte runs by prefix sums.
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Odd multipliers for the places of a shingle.
_PLACES = [U((0xD6E8FEB86659FD93 * (2 * i + 1) + 0x2545F4914F6CDD1C) & 0xFFFFFFFFFFFFFFFF | 1) for i in range(64)]
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values (a bijection)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and _INVERSE**i for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, U(base))
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def chunks(column: pa.Array | pa.ChunkedArray, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts of up to max_bytes, or one longer text. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    pa.default_memory_pool().release_unused()


def word_bounds(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the index of the first word of each text (with the total at the end)."""
    inside = kinds[data]
    begins, ends = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        begins[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def run_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs data[start:stop]."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(U))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words, and the index of each text's first word."""
    low = LOWERED[data]
    starts, stops, first = word_bounds(low, offsets)
    return run_hashes(low, starts, stops), first


def shingles(hashes: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and their bounds by text.

    A text of 1 to n-1 words is one shingle, its whole sequence; one without words has none.
    """
    total = len(hashes)
    places = [hashes * _PLACES[j] for j in range(n)]
    if total >= n:
        full = places[0][: total - n + 1].copy()
        for j in range(1, n):
            full += places[j][j : total - n + 1 + j]
        full = mixed(full)
    parts, bounds = [], [0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            found = np.unique(full[a : b - n + 1])
        elif b > a:
            found = mixed(sum((places[j][a + j : a + j + 1] for j in range(b - a)), np.full(1, U(b - a))))
        else:
            found = hashes[:0]
        parts.append(found)
        bounds.append(bounds[-1] + len(found))
    return (np.concatenate(parts) if parts else hashes[:0]), np.array(bounds)


def binary_column(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows of raw bytes values[bounds[i]:bounds[i+1]] as an Arrow binary column."""
    data = np.ascontiguousarray(values)
    at = (np.asarray(bounds) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data.view(np.uint8))])
