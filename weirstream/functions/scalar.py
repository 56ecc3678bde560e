"""Scalar functions: time conversions, murmur3 hash codes, modular numbers."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH_SEED = 12331233


def seconds_of(c: Column, kind: T.DataType) -> Column:
    """Seconds since the epoch of BIGINT milliseconds (towards zero), INT seconds or a timestamp."""
    if isinstance(kind, T.LongType):
        return F.expr("null").cast("bigint") if c is None else (F.signum(c) * F.floor(F.abs(c) / 1000)).cast("bigint")
    if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
        return c.cast("bigint")
    return F.unix_seconds(c.cast("timestamp"))


def to_timestamp(c: Column, kind: T.DataType) -> Column:
    """TIMESTAMP of BIGINT milliseconds or INT seconds; null gives null."""
    return F.timestamp_millis(c) if isinstance(kind, T.LongType) else F.timestamp_seconds(c)


def to_long_timestamp(c: Column) -> Column:
    return F.unix_millis(c.cast("timestamp"))


def _local(c: Column, kind: T.DataType, zone: Column | str) -> Column:
    zone = F.lit(zone) if isinstance(zone, str) else zone
    return F.from_utc_timestamp(F.to_utc_timestamp(F.timestamp_seconds(seconds_of(c, kind)), F.current_timezone()), zone)


def to_date(c: Column, kind: T.DataType, zone: Column | str = "GMT") -> Column:
    return F.to_date(_local(c, kind, zone))


def to_hour(c: Column, kind: T.DataType, zone: Column | str = "GMT") -> Column:
    return F.hour(_local(c, kind, zone))


def modular(x: Column, m: Column) -> Column:
    """abs(x) mod m; 0 for nulls, m <= 0 and the number without an absolute value."""
    least = F.lit(-(2**63)).cast("bigint")
    x, m = x.cast("bigint"), m.cast("bigint")
    bad = x.isNull() | m.isNull() | (m <= 0) | (x == least)
    return F.when(bad, F.lit(0)).otherwise((F.abs(F.when(bad, F.lit(0)).otherwise(x)) % F.when(bad, F.lit(1)).otherwise(m)).cast("int"))


def line_separator() -> Column:
    return F.lit("\n")


_M = (1 << 64) - 1
_C1, _C2 = 0x87C37B91114253D5, 0x4CF5AD432745937F


def _rotl(x: int, n: int) -> int:
    return (x << n | x >> (64 - n)) & _M


def _fmix(k: int) -> int:
    k = (k ^ k >> 33) * 0xFF51AFD7ED558CCD & _M
    k = (k ^ k >> 33) * 0xC4CEB9FE1A85EC53 & _M
    return k ^ k >> 33


def murmur3_x64_128(data: bytes, seed: int) -> int:
    """The first 64 bits, signed, of the public MurmurHash3 x64 128-bit function."""
    h1 = h2 = seed & 0xFFFFFFFF
    full = len(data) // 16 * 16
    for k1, k2 in struct.iter_unpack("<QQ", data[:full]):
        h1 ^= _rotl(k1 * _C1 & _M, 31) * _C2 & _M
        h1 = ((_rotl(h1, 27) + h2) * 5 + 0x52DCE729) & _M
        h2 ^= _rotl(k2 * _C2 & _M, 33) * _C1 & _M
        h2 = ((_rotl(h2, 31) + h1) * 5 + 0x38495AB5) & _M
    tail = data[full:]
    k1, k2 = int.from_bytes(tail[:8], "little"), int.from_bytes(tail[8:], "little")
    if len(tail) > 8:
        h2 ^= _rotl(k2 * _C2 & _M, 33) * _C1 & _M
    if tail:
        h1 ^= _rotl(k1 * _C1 & _M, 31) * _C2 & _M
    h1, h2 = h1 ^ len(data), h2 ^ len(data)
    h1 = (h1 + h2) & _M
    h2 = (h2 + h1) & _M
    h1, h2 = _fmix(h1), _fmix(h2)
    h1 = (h1 + h2) & _M
    return h1 - (1 << 64) if h1 >> 63 else h1


def _mixed(k: np.ndarray, first: int, turn: int, second: int) -> np.ndarray:
    k = k * np.uint64(first)
    return (k << np.uint64(turn) | k >> np.uint64(64 - turn)) * np.uint64(second)


def murmur3_rows(data: np.ndarray, offsets: np.ndarray, seed: int) -> np.ndarray:
    """murmur3_x64_128 of the byte runs data[offsets[i]:offsets[i + 1]], all rows at once, 16 bytes of each at a time."""
    u, size = np.uint64, np.diff(offsets)
    h1 = np.full(len(size), seed & 0xFFFFFFFF, u)
    h2 = h1.copy()
    padded = np.concatenate([data, np.zeros(16, np.uint8)])

    def words(rows: np.ndarray, at: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        block = padded[(offsets[:-1][rows] + at)[:, None] + np.arange(16)]
        if keep is not None:
            block = np.where(np.arange(16) < keep[:, None], block, 0)
        both = np.ascontiguousarray(block.astype(np.uint8)).view("<u8")
        return both[:, 0], both[:, 1]

    def rotated(x: np.ndarray, n: int) -> np.ndarray:
        return x << u(n) | x >> u(64 - n)

    def finished(k: np.ndarray) -> np.ndarray:
        k = (k ^ k >> u(33)) * u(0xFF51AFD7ED558CCD)
        k = (k ^ k >> u(33)) * u(0xC4CEB9FE1A85EC53)
        return k ^ k >> u(33)

    rows, block = np.flatnonzero(size >= 16), 0
    while len(rows):
        k1, k2 = words(rows, np.full(len(rows), 16 * block))
        a, b = h1[rows] ^ _mixed(k1, _C1, 31, _C2), h2[rows]
        a = (rotated(a, 27) + b) * u(5) + u(0x52DCE729)
        b = b ^ _mixed(k2, _C2, 33, _C1)
        h1[rows], h2[rows] = a, (rotated(b, 31) + a) * u(5) + u(0x38495AB5)
        block += 1
        rows = rows[size[rows] >= 16 * (block + 1)]
    every = np.arange(len(size))
    k1, k2 = words(every, size // 16 * 16, size % 16)
    h1 ^= _mixed(k1, _C1, 31, _C2)  # zeros change nothing
    h2 ^= _mixed(k2, _C2, 33, _C1)
    h1, h2 = h1 ^ size.astype(u), h2 ^ size.astype(u)
    h1 = h1 + h2
    h1, h2 = finished(h1), finished(h2 + h1)
    return (h1 + h2).view(np.int64)


def hash_codes(column: pa.Array, seed: int = HASH_SEED) -> pa.Array:
    """murmur3 of a string's UTF-8 or a number's little-endian bytes in the width of its type; 0 for null."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        column = column.cast(pa.large_string())
        _, at, data = pc.fill_null(column, "").buffers()
        offsets = np.frombuffer(at, np.int64)[: len(column) + 1] if len(column) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    else:
        column = column.cast(pa.int16()) if pa.types.is_int8(kind) else column
        if not (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
            raise TypeError(f"hash_code takes strings and numbers, not {kind}")
        numbers = np.ascontiguousarray(pc.fill_null(column, 0).to_numpy(zero_copy_only=False))
        raw, offsets = numbers.view(np.uint8), np.arange(len(column) + 1) * numbers.itemsize
    codes = murmur3_rows(raw, offsets, seed)
    return pa.array(np.where(column.is_null().to_numpy(zero_copy_only=False), 0, codes), pa.int64())


def hash_code_function(seed: int = HASH_SEED):
    """hash_code for SQL and DataFrames; the argument's type decides the bytes."""

    def run(column: pa.Array) -> pa.Array:
        return hash_codes(column, seed)

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "bigint")


def hash_code(c: Column, kind: T.DataType | None = None, seed: int = HASH_SEED) -> Column:
    return hash_code_function(seed)(c)
