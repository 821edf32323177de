"""Hash functions as Catalyst expressions; CRC-64 as an Arrow-batched UDF.

Unsigned 64-bit values don't exist in Spark: FNV is kept as two 32-bit halves
and shown as decimal(20,0); CRC-64 is bytes or hex.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from kvloom.functions.constants import SLOTS

FNV_OFFSET = 14695981039346656037
#: The prime is 2^40 + FNV_LOW.
FNV_LOW = 435
MASK32 = 0xFFFFFFFF


def crc16_table() -> list[int]:
    """XMODEM: polynomial 0x1021."""
    out = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x1021 if crc & 0x8000 else crc << 1) & 0xFFFF
        out.append(crc)
    return out


def crc64_table() -> list[int]:
    """Jones polynomial, bits reversed."""
    out = []
    for byte in range(256):
        crc = byte
        for _ in range(8):
            crc = crc >> 1 ^ (0x95AC9329AC4BC9B5 if crc & 1 else 0)
        out.append(crc)
    return out


_CRC64 = crc64_table()
_TABLE = np.array(_CRC64, np.uint64)


#: Bytes from which on blocks of a value are summed side by side; blocks at a time, at most.
LONG, LANES = 4096, 1 << 14


@functools.cache
def _behind(n: int) -> tuple[list[int], ...]:
    """What a CRC becomes when n zero bytes follow, as a table for each of its bytes.

    Zero bytes act on a CRC as a matrix over GF(2), whose columns are kept as
    numbers; the matrix of n is a product of squares.
    """
    step = lambda c: c >> 8 ^ _CRC64[c & 255]
    def times(matrix: list[int], c: int) -> int:
        out, i = 0, 0
        while c:
            if c & 1:
                out ^= matrix[i]
            c, i = c >> 1, i + 1
        return out

    square, matrix = [step(1 << i) for i in range(64)], [1 << i for i in range(64)]
    while n:
        if n & 1:
            matrix = [times(square, c) for c in matrix]
        square = [times(square, c) for c in square]
        n >>= 1
    return tuple([times(matrix, b << 8 * i) for b in range(256)] for i in range(8))


def crc64_joined(first: int, second: int, n: int) -> int:
    """CRC-64 of two stretches, one behind the other, from the CRC of each; n: bytes of the second."""
    for i, table in enumerate(_behind(n)):
        second ^= table[first >> 8 * i & 255]
    return second


def crc64_of(data: bytes, crc: int = 0) -> int:
    """CRC-64 of data, going on from crc. Long data are cut into blocks that are summed side by side and joined."""
    if len(data) >= LONG:
        lanes = min(LANES, len(data) // 256)
        size = len(data) // lanes
        x = np.frombuffer(data, np.uint8, lanes * size).reshape(lanes, size)
        own, low, eight = np.zeros(lanes, np.uint64), np.uint64(255), np.uint64(8)
        columns = np.ascontiguousarray(x.T)
        for p in range(size):
            own = own >> eight ^ _TABLE[(own ^ columns[p]) & low]
        for c in own.tolist():
            crc = crc64_joined(crc, c, size)
        data = data[lanes * size :]
    for b in data:
        crc = crc >> 8 ^ _CRC64[(crc ^ b) & 255]
    return crc


def byte_values(c: Column) -> Column:
    """array<int> of a string's or binary's bytes: in Latin-1 every byte is the character of its number."""
    chars = F.decode(c.cast("binary"), "ISO-8859-1")
    n = F.octet_length(c)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.ascii(F.substring(chars, i, F.lit(1))))


def hash_tag(key: Column, empty_tag_is_tag: bool = True) -> Column:
    """The part of a key that is hashed: between the first { and the first } after it, else the whole key.

    An empty tag counts as a tag (slot 0) unless empty_tag_is_tag is False,
    which hashes the whole key then, as the server does.
    """
    start = F.instr(key, "{")
    end = F.instr(F.substring(key, start + 1, F.length(key)), "}")
    tagged = (start > 0) & (end > 0) if empty_tag_is_tag else (start > 0) & (end > 1)
    return F.when(tagged, F.substring(key, start + 1, end - 1)).otherwise(key)


def crc16(c: Column) -> Column:
    table = F.array(*[F.lit(x) for x in crc16_table()])
    step = lambda crc, b: F.shiftleft(crc, 8).bitwiseAND(0xFFFF).bitwiseXOR(
        F.element_at(table, F.shiftright(crc, 8).bitwiseXOR(b) + 1)
    )
    return F.aggregate(byte_values(c), F.lit(0), step)


def key_slot(key: Column, empty_tag_is_tag: bool = True) -> Column:
    return crc16(hash_tag(key, empty_tag_is_tag)) % SLOTS


def fnv1a(c: Column) -> Column:
    """struct<hi bigint, lo bigint> of the 64-bit FNV-1a hash."""
    start = F.struct(F.lit(FNV_OFFSET >> 32).cast("long").alias("hi"), F.lit(FNV_OFFSET & MASK32).cast("long").alias("lo"))

    def step(h: Column, b: Column) -> Column:
        x = h["lo"].bitwiseXOR(b.cast("long"))
        product = x * FNV_LOW
        high = h["hi"] * FNV_LOW + F.shiftleft(x.bitwiseAND(0xFFFFFF), 8) + F.shiftright(product, 32)
        return F.struct(high.bitwiseAND(MASK32).alias("hi"), product.bitwiseAND(MASK32).alias("lo"))

    return F.aggregate(byte_values(c), start, step)


def fnv_decimal(h: Column) -> Column:
    return (h["hi"].cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + h["lo"].cast("decimal(20,0)")).cast("decimal(20,0)")


def worker_index(h: Column, n: int) -> Column:
    """FNV hash modulo n; 0 for n = 0."""
    if n == 0:
        return F.lit(0).cast("long")
    return ((h["hi"] % n) * ((1 << 32) % n) + h["lo"] % n) % n


#: Rows from which on a step over all of them beats a loop over bytes.
FEW = 16


def crc64_batch(values: list[bytes], starts: list[int]) -> np.ndarray:
    """CRC-64 of each value, going on from starts: byte places one after the other, for all rows that are long enough at once."""
    size = np.array([len(v) for v in values], np.int64)
    order = np.argsort(-size, kind="stable")
    data, begin = np.frombuffer(b"".join(values), np.uint8), np.cumsum(size) - size
    crc, low, eight = np.array(starts, np.uint64), np.uint64(255), np.uint64(8)
    ascending = np.sort(size)
    for p in range(int(size.max(initial=0))):
        rows = order[: len(size) - int(np.searchsorted(ascending, p, side="right"))]
        if len(rows) < FEW:
            for r in rows:
                crc[r] = crc64_of(values[r][p:], int(crc[r]))
            break
        own = crc[rows]
        crc[rows] = own >> eight ^ _TABLE[(own ^ data[begin[rows] + p]) & low]
    return crc


def _crc64_series(data: pd.Series, start: pd.Series | None) -> pd.Series:
    some = np.flatnonzero(data.notna())
    starts = [0] * len(some) if start is None else [int.from_bytes(bytes(s or b""), "little") for s in start.iloc[some]]
    out = np.full(len(data), None, object)
    raw = crc64_batch([bytes(b) for b in data.iloc[some]], starts).astype("<u8").tobytes()
    out[some] = [raw[i : i + 8] for i in range(0, len(raw), 8)]
    return pd.Series(out)


@F.pandas_udf(BinaryType())
def crc64(data: pd.Series) -> pd.Series:
    """CRC-64 (Jones, start 0, no final xor) as 8 bytes, little-endian; null for null."""
    return _crc64_series(data, None)


@F.pandas_udf(BinaryType())
def crc64_from(data: pd.Series, start: pd.Series) -> pd.Series:
    """As crc64, going on from an earlier CRC given as 8 little-endian bytes."""
    return _crc64_series(data, start)
