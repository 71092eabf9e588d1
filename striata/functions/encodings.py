"""Byte-level decoders for debugging pages: plain functions on bytes, and column functions over them in Arrow batches.

File scans don't use them. Numbers are little-endian. A function that reads from the front returns what it read; `used`
variants also tell how many bytes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _numbers(data: bytes, count: int, kind: str) -> list:
    size = np.dtype(kind).itemsize * count
    if len(data) < size:
        raise EOFError(f"{size} bytes wanted, {len(data)} left")
    return np.frombuffer(data[:size], dtype=kind).tolist()


def plain_int32(data: bytes, count: int) -> list[int]:
    return _numbers(data, count, "<i4")


def plain_int64(data: bytes, count: int) -> list[int]:
    return _numbers(data, count, "<i8")


def plain_float(data: bytes, count: int) -> list[float]:
    return _numbers(data, count, "<f4")


def plain_double(data: bytes, count: int) -> list[float]:
    return _numbers(data, count, "<f8")


def plain_int96(data: bytes, count: int) -> list[int]:
    """(8 bytes) * 2**32 + (4 bytes)."""
    if len(data) < 12 * count:
        raise EOFError(f"{12 * count} bytes wanted, {len(data)} left")
    return [(int.from_bytes(data[i : i + 8], "little", signed=True) << 32) | int.from_bytes(data[i + 8 : i + 12], "little") for i in range(0, 12 * count, 12)]


def plain_boolean(data: bytes, count: int) -> list[bool]:
    """Lowest bit first."""
    return np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little")[:count].astype(bool).tolist()


def plain_bytes(data: bytes, count: int) -> list[bytes]:
    """Each with its length before it, 4 bytes."""
    out, at = [], 0
    for _ in range(count):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        if at + 4 + n > len(data):
            raise EOFError("truncated value")
        at += 4 + n
    return out


def plain_fixed(data: bytes, count: int, length: int) -> list[bytes]:
    if len(data) < count * length:
        raise EOFError("truncated value")
    return [data[i : i + length] for i in range(0, count * length, length)] if length else [b""] * count


PLAIN = {"BOOLEAN": plain_boolean, "INT32": plain_int32, "INT64": plain_int64, "INT96": plain_int96, "FLOAT": plain_float, "DOUBLE": plain_double, "BYTE_ARRAY": plain_bytes}


def plain(data: bytes, kind: str, count: int, length: int = 0) -> list:
    """By physical type."""
    if not count:
        return []
    return plain_fixed(data, count, length) if kind == "FIXED_LEN_BYTE_ARRAY" else PLAIN[kind](data, count)


def unsigned_varint(data: bytes) -> tuple[int, int]:
    """Value and bytes used; 7 bits a byte, lowest first."""
    value = 0
    for used, byte in enumerate(data):
        value |= (byte & 0x7F) << (7 * used)
        if byte < 0x80:
            return value, used + 1
    raise EOFError("truncated number")


def signed_64(value: int) -> int:
    """The bigint with these 64 bits."""
    if value >= 1 << 64:
        raise OverflowError(f"{value} has more than 64 bits")
    return value - (1 << 64) if value >> 63 else value


def bit_width(largest: int) -> int:
    """Bits that hold 0..largest."""
    return int(largest).bit_length()


def mask(bits: int) -> int:
    return (1 << bits) - 1


def bit_packed(data: bytes, groups: int, width: int) -> list[int]:
    """groups * 8 numbers of width bits, lowest bit first."""
    return _packed(data, groups * 8, width, "little")


def bit_packed_high(data: bytes, count: int, width: int) -> list[int]:
    """count numbers of width bits, highest bit first (the deprecated order)."""
    return _packed(data, count, width, "big")


def _packed(data: bytes, count: int, width: int, order: str) -> list[int]:
    if not width:
        return [0] * count
    if len(data) * 8 < count * width:
        raise EOFError("truncated numbers")
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder=order)[: count * width].reshape(count, width)
    places = np.arange(width, dtype=np.uint64) if order == "little" else np.arange(width - 1, -1, -1, dtype=np.int64).astype(np.uint64)
    if width > 64:
        return [sum(int(b) << int(p) for b, p in zip(row, places, strict=True)) for row in bits]
    return (bits.astype(np.uint64) << places).sum(1, dtype=np.uint64).tolist()


def hybrid(data: bytes, width: int, count: int | None = None, with_length: bool = False) -> list[int]:
    """Runs of one number and packed groups, until the bytes or count end. with_length: 4 bytes of length come first."""
    if with_length:
        data = data[4 : 4 + int.from_bytes(data[:4], "little")]
    out: list[int] = []
    at, size = 0, (width + 7) // 8
    while at < len(data) and (count is None or len(out) < count):
        head, used = unsigned_varint(data[at:])
        at += used
        if head & 1:
            n = (head >> 1) * width
            out += bit_packed(data[at : at + n].ljust(n, b"\0"), head >> 1, width)
            at += n
        else:
            out += [int.from_bytes(data[at : at + size], "little")] * (head >> 1)
            at += size
    return out if count is None else out[:count]


def run_length(data: bytes, header: int, width: int) -> list[int]:
    """The run that a header (twice its length) announces."""
    return [int.from_bytes(data[: (width + 7) // 8], "little")] * (header >> 1)


def _column(fn, kind: str):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else fn(bytes(b)) for b in s], dtype=object)  # numbers beside nulls would become floats

    return run


def decode_plain(value: Column, kind: str, count: int, length: int = 0) -> Column:
    """Bytes of a PLAIN page as an array; null for null."""
    types = {"BOOLEAN": "boolean", "INT32": "int", "INT64": "bigint", "INT96": "string", "FLOAT": "float", "DOUBLE": "double"}
    cast = (lambda xs: [str(x) for x in xs]) if kind == "INT96" else (lambda xs: xs)
    return _column(lambda b: cast(plain(b, kind, count, length)), f"array<{types.get(kind, 'binary')}>")(value)


def decode_hybrid(value: Column, width: int, count: int | None = None) -> Column:
    return _column(lambda b: hybrid(b, width, count), "array<bigint>")(value)


def decode_varint(value: Column) -> Column:
    """As a bigint: numbers from 2^63 on are negative ones; longer ones than 64 bits are an error."""
    return _column(lambda b: signed_64(unsigned_varint(b)[0]), "bigint")(value)


def decode_bit_packed(value: Column, count: int, width: int, high: bool = False) -> Column:
    """count numbers of width bits; high: in the deprecated order (else count is a multiple of 8)."""
    return _column(lambda b: bit_packed_high(b, count, width) if high else bit_packed(b, count // 8, width), "array<bigint>")(value)


def decode_run(value: Column, header: int, width: int) -> Column:
    return _column(lambda b: run_length(b, header, width), "array<bigint>")(value)


def mask_of(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bits.cast("int")) - 1


def bit_width_of(value: Column) -> Column:
    return F.when(value == 0, 0).otherwise(F.length(F.bin(value)))
