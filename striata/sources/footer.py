"""Footers and page headers by a small compact-protocol reader over ranged reads."""

from __future__ import annotations

import struct
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class FormatError(ValueError):
    """The bytes aren't of this format, or use a part of it that isn't supported."""


MAGIC = b"PAR1"


def edges(read, size: int) -> tuple[bool, bool, int | None]:
    """Whether a file of so many bytes starts and ends with the magic bytes, and its footer's size; read(offset, n) gives bytes."""
    if size < 12:
        return size >= 4 and read(0, 4) == MAGIC, False, None
    tail = read(size - 8, 8)
    return read(0, 4) == MAGIC, tail[4:] == MAGIC, int.from_bytes(tail[:4], "little")


def read_footer(read, size: int, path: str = "file") -> dict[int, Any]:
    """The file's metadata struct, by field id, from a few ranged reads; anything wrong with the file's edges is a FormatError."""
    header_ok, footer_ok, length = edges(read, size)
    if not (header_ok and footer_ok):
        raise FormatError(f"{path} doesn't start and end with {MAGIC.decode()}")
    if length is None or length + 12 > size:
        raise FormatError(f"{path}: a footer of {length} bytes doesn't fit")
    try:
        return Compact(read(size - 8 - length, length)).struct()
    except IndexError:
        raise FormatError(f"{path}: truncated footer") from None


def magic(spark: SparkSession, path: str) -> DataFrame:
    """file, header_ok, footer_ok, footer_size of each file, by ranged reads of 12 bytes."""
    from .colmeta import metadata

    return metadata(spark, path, "magic")


class Compact:
    """Structs of the compact protocol as {field id: value}; nested structs likewise."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def varint(self) -> int:
        value = shift = 0
        while True:
            byte = self.data[self.at]
            self.at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    def signed(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def value(self, kind: int) -> Any:
        if kind in (1, 2):
            return kind == 1
        if kind == 3:
            self.at += 1
            return struct.unpack_from("b", self.data, self.at - 1)[0]
        if kind in (4, 5, 6):
            return self.signed()
        if kind == 7:
            self.at += 8
            return struct.unpack_from("<d", self.data, self.at - 8)[0]
        if kind == 8:
            n = self.varint()
            self.at += n
            return self.data[self.at - n : self.at]
        if kind in (9, 10):
            head = self.data[self.at]
            self.at += 1
            n = head >> 4 if head >> 4 < 15 else self.varint()
            if head & 15 in (1, 2):  # in lists a truth value is a byte
                self.at += n
                return [b == 1 for b in self.data[self.at - n : self.at]]
            return [self.value(head & 15) for _ in range(n)]
        if kind == 12:
            return self.struct()
        raise FormatError(f"compact type {kind}")

    def struct(self) -> dict[int, Any]:
        out, field = {}, 0
        while head := self.data[self.at]:
            self.at += 1
            field = field + (head >> 4) if head >> 4 else self.signed()
            out[field] = self.value(head & 15)
        self.at += 1
        return out


# Names of the format's enumerations, by number.
TYPES = ["BOOLEAN", "INT32", "INT64", "INT96", "FLOAT", "DOUBLE", "BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY"]
REPETITIONS = ["REQUIRED", "OPTIONAL", "REPEATED"]
CONVERTED = ["UTF8", "MAP", "MAP_KEY_VALUE", "LIST", "ENUM", "DECIMAL", "DATE", "TIME_MILLIS", "TIME_MICROS", "TIMESTAMP_MILLIS", "TIMESTAMP_MICROS", "UINT_8", "UINT_16", "UINT_32", "UINT_64", "INT_8", "INT_16", "INT_32", "INT_64", "JSON", "BSON", "INTERVAL"]
LOGICAL = {1: "STRING", 2: "MAP", 3: "LIST", 4: "ENUM", 5: "DECIMAL", 6: "DATE", 7: "TIME", 8: "TIMESTAMP", 10: "INTEGER", 11: "UNKNOWN", 12: "JSON", 13: "BSON", 14: "UUID", 15: "FLOAT16"}
UNITS = {1: "MILLIS", 2: "MICROS", 3: "NANOS"}
CODECS = ["UNCOMPRESSED", "SNAPPY", "GZIP", "LZO", "BROTLI", "LZ4", "ZSTD", "LZ4_RAW"]
PAGE_TYPES = ["DATA_PAGE", "INDEX_PAGE", "DICTIONARY_PAGE", "DATA_PAGE_V2"]
ENCODINGS = ["PLAIN", None, "PLAIN_DICTIONARY", "RLE", "BIT_PACKED", "DELTA_BINARY_PACKED", "DELTA_LENGTH_BYTE_ARRAY", "DELTA_BYTE_ARRAY", "RLE_DICTIONARY", "BYTE_STREAM_SPLIT"]


def name_of(names: list[str | None], number: int | None) -> str | None:
    """An enumeration's name; its number as text if it has none; null for null."""
    if number is None:
        return None
    return names[number] if 0 <= number < len(names) and names[number] else str(number)


def pages(read, start: int, end: int) -> list[dict]:
    """Headers of the pages from byte start to end; read(offset, n) gives bytes. Bodies are skipped."""
    out, at = [], start
    while at < end:
        size = 512
        while True:
            reader = Compact(read(at, min(size, end - at)))
            try:
                head = reader.struct()
                break
            except IndexError:
                if size >= end - at:
                    raise FormatError(f"truncated page header at {at}") from None
                size *= 8
        kind = name_of(PAGE_TYPES, head.get(1))
        body = next((head[f] for f in (5, 7, 8) if f in head), {})
        v2 = kind == "DATA_PAGE_V2"
        out.append({
            "page_offset": at, "page_type": kind, "uncompressed_size": head.get(2), "compressed_size": head.get(3), "num_values": body.get(1),
            "value_encoding": name_of(ENCODINGS, body.get(4 if v2 else 2)),
            "def_level_encoding": "RLE" if v2 else name_of(ENCODINGS, body.get(3)) if kind == "DATA_PAGE" else None,
            "rep_level_encoding": "RLE" if v2 else name_of(ENCODINGS, body.get(4)) if kind == "DATA_PAGE" else None,
            "body": at + reader.at, "header": body,
        })
        at += reader.at + head[3]
    return out


def logical_name(union: dict[int, Any] | None) -> str | None:
    """The name of a logical type, with its unit for times: TIME_MILLIS also where no converted type says it."""
    if not union:
        return None
    number, fields = next(iter(union.items()))
    name = LOGICAL.get(number, str(number))
    return f"{name}_{UNITS[next(iter(fields[2]))]}" if number in (7, 8) and fields.get(2) else name


def elements(meta: dict[int, Any]) -> list[dict]:
    """The schema tree in order, the root first: each element's fields, its path, and its maximal levels."""
    flat, out = meta[2], []

    def walk(at: int, path: list[str], definition: int, repetition: int) -> int:
        e = flat[at]
        kind = name_of(REPETITIONS, e.get(3))
        if at:
            path = [*path, e[4].decode("utf-8", "replace")]
            definition, repetition = definition + (kind != "REQUIRED"), repetition + (kind == "REPEATED")
        out.append({
            "position": at, "path": ".".join(path), "name": e[4].decode("utf-8", "replace"), "type": name_of(TYPES, e.get(1)), "type_length": e.get(2), "repetition": kind, "num_children": e.get(5),
            "converted_type": name_of(CONVERTED, e.get(6)), "logical_type": logical_name(e.get(10)), "scale": e.get(7), "precision": e.get(8), "max_definition_level": definition, "max_repetition_level": repetition,
        })
        at += 1
        for _ in range(e.get(5) or 0):
            at = walk(at, path, definition, repetition)
        return at

    walk(0, [], 0, 0)
    return out
