"""Values of column chunks by the byte-level decoders: for looking into pages; scans use the vectorised reader.

Reads the page headers, dictionaries, levels and values of PLAIN and dictionary encoded pages (and RLE truth values) of both
page versions, in every codec that pyarrow has. Other encodings are a FormatError that names them.
"""

from __future__ import annotations

from collections.abc import Iterator

from ..functions import encodings as enc
from .footer import CODECS, ENCODINGS, TYPES, FormatError, elements, name_of, pages


def decompressed(data: bytes, codec: str, size: int) -> bytes:
    import pyarrow as pa

    if codec == "UNCOMPRESSED":
        return data
    name = {"LZ4": "lz4", "LZ4_RAW": "lz4_raw"}.get(codec, codec.lower())
    try:
        return pa.Codec(name).decompress(data, size).to_pybytes()
    except (ValueError, NotImplementedError):
        raise FormatError(f"codec {codec} can't be read here") from None


def _levels(data: bytes, largest: int, count: int) -> tuple[list[int], bytes]:
    """Levels of a version 1 page, with their length before them, and what follows."""
    if not largest:
        return [0] * count, data
    size = int.from_bytes(data[:4], "little")
    return enc.hybrid(data[: 4 + size], enc.bit_width(largest), count, with_length=True), data[4 + size :]


def _values(data: bytes, encoding: str | None, kind: str, length: int, count: int, dictionary: list | None) -> list:
    if encoding in ("RLE_DICTIONARY", "PLAIN_DICTIONARY"):
        if dictionary is None:
            raise FormatError("a page refers to a dictionary that isn't there")
        return [dictionary[i] for i in enc.hybrid(data[1:], data[0], count)] if count else []
    if encoding == "PLAIN":
        return enc.plain(data, kind, count, length)
    if encoding == "RLE" and kind == "BOOLEAN":
        return [bool(x) for x in enc.hybrid(data, 1, count, with_length=True)]
    raise FormatError(f"encoding {encoding} of {kind} can't be read here")


def list_level(tree: list[dict], leaf: dict) -> int:
    """The definition level from which an entry of a leaf stands for an element (null or not) of its innermost list, not for an absent or empty list."""
    depth = leaf["max_repetition_level"]
    above = (e for e in reversed(tree[: leaf["position"] + 1]) if e["repetition"] == "REPEATED" and e["max_repetition_level"] == depth)
    return next(above)["max_definition_level"] if depth else 0


def first_page(column: dict) -> int:
    return min(x for x in (column.get(11), column[9]) if x)


def row_groups(meta: dict, within: range | None = None) -> Iterator[tuple[int, dict]]:
    """Row groups with their numbers; within: those whose first page starts there."""
    return ((g, group) for g, group in enumerate(meta.get(4) or []) if within is None or first_page(group[1][0][3]) in within)


def chunk_values(read, column: dict, leaf: dict, levels_only: bool = False) -> Iterator[tuple[list[int], list[int], list]]:
    """(repetition levels, definition levels, values with None for nulls) of each data page of a chunk; column: its metadata struct. levels_only: no values."""
    kind, codec = name_of(TYPES, column[1]), name_of(CODECS, column[4])
    first = first_page(column)
    dictionary, most, depth = None, leaf["max_definition_level"], leaf["max_repetition_level"]
    for page in pages(read, first, first + column[7]):
        data, head, count = read(page["body"], page["compressed_size"]), page["header"], page["num_values"]
        if page["page_type"] == "DICTIONARY_PAGE":
            dictionary = None if levels_only else enc.plain(decompressed(data, codec, page["uncompressed_size"]), kind, count, leaf["type_length"] or 0)
            continue
        if page["page_type"] == "DATA_PAGE":
            data = decompressed(data, codec, page["uncompressed_size"])
            repetition, data = _levels(data, depth, count)
            definition, data = _levels(data, most, count)
        elif page["page_type"] == "DATA_PAGE_V2":
            n_definition, n_repetition = head[5], head[6]
            repetition = enc.hybrid(data[:n_repetition], enc.bit_width(depth), count) if depth else [0] * count
            definition = enc.hybrid(data[n_repetition : n_repetition + n_definition], enc.bit_width(most), count) if most else [0] * count
            data = data[n_repetition + n_definition :]
            if head.get(7, True) and data and not levels_only:
                data = decompressed(data, codec, page["uncompressed_size"] - n_repetition - n_definition)
        else:
            continue
        if levels_only:
            yield repetition, definition, []
            continue
        present = iter(_values(data, page["value_encoding"], kind, leaf["type_length"] or 0, sum(d == most for d in definition), dictionary))
        yield repetition, definition, [next(present) if d == most else None for d in definition]


def counts(read, meta: dict, path: str, column: str | None = None, within: range | None = None):
    """Rows with the number of entries and of elements of each chunk of a file, or of one column's. Pages are read for lists only."""
    tree = elements(meta)
    leaves = [e for e in tree if e["type"] is not None]
    for g, group in row_groups(meta, within):
        for i, (chunk, leaf) in enumerate(zip(group[1], leaves, strict=True)):
            if column not in (None, leaf["path"]):
                continue
            n, least = chunk[3][5], list_level(tree, leaf)
            yield path, g, i, leaf["path"], n, sum(d >= least for _, definition, _ in chunk_values(read, chunk[3], leaf, True) for d in definition) if least else n


def batches(read, meta: dict, path: str, column: str | None = None, within: range | None = None):
    """Arrow batches of all values of a file, or of one column: a row for each entry of each chunk."""
    import decimal
    import itertools

    import pyarrow as pa

    tree = elements(meta)
    leaves = [e for e in tree if e["type"] is not None]
    for g, group in row_groups(meta, within):
        for i, (chunk, leaf) in enumerate(zip(group[1], leaves, strict=True)):
            if column not in (None, leaf["path"]):
                continue
            at, place, least = 0, itertools.count(), list_level(tree, leaf)
            for repetition, definition, values in chunk_values(read, chunk[3], leaf):
                n, kind = len(values), leaf["type"]
                pick = lambda kinds, of=lambda v: v, kind=kind, values=values, n=n: [None if v is None else of(v) for v in values] if kind in kinds else [None] * n
                yield pa.RecordBatch.from_arrays([
                    pa.array([path] * n, pa.string()), pa.array([g] * n, pa.int32()), pa.array([i] * n, pa.int32()), pa.array([leaf["path"]] * n, pa.string()), pa.array(range(at, at + n), pa.int64()), pa.array([next(place) if d >= least else None for d in definition], pa.int64()),
                    pa.array(repetition, pa.int32()), pa.array(definition, pa.int32()), pa.array(pick(("BOOLEAN", "INT32", "INT64"), int), pa.int64()), pa.array(pick(("FLOAT", "DOUBLE"), float), pa.float64()),
                    pa.array(pick(("BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY")), pa.binary()), pa.array(pick(("INT96",), decimal.Decimal), pa.decimal128(38, 0)),
                ], names=["file", "row_group", "column", "path", "entry", "element", "repetition_level", "definition_level", "integer", "number", "bytes", "int96"])
                at += n


__all__ = ["ENCODINGS", "batches", "chunk_values", "counts", "decompressed"]
