"""Scans: projection by name or dotted path, file order, rows as lists or dicts.

Decoding pages, codecs, levels and dictionaries is the vectorised reader's work; pruning reaches the scan's ReadSchema.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import logical
from .colmeta import files_of, metadata
from .footer import FormatError, magic

#: Types by which columns are read whose annotations Spark's inference refuses or reads otherwise; logical.convert does the rest.
RAW = {"TIME_MILLIS": "int", "TIME_MICROS": "bigint", "TIME_NANOS": "bigint", "INTERVAL": "binary", "BSON": "binary"}
#: Spark's own types for what Arrow's conversion doesn't know, by Arrow's names.
WIDER = {"uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "extension<arrow.json>": "string", "extension<arrow.uuid>": "binary"}
#: Codecs that no reader here has.
UNREADABLE = ("LZO", "BROTLI")


def path_column(path: str) -> Column:
    """A dotted path as a column of that name; parts may hold any character but a dot."""
    return F.col(".".join(f"`{p.replace('`', '``')}`" for p in path.split("."))).alias(path)


def leaves(schema: T.StructType, prefix: str = "") -> list[str]:
    """Dotted paths of all leaves; lists and maps stay whole."""
    out = []
    for f in schema.fields:
        name = prefix + f.name
        out += leaves(f.dataType, name + ".") if isinstance(f.dataType, T.StructType) else [name]
    return out


def project(df: DataFrame, columns: list[str] | None = None, flatten: bool = False) -> DataFrame:
    """The requested columns in the requested order (duplicates kept; a missing one is an error); none or [] means all."""
    if columns:
        return df.select(*(F.col(f"`{c}`") if c in df.columns else path_column(c) for c in columns))
    return df.select(*(path_column(c) for c in leaves(df.schema))) if flatten else df


def scan(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, schema: str | T.StructType | None = None, flatten: bool = False) -> DataFrame:
    """Files, folders or globs. schema overrides inference (RAW lists what needs it)."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return project(reader.parquet(*([path] if isinstance(path, str) else path)), columns, flatten)


def with_file_order(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """The scan with two more columns, and their names, by which rows are in file order."""
    paths = [path] if isinstance(path, str) else path
    df = spark.read.parquet(*paths)
    names = ["__file", "__row"]
    picked = project(df.select("*", F.col("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1])), [*(columns or df.columns), *names])
    return picked, names


def rows(df: DataFrame) -> Iterator[list]:
    """Rows as lists, a partition at a time."""
    return (list(r) for r in df.toLocalIterator())


def dict_rows(df: DataFrame) -> Iterator[OrderedDict]:
    """Rows as ordered dicts: a repeated name keeps its place and its last value."""
    return (OrderedDict(zip(df.columns, r, strict=True)) for r in df.toLocalIterator())


def decoded(spark: SparkSession, path: str, columns: list[str] | None = None, int96_raw: bool = False, parse_json: bool = False, bson: bool = False) -> DataFrame:
    """A scan whose columns are read by their annotations: what the format says, also where Spark's inference stops.

    The footer of the path's first file says which columns are read raw: TIME_MILLIS becomes a day-time interval, INTERVAL a
    struct, INT96 the raw number if int96_raw (else a timestamp), JSON a variant if parse_json, BSON JSON text if bson (else
    bytes); TIME_MICROS and TIME_NANOS stay numbers. Other types are Spark's own. Files with a codec that can't be read are refused; files
    with BYTE_STREAM_SPLIT or raw INT96 are read by the row-wise reader, in a session of their own.
    """
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import from_arrow_type

    from .colmeta import _open

    first = files_of(path)[:1]
    if not first:
        raise FormatError(f"{path} holds no files")
    chunks = metadata(spark, first[0], "chunk").select("codec", "encodings").distinct().collect()
    if bad := sorted({c.codec for c in chunks} & set(UNREADABLE)):
        raise FormatError(f"{first[0]}: codec {', '.join(bad)} can't be read")
    tree = metadata(spark, first[0], "element").orderBy("position").collect()
    top = {e.path: e for e in tree if e.position and "." not in e.path}
    raw, how = {}, {}
    for name, e in top.items():
        kind = "INT96" if e.type == "INT96" and int96_raw else e.converted_type or e.logical_type
        if kind in RAW or kind == "INT96":
            raw[name] = RAW.get(kind, "binary")
        if kind in ("TIME_MILLIS", "INTERVAL", "INT96") or (kind == "JSON" and parse_json) or (kind == "BSON" and bson):
            how[name] = kind
    schema = None
    if raw:  # inference would refuse the file, or read it otherwise
        system, inner = _open(first[0])
        with system.open_input_file(inner) as handle:
            arrow = pq.ParquetFile(handle).schema_arrow
        named = {f.name: raw.get(f.name) or WIDER.get(str(f.type)) or ("binary" if str(f.type).startswith("fixed_size_binary") else None) for f in arrow}
        schema = T.StructType([T.StructField(f.name, T._parse_datatype_string(named[f.name]) if named[f.name] else from_arrow_type(f.type), True) for f in arrow])
    if any("BYTE_STREAM_SPLIT" in c.encodings for c in chunks) or "INT96" in how.values():
        settings = spark
        spark = spark.newSession()
        for key in ("spark.sql.session.timeZone", "spark.sql.caseSensitive", "spark.sql.shuffle.partitions"):
            spark.conf.set(key, settings.conf.get(key))
        spark.conf.set("spark.sql.parquet.enableVectorizedReader", "false")
    df = scan(spark, path, schema=schema)
    df = df.select(*(logical.convert(F.col(f"`{c}`"), how.get(c)).alias(c) for c in df.columns))
    return project(df, columns)


def checked(spark: SparkSession, path: str) -> str:
    """path, if every file there starts and ends with the format's magic bytes."""
    bad = magic(spark, path).where(~(F.col("header_ok") & F.col("footer_ok"))).select("file").head(1)
    if bad:
        raise FormatError(f"{bad[0].file} isn't a file of this format")
    return path
