"""Text sinks: tab-separated values and JSON lines, rendered on the executors."""

from __future__ import annotations

import sys
from typing import TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.logical import utf8
from ..sources.scan import scan
from .limit import first_rows

FORMATS = ("csv", "json")
#: Tabs; a quote is ', doubled within; null and empty are empty; blanks are kept.
TSV = {"sep": "\t", "quote": "'", "escape": "'", "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _text(df: DataFrame) -> DataFrame:
    """Bytes as UTF-8 text; bytes that aren't UTF-8 are an error."""
    return df.select(*(utf8(F.col(f"`{c}`")).alias(c) if kind == "binary" else F.col(f"`{c}`") for c, kind in df.dtypes))


def lines(df: DataFrame, fmt: str) -> DataFrame:
    """One column, line. JSON keeps nulls."""
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r}: one of {', '.join(FORMATS)}")
    df = _text(df)
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    line: Column = F.to_csv(whole, TSV) if fmt == "csv" else F.to_json(whole, {"ignoreNullFields": "false"})
    return df.select(line.alias("line"))


def write(df: DataFrame, path: str, fmt: str, header: bool = True) -> None:
    """Files in a folder, a task each."""
    if fmt == "csv":
        _text(df).write.options(**TSV).option("header", str(header).lower()).csv(path)
    elif fmt == "json":
        _text(df).write.option("ignoreNullFields", "false").json(path)
    else:
        raise ValueError(f"format {fmt!r}: one of {', '.join(FORMATS)}")


def dump(spark, path: str, fmt: str = "csv", limit: int = -1, columns: list[str] | None = None, header: bool = True, out: TextIO | None = None) -> None:
    """Text to out. The header comes with the first row only: no rows, no header; limit 0 of some rows gives it alone."""
    out = out or sys.stdout
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r}: one of {', '.join(FORMATS)}")
    df = first_rows(spark, path, limit, columns)
    names = "\t".join(df.columns)
    if limit == 0:
        if fmt == "csv" and header and not scan(spark, path).isEmpty():
            out.write(names + "\r\n")
        return
    end = "\r\n" if fmt == "csv" else "\n"
    for i, row in enumerate(lines(df, fmt).toLocalIterator()):
        if not i and fmt == "csv" and header:
            out.write(names + "\r\n")
        out.write((row.line if row.line or len(df.columns) > 1 else "''") + end)


def dump_metadata(spark, path: str, row_groups: bool = False, out: TextIO | None = None) -> None:
    """Levels file, kv and element (the schema tree) as text; with row_groups also row_group, chunk and page."""
    from ..sources.colmeta import metadata

    out = out or sys.stdout
    for level in ("file", "kv", "element", *(("row_group", "chunk", "page") if row_groups else ())):
        df = metadata(spark, path, level)
        out.write(f"{level}\n")
        found = False
        for row in df.toLocalIterator():
            found = True
            out.write("  " + ", ".join(f"{k}={v}" for k, v in row.asDict().items() if k != "file" or level == "file") + "\n")
        if not found:
            out.write("  (none)\n")


def write_columnar(df: DataFrame, path: str, schema, **options) -> None:
    """Files of df in the folder path, a task each, with the types and annotations of an Arrow schema (by position) and pyarrow's writer options.

    For what Spark's writer can't write: times, unsigned numbers, single encodings, page versions.
    """
    import uuid

    import pyarrow as pa
    import pyarrow.parquet as pq

    from ..sources.colmeta import _open

    def run(batches):
        table = pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, names=schema.names) for b in batches] or [], schema=None) if (batches := list(batches)) else None
        if table is not None and table.num_rows:
            system, inner = _open(path)
            system.create_dir(inner, recursive=True)
            with system.open_output_stream(f"{inner}/part-{uuid.uuid4().hex}.parquet") as out:
                pq.write_table(table.cast(schema), out, **options)
        yield pa.RecordBatch.from_arrays([pa.array([0 if table is None else table.num_rows], pa.int64())], names=["n"])

    df.mapInArrow(run, "n long").agg(F.sum("n")).collect()
