"""python -m striata FILE: data as text, or metadata."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from .operators import sink
from .session import session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="striata", description="Print a columnar file's rows or metadata.")
    p.add_argument("file")
    p.add_argument("--metadata", action="store_true", help="file, key-value and schema metadata")
    p.add_argument("--row-group-metadata", action="store_true", help="with --metadata: row groups, column chunks and pages")
    p.add_argument("--no-data", action="store_true", help="no rows")
    p.add_argument("--limit", type=int, default=-1, help="rows in file order (below 0: all)")
    p.add_argument("--col", action="append", help="a column, or a dotted path; may be repeated")
    p.add_argument("--no-headers", action="store_true", help="no line of names (csv)")
    p.add_argument("--format", choices=sink.FORMATS, default="csv")
    p.add_argument("--debug", action="store_true", help="log more")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.debug else logging.WARNING)
    spark = spark or session()
    spark.sparkContext.setLogLevel("INFO" if args.debug else "ERROR")
    if args.metadata:
        sink.dump_metadata(spark, args.file, args.row_group_metadata)
    if not args.no_data:
        sink.dump(spark, args.file, args.format, args.limit, args.col, not args.no_headers)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
