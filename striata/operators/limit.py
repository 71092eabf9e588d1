"""The first rows in file order: a top-k on (file, row), never a full sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.scan import scan, with_file_order


def first_rows(spark: SparkSession, path: str | list[str], limit: int = -1, columns: list[str] | None = None) -> DataFrame:
    """limit below 0: all rows, unordered beyond what the scan gives."""
    if limit < 0:
        return scan(spark, path, columns)
    df, order = with_file_order(spark, path, columns)
    return df.orderBy(*order).limit(limit).drop(*order)
