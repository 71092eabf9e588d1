"""The toolkit's scans as streams: new files of a folder, with the same projection rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.scan import project


def scan_stream(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Files that appear in path, as a stream; the schema is that of the files already there."""
    schema = spark.read.parquet(path).schema
    return project(spark.readStream.schema(schema).parquet(path), columns)
