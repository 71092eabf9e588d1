"""Files with annotations, codecs, encodings and nulls that the shared tables don't have, written from them for the queries that read them back."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sink import write_columnar


def place(spark: SparkSession) -> str:
    """A new folder in the warehouse."""
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_fixtures/{uuid.uuid4().hex}"


def columnar(df: DataFrame, schema: pa.Schema, **options) -> str:
    """The folder in which df is written by pyarrow."""
    path = place(df.sparkSession)
    write_columnar(df, path, schema, **options)
    return path


def by_spark(df: DataFrame, **options) -> str:
    path = place(df.sparkSession)
    df.write.options(**options).parquet(path)
    return path


def some(value, key: str = "o_orderkey"):
    """value, but null for each third key."""
    return F.when(F.col(key) % 3 != 0, value)


ANNOTATED = pa.schema([
    ("o_orderkey", pa.int64()), ("d", pa.date32()), ("t", pa.time32("ms")), ("u8", pa.uint8()), ("u16", pa.uint16()), ("u32", pa.uint32()), ("u64", pa.uint64()), ("amount", pa.decimal128(38, 2)), ("at", pa.timestamp("ms")),
])


def annotated(orders: DataFrame) -> str:
    """DATE, TIME_MILLIS, UINT_8 to UINT_64, DECIMAL in 16 bytes (negative), TIMESTAMP_MILLIS; nulls in all of them."""
    k = F.col("o_orderkey")
    big = F.lit("18446744073709551615").cast("decimal(20,0)") - k.cast("decimal(20,0)")
    return columnar(
        orders.select(
            k, some(F.unix_date(F.col("o_orderdate").cast("date"))), some((k * 7919 % 86_400_000).cast("int")), some(k % 256), some(k % 65536), some(F.lit(4294967295) - k), some(big.cast("decimal(20,0)")),
            some((-(k * 100 + 7) / 100).cast("decimal(38,2)")), some(k * 1_000_003),
        ),
        ANNOTATED,
    )
