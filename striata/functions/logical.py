"""Logical types as column expressions.

The format's meaning is the default. Two values that older readers of the format gave otherwise are offered as compat_*:
a decimal ten times as large, and a date counted from the proleptic ordinal 1 instead of 1970-01-01.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days from the proleptic ordinal 0 to 1970-01-01.
ORDINAL_EPOCH = 719_163


def decimal(unscaled: Column, scale: int, precision: int = 18) -> Column:
    """An unscaled integer as a decimal."""
    wide = unscaled.cast(f"decimal({precision},0)")
    return (wide * F.lit(f"1e-{scale}").cast(f"decimal({max(scale, 1)},{scale})")).cast(f"decimal({precision},{scale})") if scale else wide


def integer_of_bytes(value: Column) -> Column:
    """Big-endian two's complement bytes (up to 16) as decimal(38,0); empty is 0. A negative one is -(its inverted bits) - 1, which never leaves 16 bytes."""
    text = F.hex(value)
    negative = F.conv(F.substring(text, 1, 1), 16, 10).cast("int") >= 8
    bits = F.when(negative, F.translate(text, "0123456789ABCDEF", "FEDCBA9876543210")).otherwise(text)
    padded = F.lpad(bits, 32, "0")
    total = F.lit(0).cast("decimal(38,0)")
    for i in range(4):
        part = F.conv(F.substring(padded, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")
        total = (total * F.lit(2**32).cast("decimal(11,0)")).cast("decimal(38,0)") + part
    return F.when(F.octet_length(value) == 0, F.lit(0)).when(negative, F.lit(-1).cast("decimal(38,0)") - total).otherwise(total).cast("decimal(38,0)")


def decimal_of_bytes(value: Column, scale: int) -> Column:
    return decimal(integer_of_bytes(value), scale, 38)


def compat_decimal(value: Column, scale: int, precision: int = 18) -> Column:
    return (value * F.lit(10)).cast(f"decimal({precision},{scale})")


def date(days: Column) -> Column:
    return F.date_from_unix_date(days.cast("int"))


def compat_date(value: Column) -> Column:
    """value: a date; null where the ordinal would be below 1."""
    return F.when(F.unix_date(value) >= 1, F.date_sub(value, ORDINAL_EPOCH))


def time_millis(value: Column) -> Column:
    """Milliseconds since midnight as a day-time interval."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), value.cast("decimal(18,6)") / 1000)


def time_millis_micros(value: Column) -> Column:
    return value.cast("bigint") * 1000


def timestamp_millis(value: Column) -> Column:
    return F.timestamp_millis(value)


def utf8(value: Column) -> Column:
    """Strict: bytes that aren't UTF-8 are an error."""
    return F.decode(value, "UTF-8")


def unsigned(value: Column, bits: int) -> Column:
    """A signed value of 8, 16, 32 or 64 bits as unsigned; zero- and sign-extended values alike."""
    if bits == 64:
        span = F.lit(str(2**64)).cast("decimal(21,0)")
        return F.pmod(value.cast("decimal(21,0)"), span).cast("decimal(20,0)")
    return F.pmod(value.cast("bigint"), F.lit(2**bits).cast("bigint"))


def json_value(text: Column) -> Column:
    return F.parse_json(text)


def bson_value(value: Column) -> Column:
    """Documents as JSON text. Needs the optional package bson."""
    import bson  # noqa: F401
    import pandas as pd

    @F.pandas_udf("string")
    def decoded(s: pd.Series) -> pd.Series:
        import json

        return s.map(lambda b: None if b is None else json.dumps(bson.BSON(b).decode(), default=str))

    return decoded(value)


def _little(value: Column, start: int, n: int) -> Column:
    """n little-endian bytes from place start (1 first) as an unsigned decimal."""
    parts = F.concat(*(F.hex(F.substring(value, start + i, 1)) for i in range(n - 1, -1, -1)))
    return F.conv(parts, 16, 10).cast("decimal(38,0)")


def int96_raw(value: Column) -> Column:
    """12 bytes as the integer (first 8 bytes) * 2**32 + (last 4): nanoseconds of the day and Julian day."""
    return (_little(value, 1, 8) * F.lit(2**32).cast("decimal(11,0)") + _little(value, 9, 4)).cast("decimal(38,0)")


def interval_parts(value: Column) -> Column:
    """12 bytes as a struct of months, days and milliseconds."""
    return F.struct(*(_little(value, 4 * i + 1, 4).cast("bigint").alias(n) for i, n in enumerate(("months", "days", "millis"))))


def convert(value: Column, converted_type: str | None, scale: int = 0, precision: int = 18) -> Column:
    """By the name of a converted type; unknown ones pass through. Nulls stay null."""
    simple = {"DATE": date, "TIME_MILLIS": time_millis, "TIMESTAMP_MILLIS": timestamp_millis, "UTF8": utf8, "JSON": json_value, "BSON": bson_value, "INTERVAL": interval_parts}
    if converted_type == "DECIMAL":
        return decimal(value, scale, precision)
    if converted_type == "DECIMAL_BYTES":
        return decimal_of_bytes(value, scale)
    if converted_type == "INT96":
        return int96_raw(value)
    if converted_type and converted_type.startswith("UINT_"):
        return unsigned(value, int(converted_type[5:]))
    return simple[converted_type](value) if converted_type in simple else value
