"""The driver's queries, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encodings, logical
from ..operators import limit, sink
from ..session import configured
from ..sources import colmeta, scan
from . import fixtures

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, d: str, name: str, columns: list[str] | None = None) -> DataFrame:
    return scan.scan(spark, f"{d}/{name}.parquet", columns)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return sink.lines(limit.first_rows(configured(spark), f"{d}/nation.parquet", 10, ["n_name", "n_nationkey"]), "json")


def _days(table: DataFrame) -> DataFrame:
    return table.select("o_orderkey", F.unix_date(F.col("o_orderdate").cast("date")).alias("days"))


def _unscaled(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "orders", ["o_orderkey", "o_totalprice"]).select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("x"))


def _meta(level: str, drop: tuple[str, ...] = ("file",)) -> Query:
    return lambda s, d: colmeta.metadata(s, f"{d}/nation.parquet", level).drop(*drop)


def _little(value, n: int):
    """The lowest n bytes of a bigint, lowest first."""
    text = F.lpad(F.hex(value), 16, "0")
    return F.unhex(F.concat(*(F.substring(text, i, 2) for i in range(15, 15 - 2 * n, -2))))


def _varint(column: str):
    """The 64 bits of a bigint in groups of seven, lowest first, as many as it has (a negative one: ten); all but the last have the highest bit set."""
    rest = lambda i: F.shiftrightunsigned(column, 7 * i) if i < 10 else F.lit(0)
    groups = [F.when((rest(i) != 0) | F.lit(i == 0), F.lpad(F.hex(rest(i).bitwiseAND(127) + F.when(rest(i + 1) != 0, 128).otherwise(0)), 2, "0")) for i in range(10)]
    return F.when(F.col(column).isNotNull(), F.unhex(F.concat_ws("", *groups)))


def _values(s: SparkSession, path: str, column: str, value, *more: str) -> DataFrame:
    return colmeta.numbered(s, path, column).select("entry", *more, (F.col(value) if isinstance(value, str) else value).alias("v"))


_NULLS = pa.schema([("l_orderkey", pa.int64()), ("l_linenumber", pa.int32()), ("q", pa.float64()), ("flag", pa.string())])


def _with_nulls(s: SparkSession, d: str) -> DataFrame:
    even = F.col("l_linenumber") % 2 == 0
    return _read(s, d, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]).select("l_orderkey", "l_linenumber", F.when(even, F.col("l_quantity")), F.when(~even, F.col("l_returnflag")))


def _nulls(s: SparkSession, d: str, **options) -> DataFrame:
    """Rows put together again from the values of pages with nulls."""
    values = colmeta.metadata(s, fixtures.columnar(_with_nulls(s, d), _NULLS, **options), "value")
    pick = lambda name, kind: F.max(F.when(F.col("path") == name, F.col(kind))).alias(name)
    rows = values.groupBy("file", "row_group", "entry").agg(pick("l_orderkey", "integer"), pick("l_linenumber", "integer"), pick("q", "number"), pick("flag", "bytes"))
    return rows.select("l_orderkey", "l_linenumber", "q", F.col("flag").cast("string").alias("flag"))


def _written_types(s: SparkSession, d: str) -> DataFrame:
    """Truth values, INT96 and fixed-length bytes, from their pages."""
    s.conf.set("spark.sql.parquet.outputTimestampType", "INT96")
    s.conf.set("spark.sql.parquet.writeLegacyFormat", "true")
    events = _read(s, d, "events", ["event_id", "ts"])
    path = fixtures.by_spark(events.select("event_id", (F.col("event_id") % 2 == 0).alias("even"), F.col("ts").cast("timestamp").alias("ts"), (-F.col("event_id")).cast("decimal(25,3)").alias("less")))
    values = colmeta.metadata(s, path, "value")
    pick = lambda name, kind: F.max(F.when(F.col("path") == name, F.col(kind))).alias(name)
    rows = values.groupBy("file", "row_group", "entry").agg(pick("event_id", "integer"), pick("even", "integer"), pick("ts", "int96"), pick("less", "bytes"))
    return rows.select("event_id", "even", "ts", logical.decimal_of_bytes(F.col("less"), 3).cast("decimal(25,3)").alias("less"))


def _annotated(s: SparkSession, d: str) -> DataFrame:
    rows = scan.decoded(s, fixtures.annotated(_read(s, d, "orders", ["o_orderkey", "o_orderdate"])))
    micros = F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp") + F.col("t"))
    return rows.select("o_orderkey", F.col("d").cast("string").alias("d"), micros.alias("t_us"), *(F.col(c).cast("bigint").alias(c) for c in ("u8", "u16", "u32")), "u64", "amount", F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"))


def _int96_file(s: SparkSession, d: str) -> DataFrame:
    s.conf.set("spark.sql.parquet.outputTimestampType", "INT96")
    path = fixtures.by_spark(_read(s, d, "events", ["event_id", "ts"]).select("event_id", F.col("ts").cast("timestamp").alias("ts")))
    return scan.decoded(s, path, int96_raw=True).select("event_id", F.col("ts").alias("v"))


def _codecs(s: SparkSession, d: str) -> DataFrame:
    out = None
    for codec in ("none", "gzip", "zstd", "lz4_raw", "snappy"):
        part = scan.decoded(s, fixtures.by_spark(_read(s, d, "region"), compression=codec)).select(F.lit(codec).alias("codec"), "*")
        out = part if out is None else out.union(part)
    return out


def _encodings(s: SparkSession, d: str) -> DataFrame:
    """DELTA_*, BYTE_STREAM_SPLIT and RLE columns in pages of version 2."""
    rows = _read(s, d, "orders", ["o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus"]).select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus", F.col("o_orderkey") % 2 == 0)
    schema = pa.schema([("o_orderkey", pa.int64()), ("o_totalprice", pa.float64()), ("o_orderpriority", pa.string()), ("o_orderstatus", pa.string()), ("even", pa.bool_())])
    how = {"o_orderkey": "DELTA_BINARY_PACKED", "o_totalprice": "BYTE_STREAM_SPLIT", "o_orderpriority": "DELTA_LENGTH_BYTE_ARRAY", "o_orderstatus": "DELTA_BYTE_ARRAY", "even": "RLE"}
    return scan.decoded(s, fixtures.columnar(rows, schema, use_dictionary=False, column_encoding=how, data_page_version="2.0"))


def _quoted(s: SparkSession, d: str) -> DataFrame:
    """Nulls, empty text, tabs and quotes."""
    k = F.col("n_nationkey")
    text = F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 == 1, "").when(k % 5 == 2, F.concat(F.lit("it's "), "n_name")).when(k % 5 == 3, F.concat("n_name", F.lit("\t|"))).otherwise(F.concat(F.lit("  "), "n_name"))
    return _read(s, d, "nation").select("n_nationkey", text.alias("t"), F.encode("n_name", "UTF-8").alias("b"))


def _printed(s: SparkSession, arguments: list[str]) -> DataFrame:
    """What the command line prints, by line."""
    import contextlib
    import io

    from ..__main__ import main

    level = s.sparkContext._jvm.org.apache.logging.log4j.LogManager.getRootLogger().getLevel().toString()
    with contextlib.redirect_stdout(io.StringIO()) as out:
        main(arguments, s)
    s.sparkContext.setLogLevel(level)
    return s.createDataFrame(list(enumerate(out.getvalue().replace("\r\n", "\n").splitlines())), "place int, line string")


def _sink_files(s: SparkSession, d: str) -> DataFrame:
    """What the file sinks wrote, read back line by line."""
    out = None
    for fmt in sink.FORMATS:
        path = fixtures.place(s)
        sink.write(_read(s, d, "region").coalesce(1), path, fmt)
        part = s.read.text(path).select(F.lit(fmt).alias("format"), F.col("value").alias("line"))
        out = part if out is None else out.union(part)
    return out


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {f"scan_all_{t}": (lambda s, d, t=t: _read(s, d, t)) for t in TABLES}
    keys = lambda s, d: _read(s, d, "orders", ["o_orderkey"])
    ts = lambda s, d: _read(s, d, "events", ["event_id", "ts"]).select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    out |= {
        "project_reorder": lambda s, d: _read(s, d, "nation", ["n_name", "n_nationkey"]),
        "project_all_empty": lambda s, d: _read(s, d, "region", []),
        "limit_ordered": lambda s, d: limit.first_rows(s, f"{d}/nation.parquet", 7),
        "ct_date_spec": lambda s, d: _days(_read(s, d, "orders")).select("o_orderkey", logical.date(F.col("days")).cast("string").alias("v")),
        "ct_date_ordinal_compat": lambda s, d: _days(_read(s, d, "orders")).select("o_orderkey", logical.compat_date(logical.date(F.col("days"))).cast("string").alias("v")),
        "ct_decimal_spec": lambda s, d: _unscaled(s, d).select("o_orderkey", logical.decimal(F.col("x"), 2).alias("v")),
        "ct_decimal_compat": lambda s, d: _unscaled(s, d).select("o_orderkey", logical.compat_decimal(logical.decimal(F.col("x"), 2), 2).alias("v")),
        "ct_decimal_bytes": lambda s, d: _unscaled(s, d).select("o_orderkey", logical.decimal_of_bytes(F.unhex(F.lpad(F.hex("x"), 16, "0")), 2).cast("decimal(18,2)").alias("v")),
        **{f"ct_uint{b}": (lambda s, d, b=b: keys(s, d).select("o_orderkey", logical.unsigned(-F.col("o_orderkey"), b).alias("v"))) for b in (8, 16, 32, 64)},
        "ct_time_millis_us": lambda s, d: ts(s, d).select("event_id", logical.time_millis_micros(F.col("ms") % 86_400_000).alias("v")),
        "ct_timestamp_millis": lambda s, d: ts(s, d).select("event_id", F.unix_micros(logical.timestamp_millis(F.col("ms"))).alias("v")),
        "ct_utf8": lambda s, d: _read(s, d, "documents", ["doc_id", "text"]).select("doc_id", logical.utf8(F.encode("text", "UTF-8")).alias("v")),
        "ct_json": lambda s, d: _read(s, d, "events", ["event_id", "props"]).select("event_id", F.variant_get(logical.json_value(F.col("props")), "$.k", "int").alias("v")),
        "ct_int96_raw": lambda s, d: keys(s, d).select("o_orderkey", logical.int96_raw(F.unhex(F.concat(*(F.substring(F.lpad(F.hex("o_orderkey"), 16, "0"), i, 2) for i in range(15, 0, -2)), F.lit("03000000")))).alias("v")),
        "enc_bit_width": lambda s, d: keys(s, d).select("o_orderkey", encodings.bit_width_of(F.col("o_orderkey")).alias("v")),
        "enc_plain_int64": lambda s, d: keys(s, d).select("o_orderkey", encodings.decode_plain(_little("o_orderkey", 8), "INT64", 1)[0].alias("v")),
        "enc_plain_int32": lambda s, d: keys(s, d).select("o_orderkey", encodings.decode_plain(_little(-F.col("o_orderkey"), 4), "INT32", 1)[0].alias("v")),
        "enc_plain_int96": lambda s, d: keys(s, d).select("o_orderkey", encodings.decode_plain(F.concat(_little("o_orderkey", 8), F.unhex(F.lit("03000000"))), "INT96", 1)[0].cast("decimal(38,0)").alias("v")),
        "enc_plain_boolean": lambda s, d: keys(s, d).select("o_orderkey", F.array_join(F.transform(encodings.decode_plain(_little("o_orderkey", 1), "BOOLEAN", 8), lambda x: x.cast("int").cast("string")), "").alias("v")),
        "enc_plain_bytes": lambda s, d: _read(s, d, "nation", ["n_nationkey", "n_name"]).select("n_nationkey", encodings.decode_plain(F.concat(_little(F.octet_length("n_name").cast("bigint"), 4), F.encode("n_name", "UTF-8")), "BYTE_ARRAY", 1)[0].cast("string").alias("v")),
        "enc_plain_fixed": lambda s, d: _read(s, d, "nation", ["n_nationkey", "n_name"]).select("n_nationkey", encodings.decode_plain(F.encode("n_name", "UTF-8"), "FIXED_LEN_BYTE_ARRAY", 2, 3)[1].cast("string").alias("v")),
        "enc_varint": lambda s, d: keys(s, d).select("o_orderkey", encodings.decode_varint(_varint("o_orderkey")).alias("v")),
        "enc_run": lambda s, d: keys(s, d).select("o_orderkey", F.array_join(encodings.decode_run(_little("o_orderkey", 2), 6, 16), ",").alias("v")),
        "enc_bit_packed": lambda s, d: keys(s, d).select("o_orderkey", F.array_join(encodings.decode_bit_packed(_little("o_orderkey", 3), 8, 3), "").alias("v")),
        "enc_bit_packed_high": lambda s, d: keys(s, d).select("o_orderkey", F.array_join(encodings.decode_bit_packed(F.unhex(F.lpad(F.hex("o_orderkey"), 8, "0")), 8, 4, high=True), ",").alias("v")),
        "enc_hybrid": lambda s, d: keys(s, d).select("o_orderkey", F.array_join(encodings.decode_hybrid(F.concat(F.unhex(F.lit("0A")), _little(F.col("o_orderkey") % 8, 1), F.unhex(F.lit("03")), _little("o_orderkey", 3)), 3), "").alias("v")),
        "enc_mask": lambda s, d: keys(s, d).select("o_orderkey", encodings.mask_of(F.col("o_orderkey") % 40).alias("v")),
        # values of real pages, by the byte-level decoders: dictionary and plain pages, levels, all physical types
        "page_int64": lambda s, d: _values(s, f"{d}/orders.parquet", "o_orderkey", "integer"),
        "page_int32": lambda s, d: _values(s, f"{d}/labels.parquet", "toxic", "integer"),
        "page_double": lambda s, d: _values(s, f"{d}/orders.parquet", "o_totalprice", "number"),
        "page_bytes": lambda s, d: _values(s, f"{d}/customer.parquet", "c_name", F.col("bytes").cast("string")),
        "page_float_nested": lambda s, d: _values(s, f"{d}/embeddings.parquet", "embedding.list.element", "number", "repetition_level"),
        "page_boolean_int96_fixed": _written_types,
        "page_nulls_plain": lambda s, d: _nulls(s, d, use_dictionary=False),
        "page_nulls_dictionary": lambda s, d: _nulls(s, d, use_dictionary=True, data_page_version="2.0"),
        "null_merge_plain": lambda s, d: scan.scan(s, fixtures.columnar(_with_nulls(s, d), _NULLS, use_dictionary=False)),
        "null_merge_dictionary": lambda s, d: scan.scan(s, fixtures.columnar(_with_nulls(s, d), _NULLS)),
        "null_count": lambda s, d: colmeta.metadata(s, fixtures.columnar(_with_nulls(s, d), _NULLS), "chunk").groupBy("path").agg(F.sum("null_count").alias("nulls")),
        # files of every annotation, codec and encoding that can be written here
        "ct_annotated_file": _annotated,
        "ct_int96_file": _int96_file,
        "ct_json_file": lambda s, d: scan.decoded(s, fixtures.columnar(_read(s, d, "events", ["event_id", "props"]), pa.schema([("event_id", pa.int64()), ("props", pa.json_())])), parse_json=True).select("event_id", F.variant_get("props", "$.k", "int").alias("v")),
        "scan_codecs": _codecs,
        "scan_encodings": _encodings,
        "scan_dotted": lambda s, d: scan.scan(s, fixtures.by_spark(_read(s, d, "nation").select(F.struct("n_nationkey", F.struct("n_name").alias("b")).alias("a"))), ["a.b.n_name", "a.n_nationkey"]),
        "scan_flattened": lambda s, d: scan.scan(s, fixtures.by_spark(_read(s, d, "nation").select(F.struct("n_nationkey", F.struct("n_name").alias("b")).alias("a"))), flatten=True),
        "project_duplicate": lambda s, d: _read(s, d, "nation", ["n_name", "n_name", "n_nationkey"]).toDF("n_name", "again", "n_nationkey"),
        "sink_tsv_quotes": lambda s, d: sink.lines(_quoted(s, d), "csv"),
        "sink_json_nulls": lambda s, d: sink.lines(_quoted(s, d), "json"),
        "sink_files": _sink_files,
        "sink_tsv": lambda s, d: sink.lines(_read(s, d, "nation"), "csv"),
        "sink_json": lambda s, d: sink.lines(_read(s, d, "nation"), "json"),
        "meta_magic": _meta("magic"),
        "meta_file": _meta("file", ("file", "version")),
        "meta_kv": _meta("kv"),
        "meta_element": _meta("element", ("file", "path", "logical_type", "max_definition_level", "max_repetition_level")),
        "meta_element_nested": lambda s, d: colmeta.metadata(s, f"{d}/embeddings.parquet", "element").select("name", "type", "repetition", "num_children", "converted_type", "max_definition_level", "max_repetition_level"),
        "meta_schema": _meta("schema", ("file", "logical_type")),
        "meta_row_group": _meta("row_group"),
        "meta_chunk": _meta("chunk"),
        "meta_page": _meta("page"),
        "meta_page_counts": lambda s, d: colmeta.metadata(s, f"{d}/lineitem.parquet", "page").groupBy("path", "page_type", "value_encoding").agg(F.count("*").alias("pages")),
        "cli_csv": lambda s, d: _printed(s, [f"{d}/nation.parquet", "--col", "n_name", "--col", "n_nationkey", "--limit", "5"]),
        "cli_no_headers": lambda s, d: _printed(s, [f"{d}/region.parquet", "--no-headers"]),
        "cli_json": lambda s, d: _printed(s, [f"{d}/nation.parquet", "--format", "json", "--limit", "3"]),
    }
    return {name: (lambda s, d, f=f: f(configured(s), d)) for name, f in out.items()}


#: The metadata functions of the oracle take a path, not a view: that of the folder in which the driver compares.
_NATION = "/root/testdata/sf0.01/nation.parquet"
_third = "CASE WHEN o_orderkey % 3 <> 0 THEN "
_int96 = "CAST((epoch_us(ts) % 86400000000 * 1000)::HUGEINT * 4294967296 + epoch_us(ts) // 86400000000 + 2440588 AS DECIMAL(38,0))"
_packed3 = "concat(" + ", ".join(f"(o_orderkey >> {3 * i}) & 7" for i in range(8)) + ")"


def _quoted_text(fmt: str) -> str:
    """The text column of _quoted; in csv with its quotes."""
    q = "chr(39)"
    its, tab = (f"{q} || 'it' || {q} || {q} || 's ' || n_name || {q}", f"{q} || n_name || chr(9) || '|' || {q}") if fmt == "csv" else (f"'it' || {q} || 's ' || n_name", "n_name || chr(9) || '|'")
    none = "chr(65)[:0]" if fmt == "csv" else "NULL"
    return f"CASE n_nationkey % 5 WHEN 0 THEN {none} WHEN 1 THEN chr(65)[:0] WHEN 2 THEN {its} WHEN 3 THEN {tab} ELSE '  ' || n_name END"


def oracle_sql() -> dict[str, str]:
    modulus = lambda m: f"SELECT o_orderkey, ((-o_orderkey) % {m} + {m}) % {m} AS v FROM orders"
    return {f"scan_all_{t}": f"SELECT * FROM {t}" for t in TABLES} | {
        "project_reorder": "SELECT n_name, n_nationkey FROM nation",
        "project_all_empty": "SELECT * FROM region",
        "limit_ordered": "SELECT * FROM nation ORDER BY n_nationkey LIMIT 7",
        **{q: "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS q, CASE WHEN l_linenumber % 2 <> 0 THEN l_returnflag END AS flag FROM lineitem" for q in ("page_nulls_plain", "page_nulls_dictionary", "null_merge_plain", "null_merge_dictionary")},
        "null_count": "SELECT 'l_orderkey' AS path, 0::BIGINT AS nulls UNION ALL SELECT 'l_linenumber', 0 UNION ALL SELECT 'q', count(*) FILTER (l_linenumber % 2 <> 0) FROM lineitem UNION ALL SELECT 'flag', count(*) FILTER (l_linenumber % 2 = 0) FROM lineitem",
        "ct_date_spec": "SELECT o_orderkey, strftime(o_orderdate::DATE, '%Y-%m-%d') AS v FROM orders",
        "ct_date_ordinal_compat": "SELECT o_orderkey, strftime(o_orderdate::DATE - 719163, '%Y-%m-%d') AS v FROM orders",
        "ct_decimal_spec": "SELECT o_orderkey, CAST(round(o_totalprice * 100) / 100.0 AS DECIMAL(18,2)) AS v FROM orders",
        "ct_decimal_compat": "SELECT o_orderkey, CAST(round(o_totalprice * 100) / 10.0 AS DECIMAL(18,2)) AS v FROM orders",
        "ct_decimal_bytes": "SELECT o_orderkey, CAST(round(o_totalprice * 100) / 100.0 AS DECIMAL(18,2)) AS v FROM orders",
        "ct_uint8": modulus(256),
        "ct_uint16": modulus(65536),
        "ct_uint32": modulus(4294967296),
        "ct_uint64": "SELECT o_orderkey, CAST((18446744073709551616::HUGEINT - o_orderkey) % 18446744073709551616::HUGEINT AS DECIMAL(20,0)) AS v FROM orders",
        "ct_time_millis_us": "SELECT event_id, (epoch_us(ts) // 1000 % 86400000) * 1000 AS v FROM events",
        "ct_timestamp_millis": "SELECT event_id, epoch_us(date_trunc('millisecond', ts)) AS v FROM events",
        "ct_utf8": "SELECT doc_id, text AS v FROM documents",
        "ct_json": "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS v FROM events",
        "ct_int96_raw": "SELECT o_orderkey, CAST(o_orderkey::HUGEINT * 4294967296 + 3 AS DECIMAL(38,0)) AS v FROM orders",
        "enc_bit_width": "SELECT o_orderkey, CASE WHEN o_orderkey = 0 THEN 0 ELSE length(bin(o_orderkey)) END AS v FROM orders",
        "enc_plain_int64": "SELECT o_orderkey, o_orderkey AS v FROM orders",
        "enc_plain_int32": "SELECT o_orderkey, CAST(-o_orderkey AS INTEGER) AS v FROM orders",
        "enc_plain_int96": "SELECT o_orderkey, CAST(o_orderkey::HUGEINT * 4294967296 + 3 AS DECIMAL(38,0)) AS v FROM orders",
        "enc_plain_boolean": "SELECT o_orderkey, reverse(lpad(bin(o_orderkey & 255), 8, '0')) AS v FROM orders",
        "enc_plain_bytes": "SELECT n_nationkey, n_name AS v FROM nation",
        "enc_plain_fixed": "SELECT n_nationkey, substring(n_name, 4, 3) AS v FROM nation",
        "enc_varint": "SELECT o_orderkey, o_orderkey AS v FROM orders",
        "enc_run": "SELECT o_orderkey, concat_ws(',', o_orderkey & 65535, o_orderkey & 65535, o_orderkey & 65535) AS v FROM orders",
        "enc_bit_packed": f"SELECT o_orderkey, {_packed3} AS v FROM orders",
        "enc_bit_packed_high": "SELECT o_orderkey, " + "concat_ws(',', " + ", ".join(f"(o_orderkey >> {4 * i}) & 15" for i in range(7, -1, -1)) + ") AS v FROM orders",
        "enc_hybrid": f"SELECT o_orderkey, repeat((o_orderkey % 8)::VARCHAR, 5) || {_packed3} AS v FROM orders",
        "enc_mask": "SELECT o_orderkey, (1::BIGINT << (o_orderkey % 40)::INTEGER) - 1 AS v FROM orders",
        "page_int64": "SELECT row_number() OVER () - 1 AS entry, o_orderkey AS v FROM orders",
        "page_int32": "SELECT row_number() OVER () - 1 AS entry, CAST(toxic AS BIGINT) AS v FROM labels",
        "page_double": "SELECT row_number() OVER () - 1 AS entry, o_totalprice AS v FROM orders",
        "page_bytes": "SELECT row_number() OVER () - 1 AS entry, c_name AS v FROM customer",
        "page_float_nested": "SELECT row_number() OVER (ORDER BY r, i) - 1 AS entry, CAST(i > 1 AS INTEGER) AS repetition_level, CAST(e[i] AS DOUBLE) AS v FROM (SELECT r, e, unnest(range(1, len(e) + 1)) AS i FROM (SELECT row_number() OVER () AS r, embedding AS e FROM embeddings))",
        "page_boolean_int96_fixed": f"SELECT event_id, CAST(event_id % 2 = 0 AS BIGINT) AS even, {_int96} AS ts, CAST(-event_id AS DECIMAL(25,3)) AS less FROM events",
        "ct_annotated_file": f"SELECT o_orderkey, {_third}strftime(o_orderdate::DATE, '%Y-%m-%d') END AS d, {_third}o_orderkey * 7919 % 86400000 * 1000 END AS t_us, {_third}o_orderkey % 256 END AS u8, {_third}o_orderkey % 65536 END AS u16, {_third}4294967295 - o_orderkey END AS u32, {_third}CAST(18446744073709551615::HUGEINT - o_orderkey AS DECIMAL(20,0)) END AS u64, {_third}CAST(CAST(-(o_orderkey * 100 + 7) AS DECIMAL(20,0)) / 100 AS DECIMAL(38,2)) END AS amount, {_third}o_orderkey * 1000003 * 1000 END AS at_us FROM orders",
        "ct_int96_file": f"SELECT event_id, {_int96} AS v FROM events",
        "ct_json_file": "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS v FROM events",
        "scan_codecs": "SELECT codec, region.* FROM region, (SELECT unnest(['none', 'gzip', 'zstd', 'lz4_raw', 'snappy']) AS codec)",
        "scan_encodings": "SELECT o_orderkey, o_totalprice, o_orderpriority, o_orderstatus, o_orderkey % 2 = 0 AS even FROM orders",
        "scan_dotted": "SELECT n_name AS \"a.b.n_name\", n_nationkey AS \"a.n_nationkey\" FROM nation",
        "scan_flattened": "SELECT n_nationkey AS \"a.n_nationkey\", n_name AS \"a.b.n_name\" FROM nation",
        "project_duplicate": "SELECT n_name, n_name AS again, n_nationkey FROM nation",
        "sink_tsv_quotes": f"SELECT concat(n_nationkey, chr(9), {_quoted_text('csv')}, chr(9), n_name) AS line FROM nation",
        "sink_json_nulls": f"SELECT CAST(to_json({{'n_nationkey': n_nationkey, 't': {_quoted_text('json')}, 'b': n_name}}) AS VARCHAR) AS line FROM nation",
        "sink_files": "SELECT 'csv' AS format, concat_ws(chr(9), r_regionkey, r_name) AS line FROM region UNION ALL SELECT 'csv', concat_ws(chr(9), 'r_regionkey', 'r_name') UNION ALL SELECT 'json', CAST(to_json({'r_regionkey': r_regionkey, 'r_name': r_name}) AS VARCHAR) FROM region",
        "sink_tsv": "SELECT concat_ws(chr(9), n_nationkey, n_name, n_regionkey) AS line FROM nation",
        "sink_json": "SELECT CAST(to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey}) AS VARCHAR) AS line FROM nation",
        "meta_file": f"SELECT created_by, num_rows, CAST(num_row_groups AS INTEGER) AS num_row_groups, CAST((SELECT count(*) FROM parquet_metadata('{_NATION}') WHERE row_group_id = 0) AS INTEGER) AS num_columns, footer_size FROM parquet_file_metadata('{_NATION}')",
        "meta_row_group": f"SELECT CAST(row_group_id AS INTEGER) AS row_group, max(row_group_num_rows) AS num_rows, max(row_group_bytes) AS total_byte_size, CAST(count(*) AS INTEGER) AS num_columns FROM parquet_metadata('{_NATION}') GROUP BY row_group_id",
        "meta_chunk": f"SELECT CAST(row_group_id AS INTEGER) AS row_group, CAST(column_id AS INTEGER) AS \"column\", path_in_schema AS path, type AS physical_type, compression AS codec, encodings, num_values, stats_null_count AS null_count, total_uncompressed_size AS uncompressed_bytes, total_compressed_size AS compressed_bytes, data_page_offset, dictionary_page_offset, least(data_page_offset, dictionary_page_offset) AS start_offset FROM parquet_metadata('{_NATION}')",
        "meta_page_counts": f"SELECT path, e.page_type AS page_type, e.encoding AS value_encoding, sum(e.count)::BIGINT AS pages FROM (SELECT path_in_schema AS path, unnest(encoding_stats) AS e FROM parquet_metadata('{_NATION.replace('nation', 'lineitem')}')) GROUP BY ALL",
        "cli_csv": "SELECT 0 AS place, concat_ws(chr(9), 'n_name', 'n_nationkey') AS line UNION ALL SELECT CAST(n_nationkey + 1 AS INTEGER), concat_ws(chr(9), n_name, n_nationkey) FROM nation WHERE n_nationkey < 5",
        "cli_no_headers": "SELECT CAST(r_regionkey AS INTEGER) AS place, concat_ws(chr(9), r_regionkey, r_name) AS line FROM region",
        "cli_json": "SELECT CAST(n_nationkey AS INTEGER) AS place, CAST(to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey}) AS VARCHAR) AS line FROM nation WHERE n_nationkey < 3",
        "meta_magic": f"SELECT true AS header_ok, true AS footer_ok, footer_size FROM parquet_file_metadata('{_NATION}')",
        "meta_kv": f"SELECT decode(key) AS key, decode(value) AS value FROM parquet_kv_metadata('{_NATION}')",
        "meta_element": f"SELECT CAST(column_id AS INTEGER) AS position, name, type, CAST(type_length AS INTEGER) AS type_length, repetition_type AS repetition, CAST(num_children AS INTEGER) AS num_children, converted_type, CAST(scale AS INTEGER) AS scale, CAST(precision AS INTEGER) AS precision FROM parquet_schema('{_NATION}')",
        "meta_element_nested": f"SELECT name, type, repetition_type AS repetition, CAST(num_children AS INTEGER) AS num_children, converted_type, CAST(CASE name WHEN 'schema' THEN 0 WHEN 'list' THEN 2 WHEN 'element' THEN 3 ELSE 1 END AS INTEGER) AS max_definition_level, CAST(name IN ('list', 'element') AS INTEGER) AS max_repetition_level FROM parquet_schema('{_NATION.replace('nation', 'embeddings')}')",
        "meta_schema": f"SELECT CAST(column_id - 1 AS INTEGER) AS position, name AS path, name, type AS physical_type, CAST(type_length AS INTEGER) AS type_length, converted_type, repetition_type AS repetition, 1 AS max_definition_level, 0 AS max_repetition_level FROM parquet_schema('{_NATION}') WHERE column_id > 0",
    }
