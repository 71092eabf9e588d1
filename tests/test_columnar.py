"""Scans, logical types, decoders, metadata, sinks and the command line."""

import datetime as dt
import decimal
import io
import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from striata.functions import encodings as enc
from striata.functions import logical
from striata.operators import limit, sink
from striata.sources import colmeta, footer, scan

NATION = pa.table({"n_nationkey": pa.array(range(25), pa.int32()), "n_name": [f"N {i}" for i in range(25)], "n_comment": [" leading" if i % 3 else None for i in range(25)]})


@pytest.mark.parametrize("codec", ["none", "snappy", "gzip", "zstd"])
@pytest.mark.parametrize("dictionary", [True, False])
@pytest.mark.parametrize("version", ["1.0", "2.0"])
def test_golden_over_codecs(spark, tmp_path, codec, dictionary, version):
    path = str(tmp_path / "n.parquet")
    pq.write_table(NATION, path, compression=codec, use_dictionary=dictionary, data_page_version=version, row_group_size=10)
    assert list(scan.rows(scan.scan(spark, path))) == [list(r.values()) for r in NATION.to_pylist()]
    pages = colmeta.metadata(spark, path, "page").collect()
    assert sum(p.num_values for p in pages if p.page_type.startswith("DATA_PAGE")) == 75
    assert {p.page_type for p in pages} == {"DATA_PAGE" if version == "1.0" else "DATA_PAGE_V2"} | ({"DICTIONARY_PAGE"} if dictionary else set())


def test_projection_limit_and_sinks(spark, tmp_path):
    path = str(tmp_path / "n.parquet")
    pq.write_table(NATION, path, row_group_size=7)
    assert next(scan.rows(scan.scan(spark, path, ["n_name", "n_nationkey"]))) == ["N 0", 0]
    assert list(next(scan.dict_rows(scan.scan(spark, path, ["n_name", "n_name"])))) == ["n_name"]
    assert [r.n_nationkey for r in limit.first_rows(spark, path, 9, ["n_nationkey"]).collect()] == list(range(9))
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        scan.scan(spark, path, ["absent"]).collect()
    out = io.StringIO()
    sink.dump(spark, path, "csv", 2, out=out)
    assert out.getvalue() == "n_nationkey\tn_name\tn_comment\r\n0\tN 0\t\r\n1\tN 1\t leading\r\n"
    out = io.StringIO()
    sink.dump(spark, path, "json", 1, out=out)
    assert json.loads(out.getvalue()) == {"n_nationkey": 0, "n_name": "N 0", "n_comment": None}
    out = io.StringIO()
    sink.dump(spark, path, "csv", 0, out=out)
    assert out.getvalue() == "n_nationkey\tn_name\tn_comment\r\n"
    with pytest.raises(ValueError):
        sink.dump(spark, path, "xml")
    out = io.StringIO()
    sink.dump_metadata(spark, path, True, out)
    assert "num_rows=25" in out.getvalue() and "DATA_PAGE" in out.getvalue()


def test_nested_and_magic(spark, tmp_path):
    path = str(tmp_path / "s.parquet")
    pq.write_table(pa.table({"a": [{"x": 1, "y": {"z": "p"}}], "b": [{"x": 2, "y": None}]}), path)
    df = scan.scan(spark, path, flatten=True)
    assert df.columns[:3] == ["a.x", "a.y.z", "b.x"]
    assert scan.scan(spark, path, ["a.y.z"]).collect()[0][0] == "p"
    bad = tmp_path / "bad.parquet"
    bad.write_bytes(b"PAR1_some_bogus_data")
    row = footer.magic(spark, str(bad)).first()
    assert (row.header_ok, row.footer_ok) == (True, False)
    with pytest.raises(footer.FormatError):
        scan.checked(spark, str(bad))
    assert footer.magic(spark, path).first().footer_size == pq.ParquetFile(path).metadata.serialized_size


def test_logical_types(spark):
    one = spark.range(1)
    D = decimal.Decimal
    got = one.select(
        logical.decimal(F.lit(1099511627776), 3), logical.decimal_of_bytes(F.lit(bytes([2, 0, 1])), 3), logical.decimal_of_bytes(F.lit(b"\xff\xfe"), 1), logical.compat_decimal(logical.decimal(F.lit(1099511627776), 3), 3),
        logical.date(F.lit(12725)), logical.compat_date(logical.date(F.lit(731888))), logical.time_millis(F.lit(731888)), F.unix_millis(logical.timestamp_millis(F.lit(1099511625014))),
        logical.unsigned(F.lit(-3), 8), logical.unsigned(F.lit(253), 8), logical.unsigned(F.lit(-6884376), 32), logical.unsigned(F.lit(-6884376), 64), logical.int96_raw(F.lit((1).to_bytes(8, "little") + (1000).to_bytes(4, "little"))),
        logical.interval_parts(F.lit(b"\1\0\0\0\2\0\0\0\3\0\0\0")), logical.unsigned(F.lit(None).cast("int"), 16),
    ).first()
    assert list(got) == [D("1099511627.776"), D("131.073"), D("-0.2"), D("10995116277.760"), dt.date(2004, 11, 3), dt.date(2004, 11, 3), dt.timedelta(seconds=731.888), 1099511625014, 253, 253, 4288082920, 18446744073702667240, 2**32 + 1000, (1, 2, 3), None]


def test_decoders():
    assert enc.plain_int32((999).to_bytes(4, "little"), 1) == [999]
    assert enc.plain_int96((0).to_bytes(8, "little") + (999).to_bytes(4, "little"), 1) == [999]
    assert enc.plain_boolean(bytes([0b1101]), 4) == [True, False, True, True]
    assert enc.plain(b"foobar", "FIXED_LEN_BYTE_ARRAY", 2, 3) == [b"foo", b"bar"]
    assert enc.bit_packed(bytes([0x88, 0xC6, 0xFA]), 1, 3) == list(range(8))
    assert enc.bit_packed_high(bytes([0x05, 0x39, 0x77]), 8, 3) == list(range(8))
    assert enc.bit_packed(b"", 1, 0) == [0] * 8
    assert enc.unsigned_varint(b"\xff\xff\xff\x7f") == (0x0FFFFFFF, 4)
    assert enc.run_length((2**30).to_bytes(4, "little"), 4, 30) == [2**30] * 2
    assert [enc.bit_width(x) for x in (0, 1, 2, 4, 8, 16, 32, 64, 128)] == list(range(9))
    with pytest.raises(EOFError):
        enc.plain_int32(b"\0", 1)


@given(st.lists(st.integers(0, 2**11 - 1), min_size=8, max_size=64).map(lambda x: x[: len(x) // 8 * 8]))
def test_bit_packed_round_trip(values):
    packed = sum(v << (11 * i) for i, v in enumerate(values)).to_bytes(len(values) * 11 // 8, "little")
    assert enc.bit_packed(packed, len(values) // 8, 11) == values
    assert enc.hybrid(bytes([(len(values) // 8) << 1 | 1]) + packed, 11) == values


def test_varints_of_every_length(spark, tmp_path):
    from striata.plans import catalogue

    keys = sorted({n for i in range(0, 64, 7) for n in (2**i - 1, 2**i, -(2**i))} - {2**63} | {2**53 + 1})
    pq.write_table(pa.table({"o_orderkey": pa.array([*keys, None], pa.int64())}), tmp_path / "orders.parquet")
    got = catalogue.queries()["enc_varint"](spark, str(tmp_path)).collect()
    assert [(r.o_orderkey, r.v) for r in got] == [(k, k) for k in [*keys, None]]
    sizes = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", F.octet_length(catalogue._varint("k")).alias("n")).collect()
    assert all(r.n == (10 if r.k < 0 else max(1, -(-r.k.bit_length() // 7))) for r in sizes)
    with pytest.raises(OverflowError):
        enc.signed_64(2**64)


def test_command_line(spark, tmp_path, capsys):
    from striata.__main__ import main

    path = str(tmp_path / "n.parquet")
    pq.write_table(NATION, path)
    assert main([path, "--limit", "1", "--col", "n_name", "--no-headers"]) == 0
    assert capsys.readouterr().out == "N 0\r\n"
    with pytest.raises(SystemExit):
        main([path, "--format", "xml"])


@pytest.mark.parametrize("length", range(1, 17))
def test_decimals_of_bytes_of_every_length(spark, length):
    most = min(2 ** (8 * length - 1) - 1, 10**38 - 1)
    numbers = sorted({0, 1, -1, -5, 127, -128, most, -most, most // 3, -(most // 7)} & set(range(-most - 1, most + 1))) if length == 1 else [0, 1, -1, -5, 127, -128, most, -most, most // 3, -(most // 7)]
    rows = [(n, n.to_bytes(length, "big", signed=True)) for n in numbers]
    got = spark.createDataFrame([(str(n), b) for n, b in rows], "n string, b binary").select("n", logical.integer_of_bytes(F.col("b")).alias("v")).collect()
    assert [(r.n, int(r.v)) for r in got] == [(str(n), n) for n, _ in rows]


@pytest.mark.parametrize("codec", ["none", "snappy", "gzip", "zstd", "lz4", "brotli"])
@pytest.mark.parametrize("version", ["1.0", "2.0"])
def test_values_of_pages(spark, tmp_path, codec, version):
    path = str(tmp_path / "v.parquet")
    table = pa.table({
        "i": pa.array([1, None, -3] * 40, pa.int32()), "l": pa.array(range(120), pa.int64()), "f": pa.array([0.5, -1.25, None] * 40, pa.float32()), "b": pa.array([True, None, False] * 40),
        "s": ["x", None, "long " * 20] * 40, "w": pa.array([b"abc", None, b"xyz"] * 40, pa.binary(3)), "n": pa.array([[1, 2], None, [], [None, 3]] * 30, pa.list_(pa.int64())),
    })
    pq.write_table(table, path, compression=codec, data_page_version=version, use_dictionary=["s", "i"], row_group_size=50, data_page_size=64)
    rows = colmeta.metadata(spark, path, "value").collect()
    for name, field in (("i", "integer"), ("l", "integer"), ("f", "number"), ("b", "integer"), ("s", "bytes"), ("w", "bytes")):
        got = [r[field] for r in sorted((r for r in rows if r.path == name), key=lambda r: (r.row_group, r.entry))]
        want = [v.encode() if isinstance(v, str) else v for v in table[name].to_pylist()]
        assert got == want
    nested = sorted((r for r in rows if r.path == "n.list.element"), key=lambda r: (r.row_group, r.entry))
    assert [(r.repetition_level, r.definition_level, r.integer) for r in nested][:6] == [(0, 3, 1), (1, 3, 2), (0, 0, None), (0, 1, None), (0, 2, None), (1, 3, 3)]


def test_entries_are_numbered_over_files_and_row_groups(spark, tmp_path):
    from striata.plans import catalogue

    (tmp_path / "labels.parquet").mkdir()
    toxic, names = [0, 1, None, 1, 1, 0, 0] * 30, [f"part-{i}.parquet" for i in (0, 1, 10, 2)]
    for name, at in zip(names, (0, 50, 100, 103), strict=True):
        rows = toxic[at : {0: 50, 50: 100, 100: 103, 103: 210}[at]]
        pq.write_table(pa.table({"doc_id": range(len(rows)), "toxic": pa.array(rows, pa.int32())}), tmp_path / "labels.parquet" / name, row_group_size=20)
    pq.write_table(pa.table({"doc_id": pa.array([], pa.int64()), "toxic": pa.array([], pa.int32())}), tmp_path / "labels.parquet" / "part-11.parquet")
    got = sorted(catalogue._values(spark, str(tmp_path / "labels.parquet"), "toxic", "integer").collect())
    assert [(r.entry, r.v) for r in got] == list(enumerate(toxic))


@pytest.mark.parametrize("version", ["1.0", "2.0"])
def test_elements_are_numbered_without_absent_and_empty_lists(spark, tmp_path, version):
    from striata.plans import catalogue

    (path := tmp_path / "embeddings.parquet").mkdir()
    lists = [[0.5, 1.5], None, [], [None, 2.5], [3.5], None] * 20
    for i in range(3):
        pq.write_table(pa.table({"vec_id": range(40), "embedding": pa.array(lists[40 * i : 40 * i + 40], pa.list_(pa.float32()))}), path / f"part-{i}.parquet", row_group_size=15, data_page_size=16, data_page_version=version)
    got = sorted(catalogue._values(spark, str(path), "embedding.list.element", "number", "repetition_level").collect())
    want = [(int(i > 0), v) for x in lists for i, v in enumerate(x or [])]
    assert [tuple(r) for r in got] == [(n, *x) for n, x in enumerate(want)]
    pq.write_table(pa.table({"a": [[[1, 2], []], None, [[], None, [3, None]]], "b": [{"x": [1]}, None, {"x": []}]}), tmp_path / "deep.parquet", data_page_version=version)
    assert [(r.path, r.entries, r.elements) for r in colmeta.metadata(spark, str(tmp_path / "deep.parquet"), "count").collect()] == [("a.list.element.list.element", 8, 4), ("b.x.list.element", 3, 1)]


def test_values_of_one_column_read_no_other(spark, tmp_path):
    from striata.plans import catalogue

    (path := tmp_path / "orders.parquet").mkdir()
    prices = [0.5, float("inf"), None, -1.25] * 25
    for i in range(2):
        pq.write_table(pa.table({"o_orderkey": range(50), "o_totalprice": prices[50 * i : 50 * i + 50]}), path / f"part-{i}.parquet", row_group_size=20, use_dictionary=False, column_encoding={"o_orderkey": "DELTA_BINARY_PACKED", "o_totalprice": "PLAIN"})
    got = sorted(catalogue._values(spark, str(path), "o_totalprice", "number").collect())
    assert [tuple(r) for r in got] == list(enumerate(prices))
    with pytest.raises(Exception, match="DELTA_BINARY_PACKED"):
        colmeta.metadata(spark, str(path), "value").collect()


def test_row_groups_of_a_file_go_to_several_tasks(tmp_path, monkeypatch):
    monkeypatch.setattr(colmeta, "SPLIT", 700)
    path, keys = str(tmp_path / "orders.parquet"), [k * 7919 - 2**40 for k in range(1000)]
    pq.write_table(pa.table({"o_orderkey": keys}), path, row_group_size=90, compression="none")
    reader = colmeta._Reader(path, "value", "o_orderkey")
    tasks = [[b for b in reader.read(p)] for p in reader.partitions()]
    assert sum(map(bool, tasks)) > 5
    rows = [r for task in tasks for b in task for r in b.to_pylist()]
    assert [(r["row_group"], r["element"], r["integer"]) for r in rows] == [(n // 90, n % 90, k) for n, k in enumerate(keys)]
    reader = colmeta._Reader(path, "count", "o_orderkey")
    assert [r[-1] for p in reader.partitions() for r in reader.read(p)] == [90] * 11 + [10]


def test_files_read_by_their_annotations(spark, tmp_path):
    path = str(tmp_path / "a.parquet")
    pq.write_table(pa.table({"t": pa.array([731888, None], pa.time32("ms")), "u": pa.array([250, None], pa.uint8()), "m": pa.array([1, 2], pa.time64("us")), "j": pa.array(['{"k": 1}', None], pa.json_()), "s": ["a", None]}), path)
    rows = scan.decoded(spark, path, parse_json=True).select("t", "u", "m", F.variant_get("j", "$.k", "int"), "s").collect()
    assert list(map(tuple, rows)) == [(dt.timedelta(milliseconds=731888), 250, 1, 1, "a"), (None, None, 2, None, None)]
    assert scan.decoded(spark, path, ["s", "t"]).columns == ["s", "t"]
    pq.write_table(pa.table({"d": pa.array([0.5, 1.5])}), path, column_encoding={"d": "BYTE_STREAM_SPLIT"}, use_dictionary=False)
    assert [r.d for r in scan.decoded(spark, path).collect()] == [0.5, 1.5]
    assert spark.conf.get("spark.sql.parquet.enableVectorizedReader") == "true"
    pq.write_table(NATION, path, compression="brotli")
    with pytest.raises(footer.FormatError, match="BROTLI"):
        scan.decoded(spark, path)


def test_footers_and_schema_trees(spark, tmp_path):
    path = str(tmp_path / "s.parquet")
    pq.write_table(pa.table({"a": pa.array([{"x": 1, "y": [decimal.Decimal("1.25")]}]), "k": ["v"]}).replace_schema_metadata({"key": "value"}), path)
    data = (tmp_path / "s.parquet").read_bytes()
    read = lambda at, n: data[at : at + n]
    meta = footer.read_footer(read, len(data))
    assert meta[3] == 1 and footer.edges(read, len(data)) == (True, True, pq.ParquetFile(path).metadata.serialized_size)
    tree = colmeta.metadata(spark, path, "element").orderBy("position").collect()
    assert [(e.path, e.num_children, e.converted_type, e.max_definition_level, e.max_repetition_level) for e in tree] == [
        ("", 2, None, 0, 0), ("a", 2, None, 1, 0), ("a.x", None, None, 2, 0), ("a.y", 1, "LIST", 2, 0), ("a.y.list", 1, None, 3, 1), ("a.y.list.element", None, "DECIMAL", 4, 1), ("k", None, "UTF8", 1, 0),
    ]
    assert (tree[5].scale, tree[5].precision, tree[2].type) == (2, 3, "INT64")
    assert ("key", "value") in [(r.key, r.value) for r in colmeta.metadata(spark, path, "kv").collect()]
    for broken in (b"", b"PAR1", b"PAR1PAR1", b"PAR1" + b"x" * 20, data[:-1], data[:4] + data[-8:], b"X" + data[1:]):
        with pytest.raises(footer.FormatError):
            footer.read_footer(lambda at, n, broken=broken: broken[at : at + n], len(broken))


def test_sinks_refuse_bytes_that_are_no_text(spark):
    bad = spark.createDataFrame([(b"\xff\xfe",)], "b binary")
    with pytest.raises(Exception, match="MALFORMED_CHARACTER|malformed|decode"):
        sink.lines(bad, "csv").collect()


def test_command_line_flags(spark, tmp_path, capsys):
    from striata.__main__ import main

    path = str(tmp_path / "n.parquet")
    pq.write_table(NATION, path)
    assert main([path, "--metadata", "--no-data"], spark) == 0
    out = capsys.readouterr().out
    assert "num_rows=25" in out and "\nrow_group\n" not in out and "num_children=3" in out and "N 0" not in out
    assert main([path, "--metadata", "--row-group-metadata", "--no-data"], spark) == 0
    assert "DATA_PAGE" in capsys.readouterr().out
    assert main([path, "--row-group-metadata", "--no-data"], spark) == 0
    assert capsys.readouterr().out == ""
    assert main([path, "--format", "json", "--limit", "2", "--col", "n_nationkey"], spark) == 0
    assert [json.loads(x) for x in capsys.readouterr().out.splitlines()] == [{"n_nationkey": 0}, {"n_nationkey": 1}]


def test_queries_leave_the_session_as_it_is(spark):
    from striata.plans import catalogue

    before = spark.conf.get("spark.sql.caseSensitive"), spark.conf.get("spark.sql.session.timeZone")
    catalogue.queries()["scan_all_region"](spark, "/root/testdata/sf0.001").count()
    assert before == (spark.conf.get("spark.sql.caseSensitive"), spark.conf.get("spark.sql.session.timeZone"))


def test_streams_of_new_files(spark, tmp_path):
    from striata.streaming import scan_stream

    folder = tmp_path / "in"
    folder.mkdir()
    pq.write_table(NATION, folder / "a.parquet")
    query = scan_stream(spark, str(folder), ["n_name", "n_nationkey"]).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("seen").columns == ["n_name", "n_nationkey"] and spark.table("seen").count() == 25
