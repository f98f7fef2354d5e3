import csv
import datetime
import io

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabweave.functions.spec import ColumnSpec, RowSpec, SpecError
from tabweave.operators import dataflow, rendering
from tabweave.sources import cfb, crypto, delimited, workbook, xls, xlsb, xlsx
from tabweave.sources.cells import Limits, LimitExceeded, WorkbookError, is_date_format, rk
from tabweave.sources.dialect import Dialect, sniff
from tabweave.sources.styles import Style, Styles

CELLS = [
    [("s", "a & <b>", None), None, ("n", "1", 1.0), ("b", None, 1.0)],
    [("s", "ünï\n_x0041_ \U0001f600", None), ("d", None, 45292.25), ("n", "-2.5", -2.5)],
    [None, None, ("e", "#DIV/0!", None)],
]


def without_text(rows):
    return [(n, [None if c is None else (c[0], c[1] if c[0] in "se" else None, c[2]) for c in cells]) for n, cells in rows]


def build(kind, rows):
    numbered = list(enumerate(rows))
    if kind == "xlsx":
        return xlsx.package([{"name": "S", "fragments": [xlsx.row_xml(n, r) for n, r in numbered]}], Styles().xml())
    if kind == "xlsb":
        return xlsb.package([{"name": "S", "fragments": [xlsb.row_bytes(n, r) for n, r in numbered]}])
    return xls.workbook([{"name": "S", "rows": numbered}])


@pytest.mark.parametrize("kind", ["xlsx", "xlsb", "xls"])
def test_codec_round_trip(kind):
    data = build(kind, CELLS)
    assert workbook.detect(data) == kind
    book = workbook.open_workbook(data)
    assert book.sheets == [("S", "visible")]
    assert without_text(book.read(0)) == without_text(enumerate(CELLS))


cell = st.one_of(
    st.none(),
    st.text(st.characters(exclude_categories=["Cs"]), min_size=1, max_size=40).map(lambda t: ("s", t, None)),
    st.floats(allow_nan=False, allow_infinity=False).map(lambda x: ("n", None, x + 0.0)),
    st.booleans().map(lambda b: ("b", None, float(b))),
)


@settings(max_examples=40, deadline=None)
@given(st.sampled_from(["xlsx", "xlsb", "xls"]), st.lists(st.lists(cell, max_size=6), max_size=8))
def test_any_cells_round_trip(kind, rows):
    trim = lambda r: r[: max((i + 1 for i, c in enumerate(r) if c), default=0)]
    got = {n: c for n, c in without_text(workbook.open_workbook(build(kind, rows)).read(0))}
    assert got == {n: trim(r) for n, r in enumerate(rows)}


def test_long_strings_continue():
    rows = [[("s", "é" * 32_000 + str(i), None)] for i in range(5)]
    assert without_text(workbook.open_workbook(build("xls", rows)).read(0)) == without_text(enumerate(rows))


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(["xlsx", "xlsb", "xls"]), st.data())
def test_damaged_files_fail_cleanly(kind, data):
    import struct
    import zlib
    import zipfile

    raw = bytearray(build(kind, CELLS))
    for _ in range(data.draw(st.integers(1, 6))):
        raw[data.draw(st.integers(0, len(raw) - 1))] = data.draw(st.integers(0, 255))
    try:
        book = workbook.open_workbook(bytes(raw))
        for i in range(len(book.sheets)):
            list(book.read(i))
    except (WorkbookError, zipfile.BadZipFile, zlib.error, KeyError, ValueError, IndexError, struct.error, NotImplementedError, EOFError, OverflowError, RuntimeError):
        pass


def test_limits_and_document_types():
    with pytest.raises(LimitExceeded):
        list(xlsx.open_xlsx(build("xlsx", CELLS), Limits(decompressed=10)).read(0))
    bomb = '<!DOCTYPE x [<!ENTITY a "aaaa">]><worksheet><sheetData/></worksheet>'
    with pytest.raises(WorkbookError, match="document types"):
        list(xlsx.sheet_rows(bomb.encode(), [], [], False, Limits()))
    with pytest.raises(WorkbookError):
        workbook.open_workbook(b"a,b\n1,2\n")
    assert workbook.detect(b"") == "unknown"


def test_xlsx_cells():
    xml = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
    <row><c t="s"><v>1</v></c><c t="d"><v>2024-01-01T06:00:00Z</v></c><c t="d"><v>0099-01-01</v></c><c><v></v></c></row>
    <row r="5"><c r="B5" t="inlineStr"><is><r><t>a</t></r><rPh><t>no</t></rPh><r><t>b</t></r></is></c><c t="str"><f>1+1</f><v>two</v></c><c t="b"><v>1</v></c></row></sheetData></worksheet>"""
    rows = list(xlsx.sheet_rows(xml.encode(), ["x", "y"], [], False, Limits()))
    assert rows == [
        (0, [("s", "y", None), ("d", None, 45292.25), ("s", "0099-01-01", None)]),
        (4, [None, ("s", "ab", None), ("s", "two", None), ("b", None, 1.0)]),
    ]


def test_number_formats_and_rk():
    assert is_date_format(14) and is_date_format(81) and not is_date_format(0)
    assert is_date_format(164, "yyyy-mm-dd") and not is_date_format(165, '0.00" days"') and not is_date_format(166, "[Red]0.0\\d")
    assert rk((5 << 2) | 2) == 5 and rk((150 << 2) | 3) == 1.5 and rk(0x3FF00000) == 1.0 and rk(((-5 & 0x3FFFFFFF) << 2) | 2) == -5


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.text("abcXYZ", min_size=1, max_size=10), st.binary(max_size=9000), max_size=5))
def test_compound_files(named):
    named = {n: v for n, v in named.items() if v}
    assert cfb.streams(cfb.container(named)) == named


def test_csv_records():
    parse = lambda t: list(delimited.records(t))
    assert parse('a,"b ""q"" c"\r\n"x"y,z\r1,2\n\n3,') == [["a", 'b "q" c'], ["xy", "z"], ["1", "2"], [""], ["3", ""]]
    assert parse('a,"open\nend') == [["a", "open\nend"]]
    assert parse('a"b,c"d') == [['a"b', 'c"d']]
    assert parse("") == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.text('ab,"\n x', max_size=5), min_size=2, max_size=4), max_size=5))
def test_csv_records_read_what_csv_writes(rows):
    buffer = io.StringIO()
    csv.writer(buffer).writerows(rows)
    assert list(delimited.records(buffer.getvalue())) == rows


def test_sniffing():
    assert sniff(b"a;b;c\n1;2;3\n") == Dialect(";")
    assert sniff(b"a\tb\n'x\ty'\t2\n") == Dialect("\t", "'")
    assert sniff(b"one column\nno more\n") == Dialect()
    assert sniff(b"\xef\xbb\xbfa|b\n1|2\n") == Dialect("|", '"', "utf-8", True)
    assert sniff(b"a,b") == Dialect(",")
    with pytest.raises(ValueError):
        Dialect('"', '"')


def test_workbook_frames(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n{i}", i * 1.5, datetime.datetime(2024, 1, 1 + i, 6), i % 2 == 0, None) for i in range(20)], "o int, name string, x double, t timestamp_ntz, b boolean, e string")
    for kind in ("xlsx", "xlsb", "xls"):
        path = f"{tmp_path}/a.{kind}"
        workbook.write([("One", df), ("Two", df)], path, "o", visibility={"Two": "hidden"}, password="pw" if kind == "xlsx" else None)
        password = "pw" if kind == "xlsx" else None
        raw = workbook.read_raw(spark, path, "two", password=password)
        got = workbook.read_inferred(raw)
        assert [t for _, t in got.dtypes] == ["string", "double", "timestamp_ntz", "boolean", "string"]
        assert sorted(map(tuple, got.collect())) == sorted(tuple(r)[1:] for r in df.collect())
        assert workbook.as_table(raw).columns == df.columns[1:]
    assert [r["format"] for r in workbook.formats(spark, f"{tmp_path}/*").orderBy("path").collect()] == ["xls", "xlsb", "encrypted"]
    with pytest.raises(crypto.WrongPassword):
        workbook.read_raw(spark, f"{tmp_path}/a.xlsx", password="no")


def test_write_guards(spark, tmp_path):
    bad = spark.createDataFrame([(0, float("nan"))], "o int, x double")
    with pytest.raises(Exception, match="not a finite number"):
        workbook.write([("s", bad)], f"{tmp_path}/a.xlsx", "o")
    for name in ("", "a/b", "x" * 32, "'a"):
        with pytest.raises(WorkbookError):
            workbook.check_sheet_name(name)
    for name in ("A1", "R1C1", "1x", "r"):
        with pytest.raises(WorkbookError):
            workbook.check_table(name, ["a"])
    with pytest.raises(WorkbookError, match="can't be written"):
        workbook.write([("s", spark.createDataFrame([(0, [1])], "o int, x array<int>"))], f"{tmp_path}/a.xlsx", "o")


def test_styles():
    s = Styles({0: Style(bold=True, fill="FFFF00", number_format="0.00")}, {1: 20})
    assert "<b/>" in s.xml() and 'style="2"' in s.columns_xml()


def test_csv_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', True), (2, "two\nlines", None)], "i int, t string, b boolean")
    rendering.write_csv(df.coalesce(1), f"{tmp_path}/c")
    raw = delimited.scan_raw(spark, f"{tmp_path}/c")
    assert [[c and c["text"] for c in r["cells"]] for r in raw.orderBy("row_idx").collect()] == [["i", "t", "b"], ["1", 'a "q", b', "true"], ["2", "two\nlines", None]]
    typed = delimited.scan_typed(spark, f"{tmp_path}/c", ["i", "t", "b"], multiline=True)
    assert sorted(map(tuple, typed.collect())) == [("1", 'a "q", b', "true"), ("2", "two\nlines", None)]


def test_dataflow(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    text = dataflow.fold(df, "k", list, lambda s, r: [*s, r["k"]], lambda a, b: a + b)
    assert text == list(range(1000))
    assert dataflow.fold(df.limit(0), "k", lambda: "seed", None, None) == "seed"
    assert [r["n"] for r in dataflow.numbered(df, "k", "n").orderBy("k").collect()] == list(range(1000))
    words = spark.createDataFrame([("b",), (None,), ("a",), ("c",), ("b",)], "k string")
    assert [(r["k"], r["n"]) for r in dataflow.numbered(words, "k", "n").orderBy("n").collect()] == [(None, 0), ("a", 1), ("b", 2), ("b", 3), ("c", 4)]
    assert dataflow.numbered(df.limit(0), "k", "n").count() == 0
    assert [t.num_rows for t in dataflow.batches(df, 300)] == [300, 300, 300, 100]
    assert sum(t.num_rows for t in dataflow.batches(df)) == 1000
    head, tail, total = dataflow.preview(df, 5, "k")
    assert [r["k"] for r in head] == [0, 1, 2] and [r["k"] for r in tail] == [998, 999] and total == 1000
    assert dataflow.preview(df, 5, "k", fast=True)[2] is None


def test_cli(spark, tmp_path):
    from tabweave import cli

    (tmp_path / "a.csv").write_text("id;name\n1;x\n2;y\n3;z\n")
    def told(*argv):
        out = io.StringIO()
        cli.run(spark, argv, out)
        return out.getvalue()

    assert told("schema", f"{tmp_path}/a.csv") == "0\tid\tstring\n1\tname\tstring\n"
    assert told("preview", f"{tmp_path}/a.csv", "--rows", "2", "--columns", "name") == "name\nx\n...\nz\n3 rows\n"
    told("convert", f"{tmp_path}/a.csv", f"{tmp_path}/a.xlsx")
    assert told("schema", f"{tmp_path}/a.xlsx") == "0\tid\tint64\n1\tname\tstring\n"
    assert told("sheets", f"{tmp_path}/a.xlsx") == "0\tSheet1\n"
    told("convert", f"{tmp_path}/a.csv", f"{tmp_path}/b.csv")
    assert (tmp_path / "b.csv").read_bytes() == b"id,name\r\n1,x\r\n2,y\r\n3,z\r\n"
    day, noon = datetime.datetime(2024, 5, 6), datetime.datetime(2024, 5, 6, 12)
    kinds = spark.createDataFrame([(1, day, noon, 2.0, True), (2, None, day, 2.5, False)], "n int, d timestamp_ntz, t timestamp_ntz, f double, b boolean")
    workbook.write([("S", kinds.withColumn("row", F.col("n")))], f"{tmp_path}/k.xlsx", order="row")
    body = told("preview", f"{tmp_path}/k.xlsx").splitlines()[1:3]
    assert [r.split("\t") for r in body] == [["1", "2024-05-06", "2024-05-06 12:00:00", "2.0", "true"], ["2", "", "2024-05-06 00:00:00", "2.5", "false"]]
    assert told("preview", f"{tmp_path}/k.xlsx", "--max-columns", "3", "--fast").splitlines()[0] == "n\td\t...\tb"
    assert cli.fitted("abcdef", 4) == "abc\u2026"


def test_stream(spark, tmp_path):
    from tabweave.functions.spec import ColumnSpec
    from tabweave.streaming import folds

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("k,v\na,1\nb,2\na,x\n")
    s = folds.typed_stream(spark, f"{tmp_path}/in", ["k", "v"], (ColumnSpec("k"), ColumnSpec("v", "int64")))
    folds.run_available(folds.group_fold(s, ["k"], "v"), f"{tmp_path}/cp", "folded")
    assert sorted(map(tuple, spark.table("folded").collect())) == [("a", 1, 1, 1, 1), ("b", 2, 2, 2, 1)]


@pytest.mark.parametrize("kind", ["xlsx", "xlsb", "xls"])
def test_dates_of_the_1904_system(spark, tmp_path, kind):
    rows = [(0, [("s", "d", None)]), (1, [("d", None, 1.0)]), (2, [("d", None, 0.5)])]
    if kind == "xlsx":
        data = xlsx.package([{"name": "S", "fragments": [xlsx.row_xml(n, r) for n, r in rows]}], Styles().xml(), date1904=True)
    elif kind == "xlsb":
        data = xlsb.package([{"name": "S", "fragments": [xlsb.row_bytes(n, r) for n, r in rows]}], date1904=True)
    else:
        data = xls.workbook([{"name": "S", "rows": rows}], date1904=True)
    (tmp_path / f"a.{kind}").write_bytes(data)
    got = workbook.read_typed(spark, f"{tmp_path}/a.{kind}", RowSpec((ColumnSpec("d", "timestamp"),))).collect()
    assert [str(r["d"]) for r in got] == ["1904-01-02 00:00:00", "1904-01-01 12:00:00"]


def test_headers_of_several_files(spark, tmp_path):
    def file(name, rows):
        (tmp_path / name).write_bytes(build("xlsx", [[None if x is None else ("s", x, None) for x in r] for r in rows]))

    file("1.xlsx", [["a", "b"], ["1", "2"]])
    file("2.xlsx", [["b", None, "a"], ["4", None, "3"]])
    file("3.xlsx", [["A"], ["5"]])
    spec = RowSpec((ColumnSpec("a", "int32"), ColumnSpec("b", "int32", missing="null")))
    assert sorted(map(str, (tuple(r) for r in workbook.read_typed(spark, f"{tmp_path}/*.xlsx", spec).collect()))) == ["(1, 2)", "(3, 4)", "(5, None)"]
    with pytest.raises(SpecError, match="b"):
        workbook.read_typed(spark, f"{tmp_path}/*.xlsx", RowSpec((ColumnSpec("b", "int32", required=True),)))


def test_store_replaces_and_keeps(spark, tmp_path):
    workbook.store(spark, f"{tmp_path}/f", b"one")
    workbook.store(spark, f"{tmp_path}/f", b"two")
    assert (tmp_path / "f").read_bytes() == b"two" and not (tmp_path / "f.old").exists() and not (tmp_path / "f.writing").exists()


def _orders(spark, folder, rows):
    """A folder with a table ``orders`` of ``rows`` rows, nearly all of them of a key only, and its frame."""
    some = lambda x: F.when(F.col("id") % 1000 == 0, x)
    df = spark.range(rows).select(
        F.col("id").alias("o_orderkey"), some(F.col("id") % 7).alias("o_custkey"), some(F.lit("F")).alias("o_orderstatus"), some(F.col("id") / 4).alias("o_totalprice"),
        some(F.lit(datetime.datetime(2024, 5, 6, 12)).cast("timestamp_ntz")).alias("o_orderdate"), some(F.lit("5-LOW")).alias("o_orderpriority"),
    )
    df.write.parquet(f"{folder}/orders.parquet")
    return df


def _same(a, b):
    digest = lambda x: x.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*x.columns).cast("decimal(38,0)"))).first()
    assert digest(a) == digest(b.select(*a.columns))


@pytest.mark.parametrize("kind", ["xlsx", "xlsb"])
def test_query_takes_more_rows_than_a_sheet(spark, tmp_path, kind):
    from tabweave.plans import registry

    df = _orders(spark, tmp_path, 1_048_600)
    _same(registry.QUERIES[f"{kind}_roundtrip"](spark, str(tmp_path)), df)


def test_xls_query_takes_more_rows_than_a_sheet(spark, tmp_path):
    from tabweave.plans import registry

    df = spark.range(65_600).select(F.col("id").alias("c_custkey"), F.lit("n").alias("c_name"), F.lit(1).alias("c_nationkey"), (F.col("id") / 4).alias("c_acctbal"), F.lit(None).cast("string").alias("c_mktsegment"))
    df.write.parquet(f"{tmp_path}/customer.parquet")
    _same(registry.QUERIES["xls_roundtrip"](spark, str(tmp_path)), df)


@pytest.mark.parametrize("kind", ["xlsx", "xlsb", "xls"])
def test_parts(spark, tmp_path, kind):
    df = spark.createDataFrame([(i, f"n{i}", None if i % 3 else i / 2) for i in range(100)], "o int, name string, x double")
    spec = RowSpec((ColumnSpec("name"), ColumnSpec("x", "double")))
    workbook.write_parts(df, f"{tmp_path}/p", "o", "S", kind, rows=7)
    files = sorted((tmp_path / "p").glob(f"*.{kind}"))
    assert len(files) >= 15 and not (tmp_path / "p.writing").exists()
    books = [[r[0][1] for _, r in workbook.open_workbook(f.read_bytes()).read(0)] for f in files]
    assert all(b[0] == "name" and len(b) <= 8 for b in books)
    assert [n for b in books for n in b[1:]] == [f"n{i}" for i in range(100)]
    got = workbook.read_typed(spark, f"{tmp_path}/p/*", spec).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((tuple(r)[1:] for r in df.collect()), key=repr)
    workbook.write_parts(df.limit(0), f"{tmp_path}/none", "o", "S", kind)
    assert workbook.read_typed(spark, f"{tmp_path}/none/*", spec).count() == 0
    with pytest.raises(FileExistsError):
        workbook.write_parts(df, f"{tmp_path}/p", "o", "S", kind)
    with pytest.raises(WorkbookError, match="rows"):
        workbook.write_parts(df, f"{tmp_path}/q", "o", "S", kind, rows=1_048_576)


def test_csv_query_keeps_empty_texts_nulls_and_blank_rows(spark, tmp_path):
    from tabweave.plans import registry

    from .compare import assert_same

    odd = ["", None, " ", '"', '""', "\r", "a\r\nb", ",", "\ufeff", "\x00", "\x85", "\u2028", 'x"y', "NULL", "tail\n"]
    rows = [(i, t, odd[-i], odd[i * 7 % len(odd)], None if i % 2 else i) for i, t in enumerate(odd)] + [(None, None, None, None, None), (None, "", "", "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert_same(registry.QUERIES["csv_roundtrip_documents"](spark, str(tmp_path)), registry.SQL["csv_roundtrip_documents"], db)


def test_csv_files_of_few_rows(spark, tmp_path):
    rendering.write_csv(spark.range(10).coalesce(1), f"{tmp_path}/c", rows=4)
    assert sorted(f.read_bytes() for f in (tmp_path / "c").glob("*.txt")) == [b"id\r\n0\r\n1\r\n2\r\n3\r\n", b"id\r\n4\r\n5\r\n6\r\n7\r\n", b"id\r\n8\r\n9\r\n"]


def test_csv_records_with_empty_fields():
    assert list(delimited.records('"",,""\r\n\r\n""\r\n,', bare=None)) == [["", None, ""], [None], [""], [None, None]]
    assert list(delimited.records('"",,""')) == [["", "", ""]]
