import datetime
import math
import struct

import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tabweave.functions import convert, infer, spec
from tabweave.functions.spec import ColumnSpec, RowSpec, SpecError


def convert_all(spark, converter, cells):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, c {convert.CELL}")
    return [r["v"] for r in df.select("i", converter(F.col("c")).alias("v")).orderBy("i").collect()]


def texts(*values):
    return [("s", v, None) if v else None for v in values]


def numbers(*values):
    return [("n", None, float(v)) for v in values]


def test_integers(spark):
    assert convert_all(spark, convert.integer, texts("7", " +5\t", "007", "-0", "1.5", "1e3", "", "9223372036854775807", "9223372036854775808", "x", "1 2")) == [7, 5, 7, 0, None, None, None, 2**63 - 1, None, None, None]
    assert convert_all(spark, convert.integer, numbers(3, 2.5, -7, 1e17)) == [3, None, -7, 10**17]
    assert convert_all(spark, lambda c: convert.integer(c, "uint8"), texts("255", "256", "-1")) == [255, None, None]
    assert convert_all(spark, lambda c: convert.integer(c, "uint64"), texts("18446744073709551615", "18446744073709551616"))[0] == 2**64 - 1
    # the text of a spreadsheet number counts, beyond what a double holds
    assert convert_all(spark, convert.integer, [("n", "9007199254740993", 9007199254740992.0)]) == [9007199254740993]


def test_doubles(spark):
    assert convert_all(spark, convert.double, texts("1.5", ".5", "5.", "1e3", " -2 ", "1d", "1f", "abc", "1,5", "Infinity")) == [1.5, 0.5, 5.0, 1000.0, -2.0, None, None, None, None, math.inf]
    assert convert_all(spark, convert.double, [None, ("b", None, 1.0), ("e", "#N/A", None)]) == [None, None, None]


def test_decimals_and_cultures(spark):
    got = convert_all(spark, lambda c: convert.decimal(c, 20, 4), [*texts("12345678901234.5678", "1e2", "x"), *numbers(0.1)])
    assert [None if v is None else str(v) for v in got] == ["12345678901234.5678", "100.0000", None, "0.1000"]
    german = convert.cultured(convert.double, ",", ".")
    assert convert_all(spark, german, [*texts("1.234,5", "0,25"), ("n", "1.5", 1.5)]) == [1234.5, 0.25, 1.5]


def test_booleans_are_strict(spark):
    assert convert_all(spark, convert.boolean, texts("true", "FALSE", "1", "0", "yes", "t", " true", "2")) == [True, False, True, False, None, None, None, None]
    assert convert_all(spark, convert.boolean, [("n", None, 1.0), ("n", None, 2.0), ("b", None, 0.0)]) == [True, None, False]


def test_dates(spark):
    day = datetime.datetime
    got = convert_all(spark, convert.timestamp, texts("2024-01-31", "2024-01-31T10:20:30.1234567", "2024-02-30", "2024-1-2", "2024", "45292", "01/31/2024", "2024-01-31T10:00:00+02:00", "0000-01-01"))
    assert got == [day(2024, 1, 31), day(2024, 1, 31, 10, 20, 30, 123456), None, None, None, None, day(2024, 1, 31), day(2024, 1, 31, 8), None]
    columnar = lambda c: convert.timestamp(c, policy="columnar")
    assert convert_all(spark, columnar, [*texts("45292", "45292.25"), ("d", None, 45292.25)]) == [day(2024, 1, 1), day(2024, 1, 1, 6), day(2024, 1, 1, 6)]
    serials = convert_all(spark, lambda c: convert.serial_timestamp(c["num"]), numbers(0, 1, 59, 60, 61))
    assert serials == [day(1899, 12, 31), day(1900, 1, 1), day(1900, 2, 28), day(1900, 2, 28), day(1900, 3, 1)]
    assert convert_all(spark, lambda c: convert.serial_timestamp(c["num"], True), numbers(0, 3e6)) == [day(1904, 1, 1), None]


def test_times(spark):
    hour = 3_600_000_000
    assert convert_all(spark, convert.time_of_day, [("d", None, 45292.25), *texts("06:30", "23:59:59.5", "24:00", "0.5", "1", "x")]) == [6 * hour, int(6.5 * hour), 24 * hour - 500_000, None, 12 * hour, None, None]
    assert convert_all(spark, convert.duration, texts("1.02:03:04.5", "-00:01", "25:00")) == [(26 * 3600 + 184) * 1_000_000 + 500_000, -60_000_000, None]


def test_enum_guid_char(spark):
    e = convert.enum({"Red": 1, "Crimson": 1, "Blue": 2})
    assert convert_all(spark, e, texts("RED", "crimson", "2", "3", "x")) == ["Red", "Red", "Blue", None, None]
    assert convert_all(spark, convert.guid, texts("{0F8FAD5B-D9CB-469F-A165-70867728950E}", "0f8f")) == ["0f8fad5b-d9cb-469f-a165-70867728950e", None]
    assert convert_all(spark, convert.character, texts("x", "xy")) == ["x", None]


def test_number_text(spark):
    got = convert_all(spark, lambda c: convert.number_text(c["num"]), numbers(1, -2.5, 123456789012, 0.1, 1e20, 1.5e-7, 0.00012, 12345678.9))
    assert got == ["1", "-2.5", "123456789012", "0.1", "1E+20", "1.5E-07", "0.00012", "12345678.9"]


@settings(max_examples=3, deadline=None, phases=[Phase.generate])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=20, max_size=200))
def test_number_text_round_trips(spark, values):
    got = convert_all(spark, lambda c: convert.number_text(c["num"]), numbers(*values))
    assert [struct.pack("<d", float(t) + 0.0) for t in got] == [struct.pack("<d", v + 0.0) for v in values]


def test_escapes():
    assert convert.xml_escapes("a_x0041_b_xD83D__xDE00__xD800_") == "aAb\U0001f600_xD800_"


def raw(spark, *lines):
    cell = lambda x: ("s", x, None) if x else None
    return spark.createDataFrame([(i, [cell(x) for x in line.split(",")]) for i, line in enumerate(lines)], f"row_idx long, cells array<{convert.CELL}>")


def test_policies(spark):
    data = raw(spark, "A,B", "1,x", ",", "z,y")
    good = spec.apply(data, RowSpec((ColumnSpec("a", "int32", missing="default", default=9), ColumnSpec("b"))))
    assert [tuple(r) for r in good.collect()] == [(1, "x"), (9, "y")]
    with pytest.raises(PySparkException, match="column a, row 4: cannot read 'z'"):
        spec.apply(data, RowSpec((ColumnSpec("a", "int32", required=True),))).collect()
    with pytest.raises(PySparkException, match="cannot read"):
        spec.apply(data, RowSpec((ColumnSpec("a", "int32"),), throw_on_failure=True)).collect()


def test_binding():
    cols = (ColumnSpec("x", aliases=("b", "a")),)
    assert spec.bind(["a", "B", "b"], RowSpec(cols)) == {"x": 1}
    with pytest.raises(SpecError, match="p, q"):
        spec.bind(["a"], RowSpec((ColumnSpec("p", required=True), ColumnSpec("q", required=True))))
    with pytest.raises(SpecError, match="several"):
        spec.bind(["a"], RowSpec((ColumnSpec("a"), ColumnSpec("z", aliases=("A",)))))
    with pytest.raises(SpecError):
        RowSpec((ColumnSpec("a", index=0), ColumnSpec("b")))
    with pytest.raises(SpecError):
        RowSpec((ColumnSpec("a", "nothing"),))


def test_dataclass_specs():
    import dataclasses

    @dataclasses.dataclass
    class Sale:
        region: str
        units: int | None
        price: float = 1.5

    assert [(c.name, c.type, c.missing, c.default) for c in spec.from_dataclass(Sale)] == [("region", "string", "null", None), ("units", "int64", "null", None), ("price", "double", "default", 1.5)]


def test_inference(spark):
    data = raw(spark, "N,F,Mixed,Blank,When", "1,1.5,a,,2024-01-01", "-2,2,3,,2024-01-01 10:00:00")
    got = [(r["name"], r["type"], r["nullable"]) for r in infer.infer_schema(data, parse_text=True).collect()]
    assert got == [("N", "int64", False), ("F", "float64", False), ("Mixed", "string", False), ("Blank", "string", True), ("When", "timestamp", False)]
    assert {r["type"] for r in infer.infer_schema(data).collect()} == {"string"}
    with pytest.raises(SpecError, match="fewer than 5"):
        infer.infer_schema(data, 5)
