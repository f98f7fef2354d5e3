"""Named queries over the test tables, each with its DuckDB equivalent.

Every query runs an operator of the library on a whole table and returns what plain SQL gives for the same
question, so that the operator's result can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import convert, infer, spec
from ..functions.spec import ColumnSpec, RowSpec
from ..operators import dataflow, rendering
from ..sources import delimited
from ..sources.shipping import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_raw(df: DataFrame) -> DataFrame:
    """A table written as CSV and scanned again by the splittable parser, as raw rows; row numbers only mark rows as data here."""
    path = scratch(df.sparkSession)
    rendering.write_csv(df, path)
    text = delimited.scan_typed(df.sparkSession, path, df.columns)
    return text.select(F.lit(1).cast("long").alias("row_idx"), F.array(*[convert.text_cell(F.col(f"`{c}`")) for c in df.columns]).alias("cells"))


_LINEITEM = (
    ColumnSpec("l_orderkey", "int64", index=0),
    ColumnSpec("l_partkey", "int64", index=1),
    ColumnSpec("l_suppkey", "int64", index=2),
    ColumnSpec("l_linenumber", "int32", index=3),
    ColumnSpec("l_quantity", "double", index=4),
    ColumnSpec("l_extendedprice", "double", index=5),
    ColumnSpec("l_discount", "double", index=6),
    ColumnSpec("l_tax", "double", index=7),
    ColumnSpec("l_returnflag", "string", index=8),
    ColumnSpec("l_linestatus", "string", index=9),
    ColumnSpec("l_shipdate", "timestamp", index=10),
)


def _typed_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spec.apply(text_raw(table(spark, sf_dir, "lineitem")), RowSpec(_LINEITEM), text_only=True)


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem")
def typed_roundtrip_lineitem(spark, sf_dir):
    return _typed_lineitem(spark, sf_dir)


@query(
    """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS sum_qty, min(l_extendedprice) AS min_price,
    max(l_extendedprice) AS max_price, round(sum(CAST(l_extendedprice AS DECIMAL(18,2))), 2)::DOUBLE AS sum_price FROM lineitem GROUP BY 1, 2"""
)
def fold_group_sum(spark, sf_dir):
    """Typed parse of text, then the canonical fold."""
    d = _typed_lineitem(spark, sf_dir)
    return d.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("l_quantity").cast("long")).alias("sum_qty"),
        F.min("l_extendedprice").alias("min_price"),
        F.max("l_extendedprice").alias("max_price"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("sum_price"),
    )


@query("SELECT event_type, min(value) AS lo, max(value) AS hi, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT)) AS cents FROM events GROUP BY 1")
def fold_brc(spark, sf_dir):
    """Min, max, sum and count by key over parsed text."""
    e = table(spark, sf_dir, "events").select("event_type", "value")
    t = spec.apply(text_raw(e), RowSpec((ColumnSpec("event_type", index=0), ColumnSpec("value", "double", index=1))), text_only=True)
    return t.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


@query("SELECT sum(length(c_name) + length(c_mktsegment)) AS chars, sum(CAST(trunc(c_acctbal) AS BIGINT)) AS whole, count(*) AS n FROM customer")
def fold_checksum(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_name", "c_mktsegment", "c_acctbal")
    t = spec.apply(text_raw(c), RowSpec((ColumnSpec("n", index=0), ColumnSpec("m", index=1), ColumnSpec("b", "double", index=2))), text_only=True)
    whole = F.when(F.col("b") < 0, F.ceil("b")).otherwise(F.floor("b"))
    return t.agg(F.sum(F.length("n") + F.length("m")).alias("chars"), F.sum(whole.cast("long")).alias("whole"), F.count(F.lit(1)).alias("n"))


@query("SELECT md5(string_agg(o_orderstatus || CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)) AS digest, count(*) AS n FROM orders")
def ordered_fold(spark, sf_dir):
    """A fold whose combine doesn't commute: concatenation in key order."""
    import hashlib

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    text, n = dataflow.fold(
        o,
        "o_orderkey",
        lambda: ([], 0),
        lambda s, r: (s[0].append(f"{r['o_orderstatus']}{r['o_orderkey']}") or s[0], s[1] + 1),
        lambda a, b: (a[0] + b[0], a[1] + b[1]),
    )
    return spark.createDataFrame([(hashlib.md5(",".join(text).encode()).hexdigest(), n)], "digest string, n long")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def row_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    t = spec.apply(text_raw(o), RowSpec((ColumnSpec("o_orderkey", "int64", index=0), ColumnSpec("s", index=1), ColumnSpec("o_totalprice", "double", index=2))), text_only=True)
    return dataflow.skip_rows(t, (F.col("s") == "F") & (F.col("o_totalprice") > 100000)).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 7 ELSE p_size END AS p_size, CASE WHEN p_size % 5 = 0 THEN 'none' ELSE p_brand END AS p_brand FROM part")
def required_and_default(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_size") % 3 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("p_size"), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_brand")).alias("p_brand")
    )
    cols = (ColumnSpec("p_partkey", "int64", index=0, required=True), ColumnSpec("p_size", "int32", index=1, missing="default", default=7), ColumnSpec("p_brand", index=2, missing="default", default="none"))
    return spec.apply(text_raw(p), RowSpec(cols), text_only=True)


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS nullable, CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE value END AS defaulted FROM events")
def nullable_vs_default(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    mutated = F.when(F.col("event_id") % 8 == 0, "").when(F.col("event_id") % 4 == 0, "1d").otherwise(convert.number_text(F.col("value")))
    e = e.select("event_id", mutated.alias("a"), mutated.alias("b"))
    return spec.apply(text_raw(e), RowSpec((ColumnSpec("event_id", "int64", index=0), ColumnSpec("nullable", "double", index=1), ColumnSpec("defaulted", "double", index=2, missing="default", default=0.0))), text_only=True)


@query(
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false ELSE NULL END AS flag FROM documents"""
)
def bool_strict(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    forms = F.array(*[F.lit(x) for x in ("TRUE", "false", "1", "0", "yes", " true")])
    d = d.withColumn("t", F.get(forms, (F.col("doc_id") % 6).cast("int")))
    return spec.apply(text_raw(d), RowSpec((ColumnSpec("doc_id", "int64", index=0), ColumnSpec("flag", "bool", index=1))), text_only=True)


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents FROM lineitem")
def decimal_exact(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    cols = (ColumnSpec("l_orderkey", "int64", index=0), ColumnSpec("l_linenumber", "int32", index=1), ColumnSpec("p", lambda c: convert.decimal(c, 18, 2), index=2))
    t = spec.apply(text_raw(li), RowSpec(cols), text_only=True)
    return t.select("l_orderkey", "l_linenumber", (F.col("p") * 100).cast("long").alias("cents"))


_PRIORITIES = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5}


@query("SELECT o_orderkey, o_orderpriority AS by_name, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS by_value FROM orders")
def enum_parse(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    number = F.when(F.col("o_orderkey") % 7 == 0, "9").otherwise(F.substring("o_orderpriority", 1, 1))
    o = o.select("o_orderkey", F.lower("o_orderpriority").alias("a"), number.alias("b"))
    e = convert.enum(_PRIORITIES)
    return spec.apply(text_raw(o), RowSpec((ColumnSpec("o_orderkey", "int64", index=0), ColumnSpec("by_name", e, index=1), ColumnSpec("by_value", e, index=2))), text_only=True)


@query(
    """SELECT o_orderkey AS id, o_orderdate AS d1900, o_orderdate AS d1904 FROM orders
    UNION ALL SELECT * FROM (VALUES (-1, TIMESTAMP '1899-12-31', TIMESTAMP '1904-01-01'), (-2, TIMESTAMP '1900-02-28', TIMESTAMP '1904-02-29'),
    (-3, TIMESTAMP '1900-02-28', TIMESTAMP '1904-03-01'), (-4, TIMESTAMP '1900-03-01', TIMESTAMP '1904-03-02'))"""
)
def excel_serial_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate")
    days = F.timestamp_diff("SECOND", F.lit("1899-12-30 00:00:00").cast("timestamp_ntz"), F.col("o_orderdate").cast("timestamp_ntz")) / 86400.0
    rows = o.select("id", days.alias("a"), (days - 1462).alias("b"))
    fixed = spark.sql("SELECT * FROM VALUES (-1L, 0D, 0D), (-2L, 59D, 59D), (-3L, 60D, 60D), (-4L, 61D, 61D) AS t(id, a, b)")
    # serial 59 is 28 February in the 1900 system; 60, the day that never was, is the day before 1 March as OLE dates have it
    both = rows.union(fixed)
    return both.select("id", convert.serial_timestamp(F.col("a")).alias("d1900"), convert.serial_timestamp(F.col("b"), True).alias("d1904"))


@query("SELECT event_id, CAST(epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS BIGINT) AS clock FROM events")
def time_of_day(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "HH:mm:ss.SSSSSS").alias("t"))
    return spec.apply(text_raw(e), RowSpec((ColumnSpec("event_id", "int64", index=0), ColumnSpec("clock", "time", index=1))), text_only=True)


@query("SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation")
def header_binding_alias(spark, sf_dir):
    """Headers that differ in case, spaces and diacritics, in another order, found by aliases."""
    n = table(spark, sf_dir, "nation")
    data = rendering.raw_rows(n.select("n_regionkey", "n_name", "n_nationkey"), F.col("n_nationkey") + 1)
    head = spark.createDataFrame([(0, [("s", "  Régión   Id ", None), ("s", "NAME", None), ("s", "Cle", None)])], f"row_idx long, cells array<{convert.CELL}>")
    cols = (ColumnSpec("key", "int32", aliases=("clé",)), ColumnSpec("name"), ColumnSpec("region", "int32", aliases=("nothing", "region id")))
    return spec.apply(head.unionByName(data), RowSpec(cols, normalization=frozenset(spec.NORMALIZATIONS)))


@query("SELECT * FROM (VALUES (0, 'Qty', 'int64', false), (1, 'Ratio', 'float64', false), (2, 'Code', 'string', false), (3, 'Signed', 'int64', true), (4, 'Day', 'date', false), (5, 'Flag', 'bool', false)) t(index, name, type, nullable)")
def infer_schema_text(spark, sf_dir):
    """Inference over text with zero-padded codes, signs, a blank, dates, and booleans mixed with 0 and 1."""
    lines = ["Qty,Ratio,Code,Signed,Day,Flag", "1,0.5,00123,-0,2024-01-31,true", "2,1,00456,,2024-02-01,1", "30,2.25,7,+5,2024-03-01,FALSE"]
    cell = lambda x: ("s", x, None) if x else None
    raw = spark.createDataFrame([(i, [cell(x) for x in line.split(",")]) for i, line in enumerate(lines)], f"row_idx long, cells array<{convert.CELL}>")
    return infer.infer_schema(raw, parse_text=True)


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_roundtrip_documents(spark, sf_dir):
    """Whole documents, with their line ends, quotes and commas, empty texts and nulls, through written CSV files and the exact scan.

    The scan takes whole files, so they are written with few rows each.
    """
    from ..sources import delimited

    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    path = scratch(spark)
    rendering.write_csv(d, path, header=False, rows=4_000)
    cols = (ColumnSpec("doc_id", "int64", index=0), ColumnSpec("text", index=1), ColumnSpec("lang", index=2), ColumnSpec("source", index=3), ColumnSpec("n_chars", "int64", index=4))
    return spec.apply(delimited.scan_raw(spark, path, keep_empty=True), RowSpec(cols), text_only=True, keep_blank=True)


@query("SELECT * FROM (VALUES (';', '\"')) t(delimiter, quote)")
def csv_sniff(spark, sf_dir):
    from ..sources.dialect import sniff_file

    path = scratch(spark)
    rendering.write_csv(table(spark, sf_dir, "nation"), path, delimiter=";")
    d = sniff_file(spark, path)
    return spark.createDataFrame([(d.delimiter, d.quote)], "delimiter string, quote string")


@query("SELECT * FROM (VALUES (0, 3, 'a|b|c'), (1, 1, ''), (2, 4, 'xy|2|3|4'), (3, 2, 'p\nq|r'), (4, 1, 'open, end')) t(row_idx, n, joined)")
def csv_raw_ragged_blank(spark, sf_dir):
    """Ragged rows, a blank line, text after a quote, a quoted line end, an unterminated quote."""
    from ..sources import delimited, workbook

    path = scratch(spark)
    workbook.store(spark, f"{path}/a.csv", b'a,b,c\r\n\r\n"x"y,2,3,4\n"p\nq",r\r"open, end')
    raw = delimited.scan_raw(spark, f"{path}/a.csv")
    return raw.select(F.col("row_idx").cast("int").alias("row_idx"), F.size("cells").alias("n"), F.array_join(F.transform("cells", lambda c: F.coalesce(c["text"], F.lit(""))), "|").alias("joined"))


@query("SELECT batch, n FROM (SELECT (rn - 1) // 1000 AS batch, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) GROUP BY 1)")
def batch_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return dataflow.batch_numbers(o, "o_orderkey", 1000).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT part, n_nationkey, n_name, total FROM (SELECT CASE WHEN rn <= 5 THEN 'head' ELSE 'tail' END AS part, n_nationkey, n_name, total, rn
    FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS rn, count(*) OVER () AS total FROM nation) WHERE rn <= 5 OR rn > total - 5)"""
)
def preview_head_tail(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    head, tail, total = dataflow.preview(n, 10, "n_nationkey")
    rows = [("head", r[0], r[1], total) for r in head] + [("tail", r[0], r[1], total) for r in tail]
    return spark.createDataFrame(rows, "part string, n_nationkey int, n_name string, total long")


def _parts_roundtrip(spark, sf_dir, file_format, name, order, specs):
    """A table as a folder of workbooks, for it may have more rows than a sheet."""
    from ..sources import workbook

    path = f"{scratch(spark)}/{name}"
    workbook.write_parts(table(spark, sf_dir, name).withColumn("__order", F.col(order)), path, "__order", name, file_format)
    return workbook.read_typed(spark, f"{path}/*.{file_format}", RowSpec(specs))


_ORDERS = (
    ColumnSpec("o_orderkey", "int64", required=True),
    ColumnSpec("o_custkey", "int64"),
    ColumnSpec("o_orderstatus"),
    ColumnSpec("o_totalprice", "double"),
    ColumnSpec("o_orderdate", "timestamp"),
    ColumnSpec("o_orderpriority"),
)
_ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


@query(_ORDERS_SQL)
def xlsx_roundtrip(spark, sf_dir):
    return _parts_roundtrip(spark, sf_dir, "xlsx", "orders", "o_orderkey", _ORDERS)


@query(_ORDERS_SQL)
def xlsb_roundtrip(spark, sf_dir):
    return _parts_roundtrip(spark, sf_dir, "xlsb", "orders", "o_orderkey", _ORDERS)


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def xls_roundtrip(spark, sf_dir):
    cols = (ColumnSpec("c_custkey", "int64"), ColumnSpec("c_name"), ColumnSpec("c_nationkey", "int32"), ColumnSpec("c_acctbal", "double"), ColumnSpec("c_mktsegment"))
    return _parts_roundtrip(spark, sf_dir, "xls", "customer", "c_custkey", cols)


@query("SELECT s_name, s_acctbal FROM supplier")
def table_view_range(spark, sf_dir):
    """A named table on a sheet, read by name and bound by its headers."""
    from ..sources import workbook

    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    path = f"{scratch(spark)}/supplier.xlsx"
    workbook.write([("data", s)], path, "s_suppkey", table="Suppliers")
    return workbook.read_raw(spark, path, table="suppliers").transform(lambda r: spec.apply(r, RowSpec((ColumnSpec("s_name"), ColumnSpec("s_acctbal", "double")))))


@query("SELECT r_regionkey, r_name FROM region")
def encrypted_roundtrip(spark, sf_dir):
    from ..sources import workbook

    path = f"{scratch(spark)}/region.xlsx"
    workbook.write([("r", table(spark, sf_dir, "region").withColumn("__o", F.col("r_regionkey")))], path, "__o", password="secret")
    return spec.apply(workbook.read_raw(spark, path, password="secret"), RowSpec((ColumnSpec("r_regionkey", "int32"), ColumnSpec("r_name"))))


@query("SELECT * FROM (VALUES (0, 'first', 'visible'), (1, 'second', 'hidden'), (2, 'third', 'very_hidden')) t(index, name, visibility)")
def sheet_listing(spark, sf_dir):
    from ..sources import workbook

    r = table(spark, sf_dir, "region").withColumn("__o", F.col("r_regionkey"))
    path = f"{scratch(spark)}/book.xlsb"
    workbook.write([("first", r), ("second", r), ("third", r)], path, "__o", visibility={"second": "hidden", "third": "very_hidden"})
    return workbook.sheets(spark, path).select("index", "name", "visibility")


@query("SELECT s_suppkey, CASE WHEN s_nationkey < 12 THEN s_acctbal ELSE -s_acctbal END AS n FROM supplier")
def multi_file_headers(spark, sf_dir):
    """Two files whose columns stand in different places, bound each by its own header."""
    from ..sources import workbook

    s = table(spark, sf_dir, "supplier").withColumn("__o", F.col("s_suppkey"))
    path = scratch(spark)
    workbook.write([("a", s.where("s_nationkey < 12").select("__o", "s_suppkey", F.col("s_acctbal").alias("n")))], f"{path}/a.xlsx", "__o")
    workbook.write([("a", s.where("s_nationkey >= 12").select("__o", (-F.col("s_acctbal")).alias("n"), "s_name", "s_suppkey"))], f"{path}/b.xlsx", "__o")
    return workbook.read_typed(spark, f"{path}/*.xlsx", RowSpec((ColumnSpec("s_suppkey", "int64"), ColumnSpec("n", "double"))))


@query("SELECT n_nationkey, n_name FROM nation")
def table_view_offset(spark, sf_dir):
    """A named table that starts at D5, beside other cells, with a row of totals."""
    from ..sources import workbook, xlsx
    from ..sources.cells import Table
    from ..sources.styles import Styles

    rows = [(r["n_nationkey"], r["n_name"]) for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    cells = [(0, [("s", "title", None)]), (4, [("s", "x", None), None, None, ("s", "n_nationkey", None), ("s", "n_name", None), ("s", "beside", None)])]
    cells += [(5 + i, [("s", "x", None), None, None, ("n", str(k), float(k)), ("s", name, None)]) for i, (k, name) in enumerate(rows)]
    cells += [(5 + len(rows), [None, None, None, ("n", "999", 999.0), ("s", "total", None)])]
    view = Table("Nations", 0, 4, 5 + len(rows), 3, 4, totals_rows=1, columns=("n_nationkey", "n_name"))
    path = f"{scratch(spark)}/nation.xlsx"
    workbook.store(spark, path, xlsx.package([{"name": "S", "fragments": [xlsx.row_xml(n, r) for n, r in cells], "tables": [view]}], Styles().xml()))
    return workbook.read_typed(spark, path, RowSpec((ColumnSpec("n_nationkey", "int32"), ColumnSpec("n_name"))), table="nations")


@query("SELECT r_regionkey, TIMESTAMP '1904-01-01' + to_days(CAST(r_regionkey * 1000 AS INTEGER)) AS d FROM region")
def date1904_read(spark, sf_dir):
    """Dates of a workbook of the 1904 date system, through the typed read."""
    from ..sources import workbook, xlsx
    from ..sources.styles import Styles

    keys = [r["r_regionkey"] for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    cells = [(0, [("s", "r_regionkey", None), ("s", "d", None)])] + [(i + 1, [("n", str(k), float(k)), ("d", None, k * 1000.0)]) for i, k in enumerate(keys)]
    path = f"{scratch(spark)}/dates.xlsx"
    workbook.store(spark, path, xlsx.package([{"name": "S", "fragments": [xlsx.row_xml(n, r) for n, r in cells]}], Styles().xml(), date1904=True))
    return workbook.read_typed(spark, path, RowSpec((ColumnSpec("r_regionkey", "int32"), ColumnSpec("d", "timestamp"))))
