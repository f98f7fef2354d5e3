"""Schema inference from sampled rows, as one aggregate over the cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import convert
from .spec import SpecError, read_header

#: Spark type of each inferred kind.
TYPES = {"string": "string", "int64": "bigint", "float64": "double", "bool": "boolean", "date": "date", "timestamp": "timestamp_ntz"}
READERS = {"string": "string", "int64": "int64", "float64": "double", "bool": "bool", "date": "date_auto", "timestamp": "timestamp_auto"}


def _kind(cell: Column, date1904: bool, parse_text: bool) -> Column:
    """One of: string, int, bit (an int of 0 or 1), float, bool, date, timestamp, error; null for an empty cell."""
    t = cell["text"]
    canonical = t.rlike(r"^[+-]?([0-9]?|[1-9][0-9]*)([^0-9].*)?$")
    digits = t.rlike(r"^[+-]?[0-9]+$")
    iso = convert.iso_timestamp(t)
    text_kind = F.lit("string")
    if parse_text:
        text_kind = (
            F.when(canonical & digits, F.when(t.isin("0", "1"), "bit").when(convert.integer(cell).isNotNull(), "int").otherwise("string"))
            .when(canonical & t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), "float")
            .when(F.lower(t).isin("true", "false"), "bool")
            .when(iso.isNotNull(), F.when(F.length(t) == 10, "date").otherwise("timestamp"))
            .otherwise("string")
        )
    moment = convert.serial_timestamp(cell["num"], date1904)
    whole = convert.integer(cell).isNotNull()
    number = F.when(~whole, "float").when(F.coalesce(t.isin("0", "1"), cell["num"].isin(0.0, 1.0)), "bit").otherwise("int")
    return (
        F.when(cell.isNull(), None)
        .when(cell["type"] == "s", text_kind)
        .when(cell["type"] == "n", number)
        .when(cell["type"] == "d", F.when(moment.cast("date").cast("timestamp_ntz") < moment, "timestamp").otherwise("date"))
        .when(cell["type"] == "b", "bool")
        .otherwise("error")
    )


def infer_schema(raw: DataFrame, header_row: int = 1, sample: int = 100, parse_text: bool = False, date1904: bool = False) -> DataFrame:
    """(index, name, type, nullable) by column, from the first ``sample`` rows after the header."""
    if header_row < 1:
        raise SpecError("header_row starts at 1")
    names = read_header(raw, header_row)
    spark = raw.sparkSession
    rows = raw.where(F.col("row_idx") >= header_row).orderBy("row_idx").limit(sample)
    seen = rows.select("row_idx", F.posexplode("cells").alias("index", "cell")).withColumn("kind", _kind(F.col("cell"), date1904, parse_text))
    total = rows.agg(F.count(F.lit(1)).alias("rows"))
    stats = seen.groupBy("index").agg(F.collect_set("kind").alias("kinds"), F.count("kind").alias("filled"))
    header = spark.createDataFrame([(i, (n or "").strip() or None) for i, n in enumerate(names)], "index int, name string")
    joined = header.join(stats, "index", "full").crossJoin(F.broadcast(total))  # one row
    kinds = F.coalesce("kinds", F.array().cast("array<string>"))
    has = lambda *ks: F.arrays_overlap(kinds, F.array(*[F.lit(k) for k in ks]))
    collapsed = F.lit(parse_text) & has("bool") & has("bit") & ~has("int", "float")
    groups = has("int", "bit", "float").cast("int") * F.when(collapsed, 0).otherwise(1) + has("date", "timestamp").cast("int") + has("bool").cast("int") + has("string").cast("int")
    kind = (
        F.when(has("error") | has("string") | (groups != 1), "string")
        .when(has("timestamp"), "timestamp")
        .when(has("date"), "date")
        .when(has("bool"), "bool")
        .when(has("float"), "float64")
        .otherwise("int64")
    )
    return joined.select("index", "name", kind.alias("type"), ((F.coalesce("filled", F.lit(0)) < F.col("rows")) | (F.col("rows") == 0)).alias("nullable")).orderBy("index")
