"""Rendering a DataFrame's columns as the text a CSV writer gives them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import convert


def field_text(field: T.StructField) -> Column:
    """Booleans in lower case, dates and times in ISO form, doubles in their shortest text; null stays null."""
    c, k = F.col(f"`{field.name}`"), field.dataType
    if isinstance(k, (T.FloatType, T.DoubleType)):
        return convert.number_text(c.cast("double"))
    if isinstance(k, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0'")
    if isinstance(k, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(k, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        raise ValueError(f"column {field.name}: {k.simpleString()} can't be written")
    return c.cast("string")


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*[field_text(f).alias(f.name) for f in df.schema.fields])


def raw_rows(df: DataFrame, row_idx: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Text columns as raw rows (row_idx, cells), the form that typed parses take; ``keep``: columns passed along."""
    cells = F.array(*[convert.text_cell(field_text(f)) for f in df.schema.fields if f.name not in keep])
    return df.select(row_idx.cast("long").alias("row_idx"), cells.alias("cells"), *keep)


def quoted(text: Column, delimiter: str = ",", quote: str = '"') -> Column:
    """A field as written: quoted only if it holds the delimiter, the quote or a line end, or is the empty text, which a null isn't."""
    special = (text == "") | F.contains(text, F.lit(delimiter)) | F.contains(text, F.lit(quote)) | F.contains(text, F.lit("\n")) | F.contains(text, F.lit("\r"))
    return F.when(special, F.concat(F.lit(quote), F.replace(text, F.lit(quote), F.lit(quote * 2)), F.lit(quote))).otherwise(F.coalesce(text, F.lit("")))


def csv_lines(df: DataFrame, delimiter: str = ",", quote: str = '"') -> DataFrame:
    """One column ``line`` of CSV records. Numbers, booleans and dates are rendered once, as they need no quotes."""
    plain = not set(delimiter + quote) & set("0123456789+-.:ETINafilnrstuey")

    def field(f: T.StructField) -> Column:
        text = field_text(f)
        bare = plain and isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))
        return F.coalesce(text, F.lit("")) if bare else quoted(text, delimiter, quote)

    return df.select(F.concat_ws(delimiter, *[field(f) for f in df.schema.fields]).alias("line"))


def csv_header(spark: SparkSession, names: Sequence[str], delimiter: str = ",", quote: str = '"') -> str:
    return spark.range(1).select(F.concat_ws(delimiter, *[quoted(F.lit(n), delimiter, quote) for n in names])).head()[0]


def write_csv(df: DataFrame, path: str, delimiter: str = ",", quote: str = '"', header: bool = True, line_end: str = "\r\n", rows: int = 0) -> None:
    """A folder of CSV files, in parallel, each with a header. Line ends inside of fields stay as they are.

    ``rows``: a file's most, for readers that take whole files; 0: a file for each partition.
    """
    lines = csv_lines(df, delimiter, quote)
    if header:
        names = csv_header(df.sparkSession, df.columns, delimiter, quote)
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # in its partition
        first = (place % rows if rows else place) == 0
        lines = lines.select(F.concat(F.when(first, names + line_end).otherwise(""), F.col("line")).alias("line"))  # the line is named once
    lines.write.option("lineSep", line_end).option("maxRecordsPerFile", rows).text(path)
