"""CSV scans.

``scan_typed`` is the fast path: Spark's own parser, splittable unless quoted fields may hold line ends; blank
lines are skipped, as in typed reads. ``scan_raw`` is exact: it keeps every field of ragged rows and blank lines
(one empty field), appends text that follows a closing quote, and reads an unterminated quote to the end.
The exact scan takes a file a task; rows are numbered from 0 in each file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import convert
from .dialect import Dialect, byte_order_mark
from .shipping import ship

RAW = f"path string, row_idx long, cells array<{convert.CELL}>"


def records(text: str, delimiter: str = ",", quote: str = '"', bare: str | None = "") -> Iterator[list[str | None]]:
    """The records of a text. A quote counts only at a field's start; CR, LF and CR LF all end a record. ``bare``: what an empty field without quotes gives."""
    d, q = re.escape(delimiter), re.escape(quote)
    plain = re.compile(f"[^{d}\r\n]*")
    quoted = re.compile(f"((?:[^{q}]|{q}{q})*)({q}|$)")
    at, n = 0, len(text)
    row: list[str] = []
    while at < n:
        head, empty = "", bare
        if text[at] == quote:
            m = quoted.match(text, at + 1)
            head, empty = m[1].replace(quote * 2, quote), ""
            at = m.end()
        m = plain.match(text, at)
        row.append(head + m[0] or empty)
        at = m.end()
        if at >= n:
            break
        end = text[at]
        at += 1
        if end == delimiter:
            if at >= n:
                row.append(bare)
            continue
        if end == "\r" and at < n and text[at] == "\n":
            at += 1
        yield row
        row = []
    if row:
        yield row


def decode(data: bytes, encoding: str | None = None, keep_bom: bool = False) -> str:
    found, skip = byte_order_mark(data)
    if keep_bom:
        skip = 0
    return data[skip:].decode(encoding or found or "utf-8", "replace")


def scan_raw(spark: SparkSession, path: str, dialect: Dialect | None = None, batch: int = 10_000, keep_empty: bool = False) -> DataFrame:
    """Raw rows of every file: path, row_idx, and cells as text (null for an empty field; with ``keep_empty`` a quoted one is the empty text)."""
    ship(spark)
    d = dialect or Dialect()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("type", pa.string()), ("text", pa.string()), ("num", pa.float64())]))
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, first = [], 0
                for r in records(decode(content.as_py(), d.encoding), d.delimiter, d.quote, None if keep_empty else ""):
                    rows.append([{"type": "s", "text": x, "num": None} if x or (keep_empty and x is not None) else None for x in r])
                    if len(rows) == batch:
                        yield _batch(path, first, rows, kind)
                        first, rows = first + len(rows), []
                if rows:
                    yield _batch(path, first, rows, kind)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RAW)


def _batch(path: str, first: int, rows: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(range(first, first + len(rows)), pa.int64()), pa.array(rows, kind)], names=["path", "row_idx", "cells"])


def scan_typed(spark: SparkSession, path: str, columns: list[str], dialect: Dialect | None = None, header: bool = True, multiline: bool = False) -> DataFrame:
    """Text columns by Spark's parser. ``multiline``: quoted fields may hold line ends; then a file isn't split."""
    d = dialect or Dialect()
    reader = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).options(
        sep=d.delimiter, quote=d.quote, escape=d.quote, header=header, multiLine=multiline, encoding=d.encoding or "UTF-8", enforceSchema=True, mode="PERMISSIVE", nullValue="", emptyValue=""
    )
    out = reader.csv(path)
    return out.select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns])


def stream_typed(spark: SparkSession, path: str, columns: list[str], dialect: Dialect | None = None, header: bool = True, files_per_batch: int = 64) -> DataFrame:
    """The same as a stream of new files."""
    d = dialect or Dialect()
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.readStream.schema(schema).options(sep=d.delimiter, quote=d.quote, escape=d.quote, header=header, maxFilesPerTrigger=files_per_batch).csv(path)
