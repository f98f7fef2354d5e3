"""Command line: sheets, schema, preview, convert. Errors go to stderr with exit code 1.

    python -m tabweave.cli sheets FILE
    python -m tabweave.cli schema FILE [--sheet S] [--header-row N]
    python -m tabweave.cli preview FILE [--sheet S] [--rows N] [--columns A,B] [--max-columns N] [--max-width N] [--fast]
    python -m tabweave.cli convert FILE TARGET [--sheet S]
"""

from __future__ import annotations

import argparse
import itertools
import sys
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import convert, infer
from .functions.spec import read_header
from .operators import dataflow, rendering
from .sources import delimited, workbook
from .sources.dialect import sniff_file

# Names of inferred types as shown.
SHOWN = {"string": "string", "int64": "int64", "float64": "float64", "bool": "bool", "date": "date", "timestamp": "timestamp"}


def _raw(spark: SparkSession, path: str, sheet: str | None, password: str | None) -> tuple[DataFrame, bool]:
    if path.lower().endswith((".csv", ".tsv", ".txt")):
        return delimited.scan_raw(spark, path, sniff_file(spark, path)), True
    return workbook.read_raw(spark, path, sheet, password=password), False


def _encoded(lines: Iterable[str], size: int = 1 << 20) -> Iterator[bytes]:
    """The lines in blocks of about ``size`` characters, so that no more are held."""
    block, held = [], 0
    for text in lines:
        block.append(text + "\r\n")
        held += len(text)
        if held >= size:
            yield "".join(block).encode()
            block, held = [], 0
    yield "".join(block).encode()


def select_columns(names: Sequence[str | None], wanted: str | None) -> list[int]:
    """Columns by name first, then by number from 0."""
    if not wanted:
        return list(range(len(names)))
    out = []
    for w in wanted.split(","):
        lower = [(n or "").lower() for n in names]
        if w.lower() in lower:
            out.append(lower.index(w.lower()))
        elif w.isdigit() and int(w) < len(names):
            out.append(int(w))
        else:
            raise ValueError(f"no column {w!r}")
    return out


def shown(cell: Column, kind: str) -> Column:
    """A cell of a column of an inferred type as a preview shows it: dates in ISO form, whole floats with ``.0``."""
    text = convert.string(cell)
    at = convert.READERS["timestamp_serial"](cell)
    stamp = F.when((F.lit(kind) != "timestamp") & (at == F.date_trunc("day", at)), at.cast("date").cast("string")).otherwise(at.cast("string"))
    out = F.when(cell["type"] == "d", F.coalesce(stamp, text)).when(cell["type"] == "b", F.lower(text))
    if kind == "float64":
        out = out.when(cell["num"].isNotNull() & ~text.rlike("[.EeNI]"), F.concat(text, F.lit(".0")))
    return F.coalesce(out.otherwise(text), F.lit(""))


def elided(items: Sequence, most: int) -> list:
    """``items``, or of more than ``most`` the first and last with a mark between them."""
    if most <= 0 or len(items) <= most:
        return list(items)
    head = -(-most // 2)
    return [*items[:head], "...", *items[len(items) - (most - head) :]]


def fitted(text: str, width: int) -> str:
    return text if width <= 0 or len(text) <= width else text[: max(width - 1, 0)] + "\u2026"


def run(spark: SparkSession, argv: Sequence[str], out=sys.stdout) -> None:
    p = argparse.ArgumentParser(prog="tabweave")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("sheets", "schema", "preview", "convert"):
        c = sub.add_parser(name)
        c.add_argument("file")
        if name == "convert":
            c.add_argument("target")
        c.add_argument("--sheet")
        c.add_argument("--password")
        c.add_argument("--header-row", type=int, default=1)
        if name == "preview":
            c.add_argument("--rows", type=int, default=10)
            c.add_argument("--columns")
            c.add_argument("--max-columns", type=int, default=8)
            c.add_argument("--max-width", type=int, default=32)
            c.add_argument("--fast", action="store_true")
    a = p.parse_args(argv)
    if a.command == "sheets":
        rows = [(0, "")] if a.file.lower().endswith(".csv") else [(r["index"], r["name"]) for r in workbook.sheets(spark, a.file, a.password).orderBy("index").collect()]
        for k, n in rows:
            print(f"{k}\t{n}", file=out)
        return
    raw, is_csv = _raw(spark, a.file, a.sheet, a.password)
    if a.command == "schema":
        for r in infer.infer_schema(raw, a.header_row).collect():
            print(f"{r['index']}\t{r['name'] or ''}\t{SHOWN[r['type']]}{'?' if r['nullable'] else ''}", file=out)
        return
    names = read_header(raw, a.header_row)
    if a.command == "preview":
        at = select_columns(names, a.columns)
        kinds = {r["index"]: r["type"] for r in infer.infer_schema(raw, a.header_row).collect()}
        cells = [shown(F.get("cells", F.lit(i)), kinds.get(i, "string")).alias(f"c{i}") for i in at]
        head, tail, total = dataflow.preview(raw.where(F.col("row_idx") >= a.header_row).select("row_idx", *cells), a.rows, "row_idx", a.fast)

        def line(values: Sequence[str]) -> str:
            return "\t".join(fitted(v, a.max_width) for v in elided(values, a.max_columns))

        print(line([names[i] or "" for i in at]), file=out)
        for r in head:
            print(line(r[1:]), file=out)
        if tail:
            print("...", file=out)
        for r in tail:
            print(line(r[1:]), file=out)
        print(f"{'?' if total is None else total} rows", file=out)
        return
    typed = workbook.read_inferred(raw.select("row_idx", "cells"), a.header_row, parse_text=is_csv)
    order = "__order"
    schema = typed.columns
    ordered = raw.where(F.col("row_idx") >= a.header_row)
    kinds = infer.infer_schema(raw, a.header_row, parse_text=is_csv).collect()
    cols = [convert.READERS[infer.READERS[r["type"]]](F.get("cells", F.lit(r["index"]))).alias(n) for r, n in zip(kinds, schema, strict=True)]
    df = ordered.select(F.col("row_idx").alias(order), *cols)
    if a.target.lower().endswith(".csv"):
        lines = df.orderBy(order).drop(order)
        records = rendering.csv_lines(lines).toLocalIterator()
        workbook.store(spark, a.target, _encoded(itertools.chain([rendering.csv_header(spark, schema)], (r["line"] for r in records))))
    else:
        workbook.write([(a.sheet or "Sheet1", df)], a.target, order)


def main() -> int:
    spark = SparkSession.builder.appName("tabweave").config("spark.ui.enabled", "false").getOrCreate()
    try:
        run(spark, sys.argv[1:])
        return 0
    except Exception as e:  # noqa: BLE001  a command line tells any error in one line
        print(str(e).splitlines()[0] if str(e) else type(e).__name__, file=sys.stderr)
        return 1
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
