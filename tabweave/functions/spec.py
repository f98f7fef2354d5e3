"""Column specs: what to read, under which header, and what becomes of blank or unreadable cells."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import convert

NORMALIZATIONS = ("trim", "collapse_spaces", "remove_diacritics")


class SpecError(ValueError):
    """A spec that can't be bound: missing, doubled or mixed columns."""


@dataclass(frozen=True)
class ColumnSpec:
    """``type``: a reader's name or a function of a cell Column. Bound by headers (name, then aliases) or by ``index``.

    ``missing``: ``default`` keeps ``default`` for blank and unreadable cells, ``null`` gives null, ``fail`` raises.
    ``required``: the header must exist, and blank or unreadable values raise.
    """

    name: str
    type: str | Callable[[Column], Column] = "string"
    aliases: tuple[str, ...] = ()
    index: int | None = None
    required: bool = False
    missing: str = "null"
    default: object = None

    def converter(self) -> Callable[[Column], Column]:
        if callable(self.type):
            return self.type
        if self.type not in convert.READERS:
            raise SpecError(f"column {self.name}: no reader named {self.type}")
        return convert.READERS[self.type]


@dataclass(frozen=True)
class RowSpec:
    """``header_row``: 1-based; rows before it are skipped. Bound by index, data begin at the first row."""

    columns: tuple[ColumnSpec, ...]
    header_row: int = 1
    normalization: frozenset[str] = field(default_factory=frozenset)
    ignore_case: bool = True
    throw_on_failure: bool = False

    def __post_init__(self) -> None:
        if self.header_row < 1:
            raise SpecError("header_row starts at 1")
        if unknown := set(self.normalization) - set(NORMALIZATIONS):
            raise SpecError(f"unknown normalization: {sorted(unknown)}")
        by_index = [c.index is not None for c in self.columns]
        if any(by_index) and not all(by_index):
            raise SpecError("columns are bound by header or by index, not both")
        names = [c.name.lower() for c in self.columns]
        if len(set(names)) < len(names):
            raise SpecError("two columns of one name")
        used = [c.index for c in self.columns if c.index is not None]
        if len(set(used)) < len(used):
            raise SpecError("two columns of one index")
        for c in self.columns:
            if c.missing not in ("default", "null", "fail"):
                raise SpecError(f"column {c.name}: missing is default, null or fail")
            c.converter()

    @property
    def indexed(self) -> bool:
        return bool(self.columns) and self.columns[0].index is not None


def normalize(header: str, how: frozenset[str], ignore_case: bool = True) -> str:
    if "remove_diacritics" in how:
        header = "".join(ch for ch in unicodedata.normalize("NFD", header) if unicodedata.category(ch) != "Mn")
        header = unicodedata.normalize("NFC", header)
    if "collapse_spaces" in how:
        header = " ".join(header.split(" ")) if "  " not in header else " ".join(x for x in header.split(" ") if x)
    if "trim" in how:
        header = header.strip()
    return header.upper() if ignore_case else header


def bind(header: Sequence[str | None], spec: RowSpec) -> dict[str, int]:
    """Column positions by spec name: the first alias that matches wins, then the leftmost header. All missing required headers are named at once."""
    if spec.indexed:
        return {c.name: c.index for c in spec.columns}
    at: dict[str, int] = {}
    for i, h in enumerate(header):
        if h is not None and h.strip():
            at.setdefault(normalize(h, spec.normalization, spec.ignore_case), i)
    found: dict[str, int] = {}
    lost = []
    for c in spec.columns:
        place = next((at[k] for k in (normalize(a, spec.normalization, spec.ignore_case) for a in (c.name, *c.aliases)) if k in at), None)
        if place is None:
            lost += [c.name] if c.required else []
            continue
        found[c.name] = place
    if lost:
        raise SpecError("missing required headers: " + ", ".join(lost))
    if len(set(found.values())) < len(found):
        twice = [n for n in found if list(found.values()).count(found[n]) > 1]
        raise SpecError("one header for several columns: " + ", ".join(twice))
    return found


def typed(cell: Column, c: ColumnSpec, row_number: Column, throw: bool, blank: Column | None = None) -> Column:
    """The column's value under its policies; errors name the column, the row and the raw value."""
    value = c.converter()(cell)
    blank = cell.isNull() if blank is None else blank
    if c.required or c.missing == "fail" or throw:
        where = F.concat(F.lit(f"column {c.name}, row "), row_number.cast("string"))
        unreadable = F.raise_error(F.concat(where, F.lit(": cannot read '"), F.coalesce(convert.string(cell), F.lit("")), F.lit("'")))
        empty = F.raise_error(F.concat(where, F.lit(": blank"))) if c.required or c.missing == "fail" else None
        if c.missing == "fail" and c.type == "string" and not c.required:
            empty = F.lit("")
        on_blank = empty if empty is not None else F.lit(c.default if c.missing == "default" else None)
        return F.when(blank, on_blank).when(value.isNull(), unreadable).otherwise(value)
    return F.coalesce(value, F.lit(c.default)) if c.missing == "default" else value


def apply(raw: DataFrame, spec: RowSpec, header: Sequence[str | None] | None = None, keep: Sequence[str] = (), text_only: bool = False, headers: DataFrame | None = None, keep_blank: bool = False) -> DataFrame:
    """Typed rows of ``raw`` (row_idx from 0, cells: a dense array of cell structs), header row and rows before it left out.

    ``header``: the header's texts; read from ``raw`` if not given, of each file by itself where ``raw`` has a ``path``.
    ``headers``: raw rows to read them from instead, which spares a scan of all of ``raw``.
    Blank records (no cells, or empty ones only) are skipped, unless ``keep_blank`` takes them as rows. ``text_only``: all cells are text, as in delimited
    files; the plan then drops what only other cells need.
    """
    place = None
    if spec.indexed or header is not None:
        places = bind(header or (), spec)
    else:
        headers = raw if headers is None else headers
        found = read_headers(headers, spec.header_row)
        bound = [(h, bind(h, spec)) for h in found]
        places = bound[0][1]
        if "path" in raw.columns and any(b != places for _, b in bound):
            raw, place = _with_places(raw, headers, spec, bound)
    data = raw if spec.indexed else raw.where(F.col("row_idx") >= spec.header_row)
    if not keep_blank:
        data = data.where(F.exists("cells", lambda c: c.isNotNull()))
    out = [F.col(k) for k in keep]
    for i, c in enumerate(spec.columns):
        if place is not None:
            cell = F.get(F.col("cells"), F.get(F.col(place), F.lit(i)))
        else:
            cell = F.get(F.col("cells"), F.lit(places[c.name])) if c.name in places else F.lit(None).cast(convert.CELL)
        blank = None
        if text_only:
            text = cell["text"]
            cell, blank = F.struct(F.lit("s").alias("type"), text.alias("text"), F.lit(None).cast("double").alias("num")), text.isNull()
        out.append(typed(cell, c, F.col("row_idx") + 1, spec.throw_on_failure, blank).alias(c.name))
    return data.select(*out)


def _header_texts(raw: DataFrame, header_row: int) -> DataFrame:
    return raw.where(F.col("row_idx") == header_row - 1).withColumn("header_texts", F.transform("cells", convert.string))


def _with_places(raw: DataFrame, headers: DataFrame, spec: RowSpec, bound: list[tuple[list, dict[str, int]]]) -> tuple[DataFrame, str]:
    """``raw`` with each file's cell numbers of the spec's columns, and the name of that column. A file without a header row is an error."""
    name = "__places"
    rows = [(h, [b.get(c.name) for c in spec.columns]) for h, b in bound]
    known = raw.sparkSession.createDataFrame(rows, f"known array<string>, {name} array<int>")
    texts = _header_texts(headers, spec.header_row).select(F.col("path").alias("__file"), "header_texts")
    files = texts.join(F.broadcast(known), F.col("header_texts").eqNullSafe(F.col("known"))).select("__file", name)
    lost = F.raise_error(F.concat(F.col("path"), F.lit(f" has fewer than {spec.header_row} rows; cannot resolve the header row"))).cast("array<int>")
    return raw.join(files, F.col("path") == F.col("__file"), "left").drop("__file").withColumn(name, F.coalesce(name, lost)), name


def read_headers(raw: DataFrame, header_row: int) -> list[list[str | None]]:
    """The different headers of all files."""
    rows = _header_texts(raw, header_row).select("header_texts").distinct().collect()
    if not rows:
        raise SpecError(f"sheet has fewer than {header_row} rows; cannot resolve the header row")
    return sorted((list(r[0]) for r in rows), key=lambda h: [(x is not None, x or "") for x in h])


def read_header(raw: DataFrame, header_row: int) -> list[str | None]:
    """One header; of several files', the first in order."""
    return read_headers(raw, header_row)[0]


def from_dataclass(model: type) -> tuple[ColumnSpec, ...]:
    """Specs from a dataclass: types by annotation; ``metadata`` may hold aliases, index, required, missing, type."""
    import dataclasses
    import datetime
    import decimal

    kinds = {int: "int64", float: "double", str: "string", bool: "bool", decimal.Decimal: "decimal", datetime.date: "date", datetime.datetime: "timestamp", datetime.time: "time"}
    hints = {f.name: f for f in dataclasses.fields(model)}
    out = []
    import typing

    types = typing.get_type_hints(model)
    for name, f in hints.items():
        kind = types[name]
        optional = type(None) in typing.get_args(kind)
        if optional:
            kind = next(a for a in typing.get_args(kind) if a is not type(None))
        meta = dict(f.metadata)
        reader = meta.pop("type", kinds.get(kind))
        if reader is None:
            raise SpecError(f"column {name}: unsupported type {kind}")
        default = f.default if f.default is not dataclasses.MISSING else None
        out.append(ColumnSpec(name, reader, missing=meta.pop("missing", "null" if optional or default is None else "default"), default=default, **meta))
    return tuple(out)
