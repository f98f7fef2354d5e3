"""What the workbook codecs share: cells, sheets, date formats, limits."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

#: (type, text, num): types as in ``tabweave.functions.convert``; an empty cell is None.
Cell = tuple[str, str | None, float | None]
Row = tuple[int, list[Cell | None]]

# Error codes of binary formats.
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}

# Built-in number formats that are dates, as inclusive ranges of ids.
DATE_FORMATS = ((14, 22), (27, 36), (45, 47), (50, 58), (71, 81))

VISIBILITY = ("visible", "hidden", "very_hidden")

# Limits of a sheet.
MAX_COLUMNS, MAX_ROWS, MAX_TEXT = 16_384, 1_048_576, 32_767


class WorkbookError(ValueError):
    """Data that isn't a readable workbook."""


class LimitExceeded(WorkbookError):
    """Data beyond a limit of ``Limits``."""


@dataclass(frozen=True)
class Limits:
    decompressed: int = 512 << 20
    cell: int = 32 << 20
    shared_strings: int = 128 << 20
    entries: int = 65_536


@dataclass
class Table:
    """A named rectangle of a sheet; rows and columns from 0, last ones included."""

    name: str
    sheet: int
    first_row: int
    last_row: int
    first_column: int
    last_column: int
    header_rows: int = 1
    totals_rows: int = 0
    columns: tuple[str, ...] = ()
    id: int = 0


@dataclass
class Workbook:
    format: str
    date1904: bool = False
    sheets: list[tuple[str, str]] = field(default_factory=list)  # name, visibility
    tables: list[Table] = field(default_factory=list)
    read: Callable[[int], Iterator[Row]] = lambda index: iter(())

    def sheet_index(self, which: str | int | None) -> int:
        """A sheet by name in any case, then by its number; the first if None."""
        if which is None:
            which = 0
        names = [n.lower() for n, _ in self.sheets]
        if isinstance(which, str) and which.lower() in names:
            return names.index(which.lower())
        if str(which).isdigit() and int(which) < len(names):
            return int(which)
        raise WorkbookError(f"no sheet {which!r}")

    def table(self, name: str) -> Table:
        for t in self.tables:
            if t.name.lower() == name.lower():
                return t
        raise WorkbookError(f"no table {name!r}")

    def table_rows(self, t: Table) -> Iterator[Row]:
        """The table's header and data rows, totals left out; columns keep their places on the sheet."""
        last, before = t.last_row - t.totals_rows, -1
        for row, cells in self.read(t.sheet):
            if row <= before:
                raise WorkbookError("rows of the sheet aren't in order")
            before = row
            if row > last:
                return
            if row >= t.first_row:
                yield row, [None] * t.first_column + cells[t.first_column : t.last_column + 1]


def is_date_format(number: int, code: str | None = None) -> bool:
    """By the built-in id, or by a code with a date letter outside quotes, brackets and escapes."""
    if code is None:
        return any(a <= number <= b for a, b in DATE_FORMATS)
    bare = re.sub(r'"[^"]*"?|\[[^\]]*\]?|\\.', "", code)
    return bool(re.search("[ymdhsYMDHS]", bare))


def place(cells: list[Cell | None], column: int, cell: Cell | None) -> None:
    if column >= MAX_COLUMNS:
        raise LimitExceeded(f"column {column}")
    if column < len(cells):
        cells[column] = cell
        return
    cells.extend([None] * (column - len(cells)))
    cells.append(cell)


def rk(value: int) -> float:
    """A packed number: bit 0 divides by 100, bit 1 marks an integer, else it is a double's high 30 bits."""
    import struct

    if value & 2:
        number = float((value >> 2) - (1 << 30 if value & 0x80000000 else 0))
    else:
        number = struct.unpack("<d", struct.pack("<II", 0, value & 0xFFFFFFFC))[0]
    return number / 100 if value & 1 else number


@cache
def column_name(index: int) -> str:
    out = ""
    index += 1
    while index:
        index, r = divmod(index - 1, 26)
        out = chr(65 + r) + out
    return out


def column_index(ref: str) -> int:
    n = 0
    for ch in ref:
        if not "A" <= ch <= "Z":
            break
        n = n * 26 + ord(ch) - 64
    return n - 1


def area(ref: str) -> tuple[int, int, int, int]:
    """First row, last row, first column, last column of a reference like C4:E8."""
    a, _, b = ref.replace("$", "").partition(":")
    b = b or a
    row = lambda x: int(re.sub("[A-Z]", "", x)) - 1
    return row(a), row(b), column_index(a), column_index(b)
