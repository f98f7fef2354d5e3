"""XLSB: the binary records of the package, read and written."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

from .cells import ERRORS, MAX_ROWS, Cell, LimitExceeded, Limits, Row, Table, Workbook, WorkbookError, is_date_format, place, rk
from .xlsx import _HEAD, _PKG, _REL, entry, open_zip, relations

# Record types.
ROW, BLANK, RK, ERROR, BOOL, REAL, ST, ISST, F_STRING, F_NUM, F_BOOL, F_ERROR = range(12)
SST_ITEM, FMT, XF, R_STRING = 19, 44, 47, 62
BEGIN_SHEET, END_SHEET, BEGIN_BOOK, END_BOOK = 129, 130, 131, 132
BEGIN_SHEETS, END_SHEETS, BEGIN_DATA, END_DATA = 143, 144, 145, 146
BOOK_PROPERTIES, SHEET = 153, 156
BEGIN_STYLES, END_STYLES = 278, 279
BEGIN_LIST, BEGIN_LIST_COLUMN = 343, 347
BEGIN_FMTS, END_FMTS, BEGIN_XFS, END_XFS = 615, 616, 617, 618
TABLE_PART = 661

_VISIBLE = {0: "visible", 1: "hidden", 2: "very_hidden"}


def records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(type, payload) of every record; a truncated one is an error."""
    at, n = 0, len(data)
    try:
        while at < n:
            kind = data[at]
            at += 1
            if kind & 0x80:
                kind = kind & 0x7F | (data[at] & 0x7F) << 7
                at += 1
            size = shift = 0
            while True:
                b = data[at]
                at += 1
                size |= (b & 0x7F) << shift
                shift += 7
                if not b & 0x80 or shift == 28:
                    break
            if at + size > n:
                raise WorkbookError("a record is cut off")
            yield kind, data[at : at + size]
            at += size
    except IndexError:
        raise WorkbookError("a record is cut off") from None


def wide(data: bytes, at: int) -> tuple[str, int]:
    (n,) = struct.unpack_from("<I", data, at)
    if n == 0xFFFFFFFF:
        return "", at + 4
    end = at + 4 + 2 * n
    if end > len(data):
        raise WorkbookError("a string is cut off")
    return data[at + 4 : end].decode("utf-16-le", "replace"), end


def sheet_rows(data: bytes, strings: list[str], dates: list[bool], limits: Limits) -> Iterator[Row]:
    row, cells, inside = -1, [], False

    def number(style: int, value: float) -> Cell:
        return ("d" if style < len(dates) and dates[style] else "n", None, value)

    def text(value: str) -> Cell | None:
        return ("s", value, None) if value else None

    try:
        for kind, p in records(data):
            if kind == BEGIN_DATA:
                inside = True
            elif kind == END_DATA:
                break
            elif not inside:
                continue
            elif kind == ROW:
                if row >= 0:
                    yield row, cells
                row, cells = struct.unpack_from("<I", p)[0], []
            elif 1 <= kind <= 11 or kind == R_STRING:
                if len(p) > limits.cell:
                    raise LimitExceeded("cell")
                column, style = struct.unpack_from("<II", p)
                style &= 0xFFFFFF
                cell: Cell | None = None
                if kind == RK:
                    cell = number(style, rk(struct.unpack_from("<I", p, 8)[0]))
                elif kind in (REAL, F_NUM):
                    cell = number(style, struct.unpack_from("<d", p, 8)[0])
                elif kind == ISST:
                    k = struct.unpack_from("<I", p, 8)[0]
                    cell = text(strings[k] if k < len(strings) else "")
                elif kind in (ST, F_STRING):
                    cell = text(wide(p, 8)[0])
                elif kind == R_STRING:
                    cell = text(wide(p, 9)[0])
                elif kind in (BOOL, F_BOOL):
                    cell = ("b", None, float(p[8] != 0))
                elif kind in (ERROR, F_ERROR):
                    cell = ("e", ERRORS.get(p[8], "#ERR"), None)
                if cell is not None:
                    place(cells, column, cell)
    except (struct.error, IndexError) as e:
        raise WorkbookError(str(e)) from None
    if row >= 0:
        yield row, cells


def open_xlsb(data: bytes, limits: Limits | None = None) -> Workbook:
    limits = limits or Limits()
    z = open_zip(data, limits)
    names = set(z.namelist())
    root = next((path for kind, path in relations(z, "/", limits).values() if kind == "officeDocument"), "xl/workbook.bin").lstrip("/")
    rels = relations(z, root, limits)
    by_kind = {kind: path for kind, path in rels.values()}
    book = Workbook("xlsb")
    parts: list[str] = []
    for kind, p in records(entry(z, root, limits.decompressed)):
        if kind == BOOK_PROPERTIES:
            book.date1904 = bool(struct.unpack_from("<I", p)[0] & 1)
        elif kind == SHEET:
            state = struct.unpack_from("<I", p)[0]
            rel, at = wide(p, 8)
            book.sheets.append((wide(p, at)[0], _VISIBLE.get(state, "visible")))
            parts.append(rels[rel][1])
    dates: list[bool] = []
    if by_kind.get("styles") in names:
        codes: dict[int, str] = {}
        inside = False
        for kind, p in records(entry(z, by_kind["styles"], limits.decompressed)):
            if kind == FMT:
                codes[struct.unpack_from("<H", p)[0]] = wide(p, 2)[0]
            elif kind in (BEGIN_XFS, END_XFS):
                inside = kind == BEGIN_XFS
            elif kind == XF and inside:
                k = struct.unpack_from("<H", p, 2)[0]
                dates.append(is_date_format(k, codes.get(k)))
    strings: list[list[str]] = []

    def all_strings() -> list[str]:
        if not strings:
            path = by_kind.get("sharedStrings")
            strings.append([wide(p, 1)[0] for kind, p in records(entry(z, path, limits.shared_strings)) if kind == SST_ITEM] if path in names else [])
        return strings[0]

    for i, part in enumerate(parts):
        for kind, path in relations(z, part, limits).values():
            if kind == "table":
                book.tables.append(_table(entry(z, path, limits.decompressed), i))
    book.tables.sort(key=lambda t: (t.sheet, t.id))
    book.read = lambda i: sheet_rows(entry(z, parts[i], limits.decompressed), all_strings(), dates, limits)
    return book


def _table(data: bytes, sheet: int) -> Table:
    t, columns = None, []
    for kind, p in records(data):
        if kind == BEGIN_LIST:
            r0, r1, c0, c1, _, number, headers, totals = struct.unpack_from("<8I", p)
            name, at = wide(p, 64)
            shown, _ = wide(p, at)
            t = Table(shown or name, sheet, r0, r1, c0, c1, headers, totals, id=number)
        elif kind == BEGIN_LIST_COLUMN:
            _, at = wide(p, 24)
            columns.append(wide(p, at)[0])
    if t is None:
        raise WorkbookError("a table part without a table")
    t.columns = tuple(columns)
    return t


# ---- writing


def record(kind: int, payload: bytes = b"") -> bytes:
    head = bytes([kind]) if kind < 128 else bytes([kind & 0x7F | 0x80, kind >> 7])
    n, size = len(payload), b""
    while True:
        size += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
        n >>= 7
        if not n:
            return head + size + payload


def wide_bytes(text: str) -> bytes:
    raw = text.encode("utf-16-le", "surrogatepass")
    return struct.pack("<I", len(raw) // 2) + raw


def row_bytes(number: int, cells: list[Cell | None], date_style: int = 1) -> bytes:
    """A row's records; ``number`` from 0."""
    if number >= MAX_ROWS:
        raise LimitExceeded(f"row {number}")
    out = [record(ROW, struct.pack("<IIHBBBI", number, 0, 300, 0, 0, 0, 0))]
    for c, cell in enumerate(cells):
        if cell is None:
            continue
        kind, text, num = cell
        head = struct.pack("<II", c, date_style if kind == "d" else 0)
        if kind == "s":
            out.append(record(ST, head + wide_bytes(text)))
        elif kind == "b":
            out.append(record(BOOL, head + bytes([int(num)])))
        elif kind == "e":
            out.append(record(ERROR, head + bytes([next((k for k, v in ERRORS.items() if v == text), 0x2A)])))
        else:
            out.append(record(REAL, head + struct.pack("<d", num)))
    return b"".join(out)


def _styles(codes: list[tuple[int, str]], formats: list[int]) -> bytes:
    """Styles by number format only: one of cell style 0 and one for each format."""
    out = [record(BEGIN_STYLES)]
    if codes:
        out += [record(BEGIN_FMTS, struct.pack("<I", len(codes)))] + [record(FMT, struct.pack("<H", k) + wide_bytes(c)) for k, c in codes] + [record(END_FMTS)]
    out.append(record(BEGIN_XFS, struct.pack("<I", len(formats))))
    out += [record(XF, struct.pack("<HHHHHBBHBB", 0, f, 0, 0, 0, 0, 0, 0, 0, 0)) for f in formats]
    out += [record(END_XFS), record(END_STYLES)]
    return b"".join(out)


def package(sheets: list[dict], date_code: str = "yyyy-mm-dd hh:mm:ss", date1904: bool = False) -> bytes:
    """A package of ``sheets``: name, visibility, fragments (records of rows in order), tables."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        book = [record(BEGIN_BOOK), record(BOOK_PROPERTIES, struct.pack("<II", int(date1904), 0) + wide_bytes("")), record(BEGIN_SHEETS)]
        types, rels, n_table = [], [], 0
        for i, sheet in enumerate(sheets, 1):
            state = next(k for k, v in _VISIBLE.items() if v == sheet.get("visibility", "visible"))
            book.append(record(SHEET, struct.pack("<II", state, i) + wide_bytes(f"rId{i}") + wide_bytes(sheet["name"])))
            rels.append(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.bin"/>')
            types.append(f'<Override PartName="/xl/worksheets/sheet{i}.bin" ContentType="application/vnd.ms-excel.worksheet"/>')
            tables = sheet.get("tables", [])
            with z.open(f"xl/worksheets/sheet{i}.bin", "w", force_zip64=True) as f:
                f.write(record(BEGIN_SHEET) + record(BEGIN_DATA))
                for fragment in sheet["fragments"]:
                    f.write(fragment)
                f.write(record(END_DATA))
                if tables:
                    f.write(record(660, struct.pack("<I", len(tables))) + b"".join(record(TABLE_PART, wide_bytes(f"rId{k}")) for k in range(1, len(tables) + 1)) + record(662))
                f.write(record(END_SHEET))
            links = []
            for k, t in enumerate(tables, 1):
                n_table += 1
                links.append(f'<Relationship Id="rId{k}" Type="{_REL}/table" Target="../tables/table{n_table}.bin"/>')
                types.append(f'<Override PartName="/xl/tables/table{n_table}.bin" ContentType="application/vnd.ms-excel.table"/>')
                head = struct.pack("<8I", t.first_row, t.last_row, t.first_column, t.last_column, 0, n_table, t.header_rows, t.totals_rows) + b"\0" * 32
                none = struct.pack("<I", 0xFFFFFFFF)
                body = [record(BEGIN_LIST, head + wide_bytes(t.name) + wide_bytes(t.name) + none * 4)]
                for m, name in enumerate(t.columns, 1):
                    body.append(record(BEGIN_LIST_COLUMN, struct.pack("<I", m) + b"\0" * 20 + none + wide_bytes(name)))
                z.writestr(f"xl/tables/table{n_table}.bin", b"".join(body))
            if links:
                z.writestr(f"xl/worksheets/_rels/sheet{i}.bin.rels", f'{_HEAD}<Relationships xmlns="{_PKG}/relationships">{"".join(links)}</Relationships>')
        rels.append(f'<Relationship Id="rId{len(sheets) + 1}" Type="{_REL}/styles" Target="styles.bin"/>')
        z.writestr("xl/workbook.bin", b"".join([*book, record(END_SHEETS), record(END_BOOK)]))
        z.writestr("xl/_rels/workbook.bin.rels", f'{_HEAD}<Relationships xmlns="{_PKG}/relationships">{"".join(rels)}</Relationships>')
        z.writestr("xl/styles.bin", _styles([(164, date_code)], [0, 164]))
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PKG}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.bin"/></Relationships>')
        z.writestr(
            "[Content_Types].xml",
            f'{_HEAD}<Types xmlns="{_PKG}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="bin" ContentType="application/vnd.ms-excel.sheet.binary.macroEnabled.main"/>'
            f'<Override PartName="/xl/styles.bin" ContentType="application/vnd.ms-excel.styles"/>{"".join(types)}</Types>',
        )
    return buffer.getvalue()
