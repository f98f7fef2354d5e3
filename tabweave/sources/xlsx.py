"""XLSX: reader over expat, and writer of sheet fragments and packages."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.parsers import expat
from xml.sax.saxutils import escape

from ..functions.convert import xml_escapes
from .cells import MAX_ROWS, Cell, LimitExceeded, Limits, Row, Table, Workbook, WorkbookError, area, column_index, column_name, is_date_format, place

_EPOCH = datetime.datetime(1899, 12, 30)


def open_zip(data: bytes, limits: Limits) -> zipfile.ZipFile:
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise WorkbookError(str(e)) from None
    if len(z.infolist()) > limits.entries:
        raise LimitExceeded("zip entries")
    return z


def entry(z: zipfile.ZipFile, name: str, limit: int) -> bytes:
    """An entry's bytes, its checksum verified; the limit holds for what is inflated, whatever the directory says."""
    with z.open(name) as f:
        data = f.read(limit + 1)
        if len(data) > limit:
            raise LimitExceeded(name)
        return data


def parse_xml(data: bytes, start, end=None, text=None) -> None:
    """Events with local names. Document types, and so entities, are refused."""
    p = expat.ParserCreate(namespace_separator=" ")
    p.buffer_text = True

    def refuse(*_):
        raise WorkbookError("document types aren't read")

    p.StartDoctypeDeclHandler = refuse
    local = lambda n: n.rpartition(" ")[2]
    p.StartElementHandler = lambda n, a: start(local(n), {local(k): v for k, v in a.items()})
    if end:
        p.EndElementHandler = lambda n: end(local(n))
    if text:
        p.CharacterDataHandler = text
    try:
        p.Parse(data, True)
    except expat.ExpatError as e:
        raise WorkbookError(str(e)) from None


def relations(z: zipfile.ZipFile, part: str, limits: Limits) -> dict[str, tuple[str, str]]:
    """Targets of a part's relationships: (kind, path) by id."""
    folder, _, name = part.rpartition("/")
    rels = f"{folder}/_rels/{name}.rels"
    out: dict[str, tuple[str, str]] = {}
    if rels not in z.namelist():
        return out

    def start(n, a):
        if n == "Relationship" and a.get("TargetMode") != "External":
            t = a["Target"]
            path = t.lstrip("/") if t.startswith("/") else f"{folder}/{t}"
            while re.search(r"[^/]+/\.\./", path):
                path = re.sub(r"[^/]+/\.\./", "", path, count=1)
            out[a["Id"]] = (a["Type"].rpartition("/")[2], path)

    parse_xml(entry(z, rels, limits.decompressed), start)
    return out


def shared_strings(data: bytes, limits: Limits) -> list[str]:
    out: list[str] = []
    state = {"text": [], "on": False, "phonetic": 0}

    def start(n, _):
        if n == "si":
            state["text"] = []
        elif n == "rPh":
            state["phonetic"] += 1
        elif n == "t" and not state["phonetic"]:
            state["on"] = True

    def end(n):
        if n == "t":
            state["on"] = False
        elif n == "rPh":
            state["phonetic"] -= 1
        elif n == "si":
            out.append(xml_escapes("".join(state["text"])))

    parse_xml(data, start, end, lambda t: state["text"].append(t) if state["on"] else None)
    return out


def date_styles(data: bytes) -> list[bool]:
    """For each cell style, whether its number format is a date."""
    codes: dict[int, str] = {}
    styles: list[bool] = []
    inside = {"xfs": False}

    def start(n, a):
        if n == "numFmt":
            codes[int(a["numFmtId"])] = a.get("formatCode", "")
        elif n == "cellXfs":
            inside["xfs"] = True
        elif n == "xf" and inside["xfs"]:
            k = int(a.get("numFmtId", 0))
            styles.append(is_date_format(k, codes.get(k)))

    def end(n):
        if n == "cellXfs":
            inside["xfs"] = False

    parse_xml(data, start, end)
    return styles


def iso_serial(text: str, date1904: bool) -> float | None:
    """The serial of an ISO date cell; its offset is dropped. Years before 100 and other texts give None."""
    bare = re.sub(r"(Z|[+-]\d\d:?\d\d)$", "", text.strip()) if "T" in text else text.strip()
    try:
        when = datetime.datetime.fromisoformat(bare)
    except ValueError:
        return None
    if when.year < 100:
        return None
    days = (when - _EPOCH) / datetime.timedelta(days=1)
    if date1904:
        return days - 1462
    return days - 1 if days < 61 else days


def sheet_rows(data: bytes, strings: list[str], dates: list[bool], date1904: bool, limits: Limits) -> Iterator[Row]:
    """Rows in file order; rows that aren't in the file are skipped, missing cells are empty."""
    rows: list[Row] = []
    s: dict = {"row": -1, "cells": [], "col": -1, "type": "n", "style": 0, "on": False, "buf": [], "seen": False, "phonetic": 0}

    def start(n, a):
        if n == "c":
            s["col"] = column_index(a["r"]) if "r" in a else s["col"] + 1
            s["type"], s["style"], s["buf"], s["seen"] = a.get("t", "n"), int(a.get("s", 0)), [], False
        elif n == "v" or (n == "t" and not s["phonetic"]):
            s["on"] = s["seen"] = True
        elif n == "rPh":
            s["phonetic"] += 1
        elif n == "row":
            s["row"] = int(a["r"]) - 1 if "r" in a else s["row"] + 1
            s["cells"], s["col"] = [], -1

    def end(n):
        if n in ("v", "t"):
            s["on"] = False
        elif n == "rPh":
            s["phonetic"] -= 1
        elif n == "c":
            text = "".join(s["buf"])
            if len(text) > limits.cell:
                raise LimitExceeded("cell")
            cell = _cell(s["type"], text, s["seen"], s["style"])
            if cell is not None:
                place(s["cells"], s["col"], cell)
        elif n == "row":
            rows.append((s["row"], s["cells"]))

    def _cell(kind: str, text: str, seen: bool, style: int) -> Cell | None:
        if kind in ("inlineStr", "str"):
            return ("s", xml_escapes(text), None) if seen and text else None
        if not text.strip():
            return None
        if kind == "s":
            k = int(text)
            value = strings[k] if k < len(strings) else ""
            return ("s", value, None) if value else None
        if kind == "b":
            return ("b", None, float(text.strip() in ("1", "true")))
        if kind == "e":
            return ("e", text, None)
        if kind == "d":
            serial = iso_serial(text, date1904)
            return ("s", text, None) if serial is None else ("d", None, serial)
        try:
            number = float(text)
        except ValueError:
            return ("s", text, None)
        return ("d" if style < len(dates) and dates[style] else "n", text.strip(), number)

    p = expat.ParserCreate(namespace_separator=" ")
    p.buffer_text = True

    def refuse(*_):
        raise WorkbookError("document types aren't read")

    p.StartDoctypeDeclHandler = refuse
    p.StartElementHandler = lambda n, a: start(n.rpartition(" ")[2], a)
    p.EndElementHandler = lambda n: end(n.rpartition(" ")[2])
    p.CharacterDataHandler = lambda t: s["buf"].append(t) if s["on"] else None
    step = 1 << 16
    try:
        for at in range(0, len(data), step):
            p.Parse(data[at : at + step], at + step >= len(data))
            yield from rows
            rows.clear()
    except expat.ExpatError as e:
        raise WorkbookError(str(e)) from None


def open_xlsx(data: bytes, limits: Limits | None = None) -> Workbook:
    limits = limits or Limits()
    z = open_zip(data, limits)
    root = next((path for kind, path in relations(z, "/", limits).values() if kind == "officeDocument"), None) or "xl/workbook.xml"
    root = root.lstrip("/")
    rels = relations(z, root, limits)
    book = Workbook("xlsx")
    parts: list[str] = []

    def start(n, a):
        if n == "workbookPr":
            book.date1904 = a.get("date1904", "0") in ("1", "true")
        elif n == "sheet":
            state = {"hidden": "hidden", "veryHidden": "very_hidden"}.get(a.get("state", ""), "visible")
            book.sheets.append((a["name"], state))
            parts.append(rels[a["id"]][1])

    parse_xml(entry(z, root, limits.decompressed), start)
    by_kind = {kind: path for kind, path in rels.values()}
    strings: list[list[str]] = []

    def all_strings() -> list[str]:
        if not strings:
            path = by_kind.get("sharedStrings")
            strings.append(shared_strings(entry(z, path, limits.shared_strings), limits) if path in z.namelist() else [])
        return strings[0]

    styles = by_kind.get("styles")
    dates = date_styles(entry(z, styles, limits.decompressed)) if styles in z.namelist() else []
    for i, part in enumerate(parts):
        for kind, path in relations(z, part, limits).values():
            if kind == "table":
                book.tables.append(_table(entry(z, path, limits.decompressed), i))
    book.tables.sort(key=lambda t: (t.sheet, t.id))
    book.read = lambda i: sheet_rows(entry(z, parts[i], limits.decompressed), all_strings(), dates, book.date1904, limits)
    return book


def _table(data: bytes, sheet: int) -> Table:
    found: list[Table] = []
    columns: list[str] = []

    def start(n, a):
        if n == "table":
            r0, r1, c0, c1 = area(a["ref"])
            found.append(Table(a.get("displayName") or a.get("name", ""), sheet, r0, r1, c0, c1, int(a.get("headerRowCount", 1)), int(a.get("totalsRowCount", 0)), id=int(a.get("id", 0))))
        elif n == "tableColumn":
            columns.append(xml_escapes(a.get("name", "")))

    parse_xml(data, start)
    found[0].columns = tuple(columns)
    return found[0]


# ---- writing

_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)|\r")


def xml_text(text: str) -> str:
    """Escaped text; characters that XML can't hold, and text that looks like such an escape, as ``_xHHHH_``."""
    return escape(_CONTROL.sub(lambda m: f"_x{ord(m[0]):04X}_", text))


def row_xml(number: int, cells: list[Cell | None], style: int = 0, date_style: int = 1) -> str:
    """A row's XML; ``number`` from 0. Numbers keep their text if they have one."""
    if number >= MAX_ROWS:
        raise LimitExceeded(f"row {number}")
    out = []
    for c, cell in enumerate(cells):
        if cell is None:
            continue
        kind, text, num = cell
        ref = f'{column_name(c)}{number + 1}" ' + (f's="{date_style if kind == "d" else style}" ' if kind == "d" or style else "")
        if kind == "s":
            out.append(f'<c r="{ref}t="inlineStr"><is><t xml:space="preserve">{xml_text(text)}</t></is></c>')
        elif kind == "b":
            out.append(f'<c r="{ref}t="b"><v>{int(num)}</v></c>')
        elif kind == "e":
            out.append(f'<c r="{ref}t="e"><v>{escape(text)}</v></c>')
        else:
            out.append(f'<c r="{ref.rstrip()}><v>{text or repr(num)}</v></c>')
    return f'<row r="{number + 1}">{"".join(out)}</row>'


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006"


def package(sheets: list[dict], styles_xml: str, date1904: bool = False, out: io.IOBase | None = None) -> bytes | None:
    """A package of ``sheets``: name, visibility, fragments (row XML texts in order), optional table and columns XML."""
    buffer = out or io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        types, books, rels, n_table = [], [], [], 0
        for i, sheet in enumerate(sheets, 1):
            state = {"hidden": ' state="hidden"', "very_hidden": ' state="veryHidden"'}.get(sheet.get("visibility", "visible"), "")
            books.append(f'<sheet name="{escape(sheet["name"], {chr(34): "&quot;"})}" sheetId="{i}"{state} r:id="rId{i}"/>')
            rels.append(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>')
            types.append(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>')
            with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as f:
                view = "" if sheet.get("grid_lines", True) else '<sheetViews><sheetView showGridLines="0" workbookViewId="0"/></sheetViews>'
                f.write(f'{_HEAD}<worksheet xmlns="{_MAIN}" xmlns:r="{_REL}">{view}{sheet.get("cols", "")}<sheetData>'.encode())
                for fragment in sheet["fragments"]:
                    f.write(fragment if isinstance(fragment, bytes) else fragment.encode())
                tables = sheet.get("tables", [])
                parts = "".join(f'<tablePart r:id="rId{k}"/>' for k in range(1, len(tables) + 1))
                f.write(("</sheetData>" + (f'<tableParts count="{len(tables)}">{parts}</tableParts>' if tables else "") + "</worksheet>").encode())
            links = []
            for k, t in enumerate(tables, 1):
                n_table += 1
                links.append(f'<Relationship Id="rId{k}" Type="{_REL}/table" Target="../tables/table{n_table}.xml"/>')
                types.append(f'<Override PartName="/xl/tables/table{n_table}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.table+xml"/>')
                z.writestr(f"xl/tables/table{n_table}.xml", table_xml(t, n_table))
            if links:
                z.writestr(f"xl/worksheets/_rels/sheet{i}.xml.rels", f'{_HEAD}<Relationships xmlns="{_PKG}/relationships">{"".join(links)}</Relationships>')
        k = len(sheets) + 1
        rels.append(f'<Relationship Id="rId{k}" Type="{_REL}/styles" Target="styles.xml"/>')
        flag = ' date1904="1"' if date1904 else ""
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><workbookPr{flag}/><sheets>{"".join(books)}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PKG}/relationships">{"".join(rels)}</Relationships>')
        z.writestr("xl/styles.xml", styles_xml)
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PKG}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr(
            "[Content_Types].xml",
            f'{_HEAD}<Types xmlns="{_PKG}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
            '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
            f'<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{"".join(types)}</Types>',
        )
    return buffer.getvalue() if out is None else None


def table_xml(t: Table, number: int) -> str:
    ref = f"{column_name(t.first_column)}{t.first_row + 1}:{column_name(t.last_column)}{t.last_row + 1}"
    quote = {'"': "&quot;", "\n": "&#10;"}
    columns = "".join(f'<tableColumn id="{k}" name="{escape(n, quote)}"/>' for k, n in enumerate(t.columns, 1))
    totals = f' totalsRowCount="{t.totals_rows}"' if t.totals_rows else ""
    return (
        f'{_HEAD}<table xmlns="{_MAIN}" id="{number}" name="{escape(t.name)}" displayName="{escape(t.name)}" ref="{ref}" headerRowCount="{t.header_rows}"{totals}>'
        f'<autoFilter ref="{ref}"/><tableColumns count="{len(t.columns)}">{columns}</tableColumns><tableStyleInfo name="TableStyleMedium2" showRowStripes="1"/></table>'
    )
