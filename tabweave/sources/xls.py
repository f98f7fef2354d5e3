"""XLS (BIFF8): the workbook stream of a compound file, read and written."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from . import cfb
from .cells import ERRORS, MAX_TEXT, Cell, LimitExceeded, Limits, Row, Workbook, WorkbookError, is_date_format, place, rk

# Record types.
FORMULA, EOF, DATE_MODE, FILE_PASS, CONTINUE = 0x06, 0x0A, 0x22, 0x2F, 0x3C
BOUND_SHEET, MUL_RK, MUL_BLANK, R_STRING, XF, SST, LABEL_SST = 0x85, 0xBD, 0xBE, 0xD6, 0xE0, 0xFC, 0xFD
BLANK, NUMBER, LABEL, BOOL_ERR, STRING, ROW, RK, FORMAT, BOF = 0x201, 0x203, 0x204, 0x205, 0x207, 0x208, 0x27E, 0x41E, 0x809

MAX_ROWS, MAX_COLUMNS = 65_536, 256
_VISIBLE = {0: "visible", 1: "hidden", 2: "very_hidden"}


def _records(data: bytes, at: int = 0) -> Iterator[tuple[int, bytes, int]]:
    while at + 4 <= len(data):
        kind, n = struct.unpack_from("<HH", data, at)
        if at + 4 + n > len(data):
            raise WorkbookError("a record is cut off")
        yield kind, data[at + 4 : at + 4 + n], at
        at += 4 + n


class _Parts:
    """Bytes of a record and its continuations; a string's characters may change width where a part begins."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.k, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            if self.k >= len(self.parts):
                raise WorkbookError("shared strings are cut off")
            piece = self.parts[self.k][self.at : self.at + n]
            self.at += len(piece)
            n -= len(piece)
            out += piece
            if n:
                self.k, self.at = self.k + 1, 0
        return out

    def text(self) -> str:
        n, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        is_wide, out = flags & 1, []
        while n:
            if self.at >= len(self.parts[self.k]):
                self.k, self.at = self.k + 1, 0
                is_wide = self.take(1)[0] & 1
            size = 2 if is_wide else 1
            count = min(n, (len(self.parts[self.k]) - self.at) // size)
            if not count:
                raise WorkbookError("a string is cut off")
            raw = self.take(count * size)
            out.append(raw.decode("utf-16-le", "surrogatepass") if is_wide else raw.decode("latin-1"))
            n -= count
        self.take(4 * runs + extra)
        return "".join(out).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _string(p: bytes, at: int, wide_count: bool = True) -> str:
    n = struct.unpack_from("<H", p, at)[0] if wide_count else p[at]
    at += 2 if wide_count else 1
    flags = p[at]
    at += 1 + (2 if flags & 8 else 0) + (4 if flags & 4 else 0)
    raw = p[at : at + n * (2 if flags & 1 else 1)]
    return raw.decode("utf-16-le", "replace") if flags & 1 else raw.decode("latin-1")


def open_xls(data: bytes, limits: Limits | None = None) -> Workbook:
    limits = limits or Limits()
    found = cfb.streams(data)
    stream = next((found[n] for n in found if n.lower() in ("workbook", "book")), None)
    if stream is None:
        raise WorkbookError("no workbook stream")
    book = Workbook("xls")
    places: list[int] = []
    strings: list[str] = []
    codes: dict[int, str] = {}
    formats: list[int] = []
    sst: list[bytes] | None = None
    first = True
    for kind, p, _ in _records(stream):
        if first:
            if kind != BOF or struct.unpack_from("<H", p)[0] != 0x600:
                raise WorkbookError("only BIFF8 is read")
            first = False
        if sst is not None and kind != CONTINUE:
            strings, sst = _shared(sst, limits), None
        if kind == FILE_PASS:
            raise WorkbookError("encrypted .xls files aren't read")
        if kind == DATE_MODE:
            book.date1904 = struct.unpack_from("<H", p)[0] == 1
        elif kind == BOUND_SHEET:
            at, state, sort = struct.unpack_from("<IBB", p)
            if sort == 0:
                book.sheets.append((_string(p, 6, False), _VISIBLE.get(state & 3, "visible")))
                places.append(at)
        elif kind == FORMAT:
            codes[struct.unpack_from("<H", p)[0]] = _string(p, 2)
        elif kind == XF:
            formats.append(struct.unpack_from("<H", p, 2)[0])
        elif kind == SST:
            sst = [p]
        elif kind == CONTINUE and sst is not None:
            sst.append(p)
        elif kind == EOF:
            break
    if first:
        raise WorkbookError("an empty workbook stream")
    dates = [is_date_format(f, codes.get(f)) for f in formats]
    book.read = lambda i: _sheet_rows(stream, places[i], strings, dates)
    return book


def _shared(parts: list[bytes], limits: Limits) -> list[str]:
    if sum(map(len, parts)) > limits.shared_strings:
        raise LimitExceeded("shared strings")
    unique = struct.unpack_from("<I", parts[0], 4)[0]
    reader = _Parts([parts[0][8:], *parts[1:]])
    return [reader.text() for _ in range(unique)]


def _sheet_rows(stream: bytes, at: int, strings: list[str], dates: list[bool]) -> Iterator[Row]:
    """Rows of a sheet; rows that are only declared are delivered empty, cells in the order of columns."""
    rows: dict[int, dict[int, Cell]] = {}
    pending: tuple[int, int] | None = None
    depth = 0

    def put(row: int, column: int, cell: Cell | None) -> None:
        own = rows.setdefault(row, {})
        if cell is not None:
            own[column] = cell

    def number(style: int, value: float) -> Cell:
        return ("d" if style < len(dates) and dates[style] else "n", None, value)

    def text(value: str) -> Cell | None:
        return ("s", value, None) if value else None

    try:
        for kind, p, _ in _records(stream, at):
            if kind == BOF:
                depth += 1
                continue
            if kind == EOF:
                depth -= 1
                if depth <= 0:
                    break
                continue
            if depth > 1:
                continue
            if kind == ROW:
                rows.setdefault(struct.unpack_from("<H", p)[0], {})
            elif kind == STRING and pending:
                put(*pending, text(_string(p, 0)))
                pending = None
            elif kind in (LABEL_SST, NUMBER, RK, BOOL_ERR, FORMULA, LABEL, R_STRING, BLANK):
                r, c, style = struct.unpack_from("<HHH", p)
                if kind == LABEL_SST:
                    k = struct.unpack_from("<I", p, 6)[0]
                    put(r, c, text(strings[k] if k < len(strings) else ""))
                elif kind == NUMBER:
                    put(r, c, number(style, struct.unpack_from("<d", p, 6)[0]))
                elif kind == RK:
                    put(r, c, number(style, rk(struct.unpack_from("<I", p, 6)[0])))
                elif kind == BOOL_ERR:
                    put(r, c, ("e", ERRORS.get(p[6], "#ERR"), None) if p[7] else ("b", None, float(p[6] != 0)))
                elif kind in (LABEL, R_STRING):
                    put(r, c, text(_string(p, 6)))
                elif kind == BLANK:
                    put(r, c, None)
                elif p[12:14] != b"\xff\xff":
                    put(r, c, number(style, struct.unpack_from("<d", p, 6)[0]))
                elif p[6] == 0:
                    pending = (r, c)
                elif p[6] == 1:
                    put(r, c, ("b", None, float(p[8] != 0)))
                elif p[6] == 2:
                    put(r, c, ("e", ERRORS.get(p[8], "#ERR"), None))
                else:
                    put(r, c, None)
            elif kind == MUL_RK:
                r, c = struct.unpack_from("<HH", p)
                for k in range((len(p) - 6) // 6):
                    style, value = struct.unpack_from("<HI", p, 4 + 6 * k)
                    put(r, c + k, number(style, rk(value)))
            elif kind == MUL_BLANK:
                rows.setdefault(struct.unpack_from("<H", p)[0], {})
    except (struct.error, IndexError) as e:
        raise WorkbookError(str(e)) from None
    for r in sorted(rows):
        cells: list[Cell | None] = []
        for c in sorted(rows[r]):
            place(cells, c, rows[r][c])
        yield r, cells


# ---- writing


def _record(kind: int, payload: bytes = b"") -> bytes:
    return struct.pack("<HH", kind, len(payload)) + payload


def _unicode(text: str) -> bytes:
    raw = text.encode("utf-16-le", "surrogatepass")
    return struct.pack("<HB", len(raw) // 2, 1) + raw


def workbook(sheets: list[dict], date_code: str = "yyyy-mm-dd hh:mm:ss", date1904: bool = False) -> bytes:
    """A whole workbook of ``sheets``: name, visibility, rows (number, cells). Text goes to the shared strings."""
    index: dict[str, int] = {}
    total = 0
    bodies = []
    for sheet in sheets:
        out = [_record(BOF, struct.pack("<HHHHII", 0x600, 0x10, 0, 0, 0, 0))]
        for number, cells in sheet["rows"]:
            if number >= MAX_ROWS or len(cells) > MAX_COLUMNS:
                raise LimitExceeded("an .xls sheet has 65,536 rows and 256 columns")
            out.append(_record(ROW, struct.pack("<HHHHHHI", number, 0, len(cells), 255, 0, 0, 0x100)))
            for c, cell in enumerate(cells):
                if cell is None:
                    continue
                kind, text, num = cell
                head = struct.pack("<HHH", number, c, 16 if kind == "d" else 15)
                if kind == "s":
                    if len(text) > MAX_TEXT:
                        raise LimitExceeded("text of a cell")
                    total += 1
                    out.append(_record(LABEL_SST, head + struct.pack("<I", index.setdefault(text, len(index)))))
                elif kind == "b":
                    out.append(_record(BOOL_ERR, head + bytes([int(num), 0])))
                elif kind == "e":
                    out.append(_record(BOOL_ERR, head + bytes([next((k for k, v in ERRORS.items() if v == text), 0x2A), 1])))
                else:
                    out.append(_record(NUMBER, head + struct.pack("<d", num)))
        out.append(_record(EOF))
        bodies.append(b"".join(out))
    start = [_record(BOF, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 0)), _record(0x42, struct.pack("<H", 1200)), _record(DATE_MODE, struct.pack("<H", int(date1904)))]
    font = struct.pack("<HHHHHBBBB", 200, 0, 0x7FFF, 400, 0, 0, 0, 0, 0) + bytes([5, 0]) + b"Arial"
    start += [_record(0x31, font)] * 4
    start.append(_record(FORMAT, struct.pack("<H", 164) + _unicode(date_code)))
    start += [_record(XF, struct.pack("<HHHBBBBIIH", 0, 0, 0xFFF5, 0x20, 0, 0, 0, 0, 0, 0x20C0))] * 15
    start += [_record(XF, struct.pack("<HHHBBBBIIH", 0, f, 1, 0x20, 0, 0, 0, 0, 0, 0x20C0)) for f in (0, 164)]
    start.append(_record(0x293, struct.pack("<HBB", 0x8000, 0, 0xFF)))
    tail = _sst(index, total) + _record(EOF)
    names = [s["name"].encode("utf-16-le") for s in sheets]
    at = sum(map(len, start)) + sum(4 + 8 + len(n) for n in names) + len(tail)
    bound = []
    for s, n, body in zip(sheets, names, bodies, strict=True):
        state = next(k for k, v in _VISIBLE.items() if v == s.get("visibility", "visible"))
        bound.append(_record(BOUND_SHEET, struct.pack("<IBBBB", at, state, 0, len(n) // 2, 1) + n))
        at += len(body)
    return cfb.container({"Workbook": b"".join([*start, *bound, tail, *bodies])})


def _sst(index: dict[str, int], total: int) -> bytes:
    """Shared strings in records of at most 8,224 bytes; a string that continues repeats its width byte."""
    limit, out = 8224, []
    buf = bytearray(struct.pack("<II", total, len(index)))
    kind = SST

    def flush() -> None:
        nonlocal buf, kind
        out.append(_record(kind, bytes(buf)))
        buf, kind = bytearray(), CONTINUE

    for text in index:
        raw = text.encode("utf-16-le", "surrogatepass")
        if len(buf) + 5 > limit:
            flush()
        buf += struct.pack("<HB", len(raw) // 2, 1)
        at = 0
        while True:
            room = (limit - len(buf)) // 2 * 2
            buf += raw[at : at + room]
            at += room
            if at >= len(raw):
                break
            flush()
            buf += b"\x01"
    flush()
    return b"".join(out)
