"""Cell styles of written XLSX sheets: one style for each column, with widths, and dates."""

from __future__ import annotations

from dataclasses import dataclass, field
from xml.sax.saxutils import escape

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"

# Limits of a workbook.
MAX_FONTS, MAX_STYLES = 512, 65_490


@dataclass(frozen=True)
class Style:
    number_format: str | None = None
    bold: bool = False
    italic: bool = False
    underline: bool = False
    strike: bool = False
    font: str | None = None
    size: float | None = None
    color: str | None = None  # RRGGBB
    fill: str | None = None
    border: str | None = None  # thin, medium, thick, dashed, dotted, double
    align: str | None = None  # left, center, right
    wrap: bool = False


@dataclass
class Styles:
    """``columns``: styles by column number; ``widths``: in characters by column number; ``dates``: the format of date cells."""

    columns: dict[int, Style] = field(default_factory=dict)
    widths: dict[int, float] = field(default_factory=dict)
    dates: str = "yyyy-mm-dd hh:mm:ss"
    grid_lines: bool = True

    def __post_init__(self) -> None:
        if len(set(self.columns.values())) > MAX_STYLES or len({self._font(s) for s in self.columns.values()}) > MAX_FONTS:
            raise ValueError("too many styles")

    @staticmethod
    def _font(s: Style) -> str:
        flags = "".join(f"<{tag}/>" for on, tag in ((s.bold, "b"), (s.italic, "i"), (s.strike, "strike"), (s.underline, "u")) if on)
        color = f'<color rgb="FF{s.color}"/>' if s.color else ""
        return f'<font>{flags}<sz val="{s.size or 11:g}"/>{color}<name val="{escape(s.font or "Calibri")}"/></font>'

    def xml(self) -> str:
        """Style 0 is plain, style 1 the dates', then one for each column."""
        own = list(self.columns.values())
        formats = [self.dates, *[s.number_format for s in own if s.number_format]]
        fonts, fills, borders = [self._font(Style())], ['<fill><patternFill patternType="none"/></fill>', '<fill><patternFill patternType="gray125"/></fill>'], ["<border/>"]

        def at(table: list[str], item: str) -> int:
            if item not in table:
                table.append(item)
            return table.index(item)

        xfs = ['<xf numFmtId="0" fontId="0" fillId="0" borderId="0"/>', '<xf numFmtId="164" fontId="0" fillId="0" borderId="0" applyNumberFormat="1"/>']
        for s in own:
            number = 164 + formats.index(s.number_format) if s.number_format else 0
            fill = at(fills, f'<fill><patternFill patternType="solid"><fgColor rgb="FF{s.fill}"/></patternFill></fill>') if s.fill else 0
            sides = "".join(f'<{side} style="{s.border}"/>' for side in ("left", "right", "top", "bottom")) if s.border else ""
            border = at(borders, f"<border>{sides}</border>") if s.border else 0
            align = f'<alignment{f" horizontal={chr(34)}{s.align}{chr(34)}" if s.align else ""}{" wrapText=" + chr(34) + "1" + chr(34) if s.wrap else ""}/>' if s.align or s.wrap else ""
            xfs.append(f'<xf numFmtId="{number}" fontId="{at(fonts, self._font(s))}" fillId="{fill}" borderId="{border}">{align}</xf>')
        numbers = "".join(f'<numFmt numFmtId="{164 + k}" formatCode="{escape(c, {chr(34): "&quot;"})}"/>' for k, c in enumerate(formats))
        group = lambda tag, items: f'<{tag} count="{len(items)}">{"".join(items)}</{tag}>'
        return (
            f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<styleSheet xmlns="{_MAIN}"><numFmts count="{len(formats)}">{numbers}</numFmts>'
            + group("fonts", fonts) + group("fills", fills) + group("borders", borders) + group("cellXfs", xfs) + "</styleSheet>"
        )

    def columns_xml(self) -> str:
        both = sorted({*self.columns, *self.widths})
        if not both:
            return ""
        style = {c: k + 2 for k, c in enumerate(self.columns)}
        return "<cols>" + "".join(f'<col min="{c + 1}" max="{c + 1}" width="{self.widths.get(c, 9.14):g}" customWidth="1"{f" style={chr(34)}{style[c]}{chr(34)}" if c in style else ""}/>' for c in both) + "</cols>"
