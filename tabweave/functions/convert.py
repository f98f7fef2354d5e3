"""Cell conversions as Column expressions: text, binary number or boolean cells to typed values.

A cell is STRUCT<type STRING, text STRING, num DOUBLE>: type ``s`` text, ``n`` number, ``d`` number in a date
format, ``b`` boolean (num 0 or 1), ``e`` error; a null struct is an empty cell. Every converter gives null
where the cell doesn't convert; the policies of ``tabweave.functions.spec`` decide what follows. Nothing here
depends on the session's time zone or ANSI mode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL = "struct<type:string,text:string,num:double>"
Converter = Callable[[Column], Column]

# Bounds of the integer types.
INT_RANGES = {
    "int8": (-(1 << 7), (1 << 7) - 1),
    "uint8": (0, (1 << 8) - 1),
    "int16": (-(1 << 15), (1 << 15) - 1),
    "uint16": (0, (1 << 16) - 1),
    "int32": (-(1 << 31), (1 << 31) - 1),
    "uint32": (0, (1 << 32) - 1),
    "int64": (-(1 << 63), (1 << 63) - 1),
    "uint64": (0, (1 << 64) - 1),
    "int128": (-(10**38) + 1, 10**38 - 1),
}
INT_TYPES = {"int8": "tinyint", "uint8": "smallint", "int16": "smallint", "uint16": "int", "int32": "int", "uint32": "bigint", "int64": "bigint", "uint64": "decimal(20,0)", "int128": "decimal(38,0)"}

_BLANK = " \t\n\x0b\f\r"
_INT = r"^[ \t-\r]*[+-]?[0-9]+[ \t-\r]*$"
_FLOAT = r"^[ \t-\r]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t-\r]*$"
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,7})?)?$"
_ZONED = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,7})?)?(Z|[+-][0-9]{2}:[0-9]{2})$"
_GENERAL = r"^[0-9]{2}/[0-9]{2}/[0-9]{4}( [0-9]{2}:[0-9]{2}:[0-9]{2})?$"
_CLOCK = r"^[0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,7})?)?$"
_GUID = r"^[{(]?[0-9A-Fa-f]{8}-?[0-9A-Fa-f]{4}-?[0-9A-Fa-f]{4}-?[0-9A-Fa-f]{4}-?[0-9A-Fa-f]{12}[)}]?$"
_SPAN = r"^(-?)(?:([0-9]+)\.)?([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:\.([0-9]{1,7}))?)?$"

#: Days from the origin of serial dates of the text form (1899-12-30) that a date may have.
DAY_RANGE = (-657435.0, 2958466.0)


def text_cell(text: Column) -> Column:
    """A CSV field as a cell: the empty field is the empty cell."""
    return F.when(text.isNotNull() & (text != ""), F.struct(F.lit("s").alias("type"), text.alias("text"), F.lit(None).cast("double").alias("num")))


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANK))


def _number(cell: Column) -> Column:
    return F.when(cell["type"].isin("n", "d"), cell["num"])


def integer(cell: Column, kind: str = "int64") -> Column:
    """Optional sign and digits with white space around; or a binary number that is integral. Null beyond the kind's range."""
    low, high = INT_RANGES[kind]
    # signed types of Spark are their own range check; the cell's parts are named once each, which keeps generated code small
    signed = kind in ("int8", "int16", "int32", "int64")
    wide = INT_TYPES[kind] if signed else "decimal(38,0)"
    num = _number(cell)
    from_text = F.when(cell["text"].rlike(_INT), _strip(cell["text"]).try_cast(wide))
    whole = F.when((num == F.floor(num)) & (F.abs(num) < 1e18), num.try_cast(wide))
    value = F.when(cell["text"].isNotNull() & (cell["type"] != "b"), from_text).otherwise(whole)
    if signed:
        return value
    return F.when(value.between(F.lit(str(low)).cast(wide), F.lit(str(high)).cast(wide)), value.try_cast(INT_TYPES[kind]))


def double(cell: Column) -> Column:
    """Decimal or exponent text with white space around, without type suffixes; NaN and Infinity by name; or a binary number."""
    t = _strip(cell["text"])
    named = F.when(t.isin("NaN", "Infinity", "-Infinity"), t.try_cast("double"))
    from_text = F.when(cell["text"].rlike(_FLOAT), t.try_cast("double")).otherwise(named)
    return F.when(cell["type"].isin("n", "d"), F.coalesce(cell["num"], from_text)).when(cell["type"] == "s", from_text)


def single(cell: Column) -> Column:
    return double(cell).cast("float")


def decimal(cell: Column, precision: int = 38, scale: int = 9) -> Column:
    """Exact from text; a binary number goes through its shortest text. Null if it doesn't fit the precision."""
    t = F.coalesce(F.when(cell["type"] != "b", cell["text"]), _number(cell).cast("string"))
    return F.when(t.rlike(_FLOAT), _strip(t).try_cast(f"decimal({precision},{scale})"))


def culture_text(text: Column, decimal_mark: str = ".", group_mark: str | None = None) -> Column:
    """Number text of another culture in invariant form. Group marks are taken only if the culture names one; a stray invariant mark fails."""
    out = text if group_mark is None else F.translate(text, group_mark, "")
    if decimal_mark == ".":
        return out
    return F.when(~F.contains(out, F.lit(".")), F.translate(out, decimal_mark, "."))


def cultured(converter: Converter, decimal_mark: str = ".", group_mark: str | None = None) -> Converter:
    """``converter`` for text cells of a culture; number and date cells stay invariant."""

    def convert(cell: Column) -> Column:
        text = F.when(cell["type"] == "s", culture_text(cell["text"], decimal_mark, group_mark)).otherwise(cell["text"])
        return converter(F.when(cell.isNotNull(), F.struct(cell["type"].alias("type"), text.alias("text"), cell["num"].alias("num"))))

    return convert


def boolean(cell: Column) -> Column:
    """1, 0, true and false in any case, without white space around; number 0 or 1; boolean cells."""
    t = F.lower(cell["text"])
    from_text = F.when(t.isin("1", "true"), True).when(t.isin("0", "false"), False)
    from_num = F.when(cell["num"] == 1, True).when(cell["num"] == 0, False)
    return F.when(cell["type"] == "s", from_text).when(cell["type"].isin("n", "d", "b"), F.coalesce(from_num, from_text))


def serial_timestamp(serial: Column, date1904: bool = False) -> Column:
    """A serial date as TIMESTAMP_NTZ, to the millisecond.

    In the 1900 system serial 60 is a day that never was, so lower serials are moved by a day.
    """
    days = serial + 1462 if date1904 else F.when(serial < 60, serial + 1).otherwise(serial)
    ms = F.round(days * 86400000).cast("long")
    valid = (days > DAY_RANGE[0]) & (days < DAY_RANGE[1])
    return F.when(valid, F.timestamp_add("MICROSECOND", ms * 1000, F.lit("1899-12-30 00:00:00").cast("timestamp_ntz")))


def iso_timestamp(text: Column) -> Column:
    """yyyy-MM-dd, or with T or a space HH:mm:ss and up to seven decimals. Nothing looser; year 0 fails."""
    return F.when(text.rlike(_ISO) & ~F.startswith(text, F.lit("0000")), text.try_cast("timestamp_ntz"))


def general_timestamp(text: Column) -> Column:
    """MM/dd/yyyy, or with HH:mm:ss."""
    iso = F.regexp_replace(text, r"^([0-9]{2})/([0-9]{2})/([0-9]{4})", "$3-$1-$2")
    return F.when(text.rlike(_GENERAL), iso_timestamp(iso))


def zoned_timestamp(text: Column) -> Column:
    """ISO text with an offset, normalised to UTC."""
    local = F.regexp_extract(text, r"^(.*?)(Z|[+-][0-9]{2}:[0-9]{2})$", 1).try_cast("timestamp_ntz")
    zone = F.regexp_extract(text, r"(Z|[+-][0-9]{2}:[0-9]{2})$", 1)
    sign = F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)
    minutes = F.when(zone == "Z", 0).otherwise(sign * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int")))
    return F.when(text.rlike(_ZONED), F.timestamp_add("MINUTE", -minutes, local))


def text_timestamp(text: Column) -> Column:
    return F.coalesce(iso_timestamp(text), general_timestamp(text), zoned_timestamp(text))


def _text_serial(text: Column, fraction: bool) -> Column:
    pattern = r"^[+-]?[0-9]*\.[0-9]+$" if fraction else _FLOAT
    return F.when(text.rlike(pattern), _strip(text).try_cast("double"))


def timestamp(cell: Column, date1904: bool = False, policy: str = "model") -> Column:
    """Date and time of a cell. ``model``: text is ISO, general or zoned, and digits aren't a date; ``columnar``: a serial
    first, also in text, then the text forms."""
    own = serial_timestamp(_number(cell), date1904)
    if policy == "columnar":
        from_text = F.coalesce(serial_timestamp(_text_serial(cell["text"], False), date1904), text_timestamp(cell["text"]))
    else:
        from_text = text_timestamp(cell["text"])
    return F.when(cell["type"] == "s", from_text).otherwise(own)


def date(cell: Column, date1904: bool = False, policy: str = "model") -> Column:
    return timestamp(cell, date1904, policy).cast("date")


def time_of_day(cell: Column) -> Column:
    """Microseconds since midnight: the fraction of a serial day, to 100 ns and a full day as 0; or clock text; a CSV serial needs a fraction."""
    serial = F.coalesce(_number(cell), F.when(cell["type"] == "s", _text_serial(cell["text"], True)))
    ticks = F.round((serial - F.floor(serial)) * 864000000000.0).cast("long") % 864000000000
    parts = lambda k: F.coalesce(F.nullif(F.regexp_extract(cell["text"], r"^([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?(?:\.([0-9]{1,7}))?$", k), F.lit("")), F.lit("0"))
    hour, minute, second = (parts(k).try_cast("long") for k in (1, 2, 3))
    micros = F.substring(F.rpad(parts(4), 7, "0"), 1, 6).try_cast("long")
    clock = F.when(cell["text"].rlike(_CLOCK) & (hour < 24) & (minute < 60) & (second < 60), ((hour * 60 + minute) * 60 + second) * 1000000 + micros)
    return F.coalesce(F.floor(ticks / 10).cast("long"), F.when(cell["type"] == "s", clock))


def duration(cell: Column) -> Column:
    """[-][days.]HH:mm[:ss[.fraction]] as microseconds."""
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(cell["text"], _SPAN, k), F.lit("")), F.lit("0"))
    days, hour, minute, second = (part(k).try_cast("long") for k in (2, 3, 4, 5))
    micros = F.substring(F.rpad(part(6), 7, "0"), 1, 6).try_cast("long")
    total = (((days * 24 + hour) * 60 + minute) * 60 + second) * 1000000 + micros
    signed = F.when(part(1) == "-", -total).otherwise(total)
    return F.when(cell["text"].rlike(_SPAN) & (hour < 24) & (minute < 60) & (second < 60), signed)


def enum(members: dict[str, int]) -> Converter:
    """A member by its name in any case, or by its exact value; the canonical name. Of members of one value the first is canonical."""
    canonical: dict[int, str] = {}
    for name, value in members.items():
        canonical.setdefault(value, name)
    by_text = {name.lower(): canonical[value] for name, value in members.items()}
    table = F.create_map(*[F.lit(x) for pair in by_text.items() for x in pair])
    values = F.create_map(*[F.lit(x) for pair in canonical.items() for x in pair])

    def convert(cell: Column) -> Column:
        number = integer(cell, "int32")
        return F.coalesce(F.element_at(table, F.lower(_strip(cell["text"]))), F.element_at(values, number))

    return convert


def guid(cell: Column) -> Column:
    """32 hexadecimal digits with or without dashes and brackets, as lower-case dashed text."""
    hexa = F.lower(F.regexp_replace(cell["text"], r"[{}()-]", ""))
    return F.when(cell["text"].rlike(_GUID), F.regexp_replace(hexa, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def character(cell: Column) -> Column:
    return F.when(F.length(cell["text"]) == 1, cell["text"])


def offset_timestamp(cell: Column) -> Column:
    """A zoned text as an instant (TIMESTAMP); without an offset it counts as UTC."""
    ntz = F.coalesce(zoned_timestamp(cell["text"]), iso_timestamp(cell["text"]))
    return F.to_utc_timestamp(ntz.cast("timestamp"), F.lit("UTC"))


def number_text(value: Column) -> Column:
    """Shortest text that gives the same double again, without a forced ``.0``; exponents as in E+16 from 1e15 on."""
    # most numbers take one of these two: integral ones, and those that the JVM writes without an exponent
    size = F.abs(value)
    whole, usual = (value == F.floor(value)) & (size < 1e15), (size >= 1e-3) & (size < 1e7)
    digits = F.regexp_replace(value.cast("string"), r"\.0$", "")
    mantissa, exponent = F.regexp_extract(digits, r"^(.*?)(?:\.0)?E", 1), F.regexp_extract(digits, r"E(.*)$", 1).try_cast("int")
    small = F.when((exponent < 0) & (exponent >= -5), value.cast("decimal(38,22)").cast("string"))
    small = F.regexp_replace(small, r"0+$", "")
    mid = F.when((exponent >= 0) & (exponent < 15), F.regexp_replace(F.regexp_replace(value.cast("decimal(38,18)").cast("string"), r"0+$", ""), r"\.$", ""))
    sign = F.when(exponent < 0, "E-").otherwise("E+")
    power = F.abs(exponent).cast("string")
    scientific = F.concat(mantissa, sign, F.when(F.length(power) < 2, F.concat(F.lit("0"), power)).otherwise(power))
    finite = F.coalesce(F.when(~F.contains(digits, F.lit("E")), digits), small, mid, scientific)
    common = F.when(value.isNull(), None).when(whole, value.cast("long").cast("string")).when(usual, value.cast("string"))
    return common.when(F.isnan(value), "NaN").when(value == float("inf"), "Infinity").when(value == float("-inf"), "-Infinity").otherwise(finite)


def string(cell: Column) -> Column:
    """Text as it is; a number without text by its shortest form; booleans as TRUE or FALSE."""
    return F.coalesce(cell["text"], F.when(cell["type"] == "b", F.when(cell["num"] == 1, "TRUE").otherwise("FALSE")), number_text(cell["num"]))


#: Named readers.
READERS: dict[str, Converter] = {
    "string": string,
    "bool": boolean,
    "double": double,
    "single": single,
    "decimal": decimal,
    "date": date,
    "timestamp": timestamp,
    "timestamp_serial": lambda c: serial_timestamp(_number(c)),
    "timestamp_text": lambda c: text_timestamp(c["text"]),
    "timestamp_auto": lambda c: timestamp(c, policy="columnar"),
    "date_auto": lambda c: date(c, policy="columnar"),
    "time": time_of_day,
    "duration": duration,
    "guid": guid,
    "char": character,
    "offset_timestamp": offset_timestamp,
    **{k: (lambda c, k=k: integer(c, k)) for k in INT_RANGES},
}


def xml_escapes(text: str) -> str:
    """Decode ``_xHHHH_`` of spreadsheet strings; surrogate pairs are joined, lone surrogates stay as text."""
    import re

    units = re.split(r"(_x[0-9A-Fa-f]{4}_)", text)
    out, i = [], 0
    while i < len(units):
        u = units[i]
        if i % 2:
            code = int(u[2:6], 16)
            if 0xD800 <= code < 0xDC00 and i + 2 < len(units) and units[i + 1] == "" and 0xDC00 <= int(units[i + 2][2:6], 16) < 0xE000:
                out.append(chr(0x10000 + ((code - 0xD800) << 10) + int(units[i + 2][2:6], 16) - 0xDC00))
                i += 3
                continue
            out.append(u if 0xD800 <= code < 0xE000 else chr(code))
        else:
            out.append(u)
        i += 1
    return "".join(out)
