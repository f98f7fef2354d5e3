"""CSV dialects: sniffing a sample, validation, and byte-order marks."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Candidates in order, and limits of the sample.
DELIMITERS = b",;\t|"
QUOTES = b"\"'"
SAMPLE_BYTES = 64 * 1024
SAMPLE_LINES = 20

# Byte-order marks; the longer ones come first where one begins with another.
MARKS = (
    (b"\xef\xbb\xbf", "utf-8"),
    (b"\xff\xfe\x00\x00", "utf-32-le"),
    (b"\x00\x00\xfe\xff", "utf-32-be"),
    (b"\xff\xfe", "utf-16-le"),
    (b"\xfe\xff", "utf-16-be"),
)


@dataclass(frozen=True)
class Dialect:
    delimiter: str = ","
    quote: str = '"'
    encoding: str | None = None
    has_bom: bool = False

    def __post_init__(self) -> None:
        if len(self.delimiter) != 1 or len(self.quote) != 1 or ord(self.delimiter) > 127 or ord(self.quote) > 127:
            raise ValueError("delimiter and quote are single ASCII characters")
        if self.delimiter == self.quote:
            raise ValueError("delimiter and quote are the same")
        if self.delimiter in "\r\n" or self.quote in "\r\n":
            raise ValueError("a line terminator can't be delimiter or quote")


def byte_order_mark(data: bytes) -> tuple[str | None, int]:
    return next(((name, len(mark)) for mark, name in MARKS if data.startswith(mark)), (None, 0))


def _fields_per_line(data: bytes, delimiter: int, quote: int, lines: int) -> list[int]:
    special = re.compile(b"[" + re.escape(bytes([delimiter, quote])) + b"\r\n]")
    counts: list[int] = []
    quoted, fields, begin, skip = False, 1, 0, -1
    for m in special.finditer(data):
        if len(counts) == lines:
            break
        at = m.start()
        b = data[at]
        if at == skip:
            continue
        if b == quote:
            quoted = not quoted
        elif quoted:
            continue
        elif b == delimiter:
            fields += 1
        else:
            counts.append(fields)
            fields, begin = 1, at + 1
            if data[at : at + 2] == b"\r\n":
                skip, begin = at + 1, at + 2
    # the last line may be cut short, so it counts only if it is the only one
    if not counts and not quoted and begin < len(data):
        counts.append(fields)
    return counts


def sniff(sample: bytes, delimiters: bytes = DELIMITERS, quotes: bytes = QUOTES, lines: int = SAMPLE_LINES) -> Dialect:
    """The candidate pair with the least variance of fields by line, among those with more than one on average; ties keep the order."""
    sample = sample[:SAMPLE_BYTES]
    encoding, skip = byte_order_mark(sample)
    body = sample[skip:]
    best = None
    for d in delimiters:
        for q in quotes:
            counts = _fields_per_line(body, d, q, lines)
            mean = sum(counts) / len(counts) if counts else 0
            if mean <= 1:
                continue
            variance = sum((c - mean) ** 2 for c in counts) / len(counts)
            if best is None or variance < best[0]:
                best = (variance, chr(d), chr(q))
    _, d, q = best or (0, ",", '"')
    return Dialect(d, q, encoding, encoding is not None)


def sniff_file(spark, path: str, **params) -> Dialect:
    """Sniff the first file under ``path``, read through Hadoop's file systems: the sample only."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    status = sorted((s for s in fs.globStatus(p)), key=lambda s: s.getPath().toString())
    files = [s for s in status if s.isFile()] or sorted((s for s in fs.listStatus(p) if s.isFile() and s.getPath().getName()[0] not in "._"), key=lambda s: s.getPath().toString())
    n = min(int(files[0].getLen()), SAMPLE_BYTES)
    stream = fs.open(files[0].getPath())
    try:
        return sniff(bytes(stream.readNBytes(n)), **params)
    finally:
        stream.close()
