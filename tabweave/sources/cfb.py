"""Compound files: reading and writing the named streams of an OLE container."""

from __future__ import annotations

import struct

from .cells import WorkbookError

SIGNATURE = bytes.fromhex("d0cf11e0a1b11ae1")
_FREE, _END, _FAT = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD
_MINI_CUTOFF = 4096


def streams(data: bytes) -> dict[str, bytes]:
    """All streams by path; chains that loop or leave the file are errors."""
    if data[:8] != SIGNATURE or len(data) < 512:
        raise WorkbookError("not a compound file")
    shift, mini_shift = struct.unpack_from("<HH", data, 30)
    if shift not in (9, 12) or mini_shift != 6:
        raise WorkbookError("unusual sector sizes")
    size = 1 << shift
    first_dir, _, cutoff, first_mini, _, first_difat, n_difat = struct.unpack_from("<IIIIIII", data, 48)
    limit = len(data) // size + 1

    def sector(k: int) -> bytes:
        at = (k + 1) * size
        if at >= len(data):
            raise WorkbookError("a sector lies beyond the file")
        return data[at : at + size].ljust(size, b"\0")

    difat = list(struct.unpack_from("<109I", data, 76))
    at = first_difat
    for _ in range(n_difat):
        if at >= _FAT:
            break
        words = struct.unpack(f"<{size // 4}I", sector(at))
        difat += words[:-1]
        at = words[-1]
    fat: list[int] = []
    for k in difat:
        if k < _FAT:
            fat += struct.unpack(f"<{size // 4}I", sector(k))

    def chain(k: int, table: list[int], most: int):
        n = 0
        while k < _FAT:
            if k >= len(table) or n > most:
                raise WorkbookError("a broken chain of sectors")
            yield k
            k = table[k]
            n += 1

    directory = b"".join(sector(k) for k in chain(first_dir, fat, limit))
    mini_fat: list[int] = []
    for k in chain(first_mini, fat, limit):
        mini_fat += struct.unpack(f"<{size // 4}I", sector(k))
    entries = []
    for at in range(0, len(directory), 128):
        e = directory[at : at + 128]
        n = struct.unpack_from("<H", e, 64)[0]
        left, right, child = struct.unpack_from("<III", e, 68)
        start, length = struct.unpack_from("<IQ", e, 116)
        entries.append((e[: max(0, n - 2)].decode("utf-16-le", "replace"), e[66], left, right, child, start, length if shift == 12 else length & 0xFFFFFFFF))
    mini = b"".join(sector(k) for k in chain(entries[0][5], fat, limit)) if entries else b""
    out: dict[str, bytes] = {}
    seen: set[int] = set()

    def walk(k: int, prefix: str) -> None:
        todo = [k]
        while todo:
            k = todo.pop()
            if k >= len(entries) or k in seen:
                continue
            seen.add(k)
            name, kind, left, right, child, start, length = entries[k]
            todo += [left, right]
            if kind == 1:
                walk(child, f"{prefix}{name}/")
            elif kind == 2:
                if length < cutoff:
                    raw = b"".join(mini[j * 64 : j * 64 + 64] for j in chain(start, mini_fat, len(mini_fat)))
                else:
                    raw = b"".join(sector(j) for j in chain(start, fat, limit))
                if len(raw) < length:
                    raise WorkbookError(f"stream {name} is cut off")
                out[prefix + name] = raw[:length]

    if entries:
        walk(entries[0][4], "")
    return out


def container(named: dict[str, bytes]) -> bytes:
    """A version 3 compound file with streams in its root. Small streams are padded past the mini cutoff's need by a mini stream."""
    size = 512
    names = sorted(named, key=lambda n: (len(n), n.upper()))
    mini, mini_fat, body, fat, start = b"", [], [], [], {}

    def store(raw: bytes) -> int:
        first = len(body)
        n = -(-len(raw) // size)
        for k in range(n):
            body.append(raw[k * size : (k + 1) * size].ljust(size, b"\0"))
            fat.append(first + k + 1 if k < n - 1 else _END)
        return first if n else _END

    for n in names:
        raw = named[n]
        if len(raw) < _MINI_CUTOFF:
            first, count = len(mini_fat), -(-len(raw) // 64)
            start[n] = first if count else _END
            mini += raw.ljust(count * 64, b"\0")
            mini_fat += [first + k + 1 if k < count - 1 else _END for k in range(count)]
        else:
            start[n] = store(raw)
    mini_start = store(mini)
    table = b"".join(struct.pack("<I", x) for x in mini_fat)
    table = table.ljust(-(-len(table) // size) * size, b"\xff")
    mini_fat_start = store(table)

    def entry(name: str, kind: int, right: int, child: int, first: int, length: int) -> bytes:
        raw = name.encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw) + 2 if name else 0, kind, 1, _FREE, right, child) + b"\0" * 36 + struct.pack("<IQ", first, length)

    # siblings as a chain to the right, in the order of names
    entries = [entry("Root Entry", 5, _FREE, 1 if names else _FREE, mini_start, len(mini))]
    entries += [entry(n, 2, k + 2 if k + 1 < len(names) else _FREE, _FREE, start[n], len(named[n])) for k, n in enumerate(names)]
    while len(entries) % 4:
        entries.append(entry("", 0, _FREE, _FREE, 0, 0))
    directory = store(b"".join(entries))
    n_fat = n_difat = 0
    while True:
        total = len(body) + n_fat + n_difat
        need = -(-total // (size // 4))
        more = max(0, -(-(need - 109) // (size // 4 - 1)))
        if need == n_fat and more == n_difat:
            break
        n_fat, n_difat = need, more
    first_fat = len(body)
    fat += [_FAT] * n_fat + [0xFFFFFFFC] * n_difat
    fat += [_FREE] * (n_fat * (size // 4) - len(fat))
    fat_raw = struct.pack(f"<{len(fat)}I", *fat)
    places = list(range(first_fat, first_fat + n_fat))
    head, rest = places[:109], places[109:]
    difat = b""
    per = size // 4 - 1
    for k in range(n_difat):
        part = rest[k * per : (k + 1) * per]
        nxt = first_fat + n_fat + k + 1 if k + 1 < n_difat else _END
        difat += struct.pack(f"<{size // 4}I", *part, *[_FREE] * (per - len(part)), nxt)
    header = SIGNATURE + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6
    header += struct.pack("<IIIIIIIII", 0, n_fat, directory, 0, _MINI_CUTOFF, mini_fat_start, len(table) // size, first_fat + n_fat if n_difat else _END, n_difat)
    header += struct.pack("<109I", *head, *[_FREE] * (109 - len(head)))
    return header + b"".join(body) + fat_raw + difat
