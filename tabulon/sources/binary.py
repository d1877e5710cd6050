"""Binary office files: OLE2 containers, cells of XLS (BIFF8) and XLSB, text of DOC and PPT, compressed RTF.

Layouts follow the published format documents.  Parsers take one file's bytes; what they cannot follow raises
ValueError, which the readers turn into a row of nulls.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

_MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
_END = 0xFFFFFFFA  # chains end at any of the reserved numbers above


def _unpack(kind: str, data: bytes, at: int) -> tuple:
    try:
        return struct.unpack_from("<" + kind, data, at)
    except struct.error as e:
        raise ValueError(f"no {kind} at {at}") from e


def streams(content: bytes) -> dict[str, bytes]:
    """The streams of an OLE2 container by their path, storages joined with ``/``."""
    if content[:8] != _MAGIC:
        raise ValueError("no OLE2 container")
    shift, mini_shift = _unpack("HH", content, 30)
    n_fat, directory = _unpack("I", content, 44)[0], _unpack("I", content, 48)[0]
    cutoff, mini_start, _, difat, n_difat = _unpack("IIIII", content, 56)
    size = 1 << shift

    def sector(i: int) -> bytes:
        return content[(i + 1) * size : (i + 2) * size]

    fat_sectors = list(_unpack("109I", content, 76))
    for _ in range(n_difat):
        if difat >= _END:
            break
        *more, difat = _unpack(f"{size // 4}I", sector(difat), 0)
        fat_sectors += more
    fat: list[int] = []
    for i in fat_sectors[:n_fat]:
        if i < _END:
            fat += _unpack(f"{size // 4}I", sector(i), 0)

    def chain(start: int, table: list[int], part) -> bytes:
        out, seen = [], 0
        while start < _END:
            if start >= len(table) or seen > len(table):
                raise ValueError("broken chain")
            out.append(part(start))
            start, seen = table[start], seen + 1
        return b"".join(out)

    entries = []
    data = chain(directory, fat, sector)
    for at in range(0, len(data) - 127, 128):
        n, kind = _unpack("HB", data, at + 64)
        left, right, child = _unpack("III", data, at + 68)
        start, length = _unpack("IQ", data, at + 116)
        entries.append((data[at : at + max(n - 2, 0)].decode("utf-16-le", "replace"), kind, left, right, child, start, length & 0xFFFFFFFF if shift == 9 else length))
    if not entries:
        return {}
    mini_data = chain(entries[0][5], fat, sector) if entries[0][5] < _END else b""
    raw = chain(mini_start, fat, sector) if mini_start < _END else b""
    mini_fat = list(_unpack(f"{len(raw) // 4}I", raw, 0))
    mini = 1 << mini_shift
    out: dict[str, bytes] = {}
    todo, seen = [(entries[0][4], "")], set()
    while todo:
        i, path = todo.pop()
        if i >= len(entries) or i in seen:
            continue
        seen.add(i)
        name, kind, left, right, child, start, length = entries[i]
        todo += [(left, path), (right, path)]
        if kind == 1:
            todo.append((child, f"{path}{name}/"))
        elif kind == 2:
            body = chain(start, fat, sector) if length >= cutoff else chain(start, mini_fat, lambda k: mini_data[k * mini : (k + 1) * mini]) if length else b""
            out[path + name] = body[:length]
    return out


#: Formats by the stream that holds the document.
_STREAMS = [("WordDocument", "doc"), ("Workbook", "xls"), ("Book", "xls"), ("PowerPoint Document", "ppt")]


def kind_of(content: bytes) -> str:
    """doc, xls or ppt by the container's streams, else ole2; of one that is cut short, by their names in the bytes."""
    try:
        names = streams(content)
    except ValueError:
        names = {name for name, _ in _STREAMS if name.encode("utf-16-le") in content}
    return next((kind for name, kind in _STREAMS if name in names), "ole2")


# Spreadsheets

#: Built-in number formats that show dates or times; error values.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A", 0x2B: "#GETTING_DATA"}


def _rk(v: int) -> float:
    """A number in 30 bits: whole or the top of a double, perhaps in hundredths."""
    x = float((v if v < 1 << 31 else v - (1 << 32)) >> 2) if v & 2 else struct.unpack("<d", struct.pack("<Q", (v & 0xFFFFFFFC) << 32))[0]
    return x / 100 if v & 1 else x


def _number(x: float, is_date: bool) -> tuple[str, str]:
    whole = x == int(x) if abs(x) < 1e15 else False
    return ("datetime" if is_date else "int" if whole else "float"), (str(int(x)) if whole else repr(x))


def _shows_dates(code: str) -> bool:
    return bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code), re.I))


class _Strings:
    """Strings of the shared table, which records of limited length cut anywhere: each later one begins with whether
    its characters are wide."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.part, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            if self.at >= len(self.parts[self.part]):
                self.part, self.at = self.part + 1, 0
                if self.part >= len(self.parts):
                    raise ValueError("shared strings end early")
            piece = self.parts[self.part][self.at : self.at + n]
            out, n, self.at = out + piece, n - len(piece), self.at + len(piece)
        return out

    def text(self) -> str:
        n, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out = []
        while n:
            if self.at >= len(self.parts[self.part]):
                self.part, self.at = self.part + 1, 0
                flags = self.take(1)[0]
            width = 2 if flags & 1 else 1
            fits = min(n, (len(self.parts[self.part]) - self.at) // width)
            if not fits:
                raise ValueError("a character is cut")
            out.append(self.take(fits * width).decode("utf-16-le" if width == 2 else "latin-1", "replace"))
            n -= fits
        self.take(4 * runs + extra)
        return "".join(out)


def _short_text(data: bytes, n: int) -> str:
    wide = data[0] & 1
    return data[1 : 1 + n * (1 + wide)].decode("utf-16-le" if wide else "latin-1", "replace")


def _records(data: bytes, at: int = 0) -> Iterator[tuple[int, int, bytes]]:
    while at + 4 <= len(data):
        kind, n = struct.unpack_from("<HH", data, at)
        yield at, kind, data[at + 4 : at + 4 + n]
        at += 4 + n


def xls_cells(content: bytes) -> Iterator[dict]:
    """Cells of BIFF8 workbooks, with the columns of :func:`office.xlsx_cells`; formulas come with their values only."""
    found = streams(content)
    data = found.get("Workbook") or found.get("Book") or b""
    sheets, shared, formats, styles, parts = [], [], {}, [], None
    for _, kind, body in _records(data):
        if kind == 0x3C and parts is not None:
            parts.append(body)
            continue
        if parts is not None:
            strings = _Strings(parts)
            n = struct.unpack("<II", strings.take(8))[1]
            shared, parts = [strings.text() for _ in range(n)], None
        if kind == 0xFC:
            parts = [body]
        elif kind == 0x85:
            at, _, n = _unpack("IHB", body, 0)
            sheets.append((at, _short_text(body[7:], n)))
        elif kind == 0x41E:
            formats[_unpack("H", body, 0)[0]] = _short_text(body[4:], _unpack("H", body, 2)[0])
        elif kind == 0xE0:
            styles.append(_unpack("H", body, 2)[0])
        elif kind == 0x2F:
            raise ValueError("the workbook is encrypted")
        elif kind == 0x0A:
            break
    dates = {i for i, f in enumerate(styles) if f in _DATE_FORMATS or _shows_dates(formats.get(f, ""))}
    for at, name in sheets:
        waiting = None
        for _, kind, body in _records(data, at):
            if kind == 0x0A:
                break
            place = (lambda r, c: {"sheet": name, "row": r + 1, "col": c + 1, "formula": None})
            if kind in (0xFD, 0x203, 0x27E, 0x204, 0x205, 0x06):
                row, col, style = _unpack("HHH", body, 0)
                cell = place(row, col)
                if kind == 0xFD:
                    yield cell | {"tag": "string", "value": shared[_unpack("I", body, 6)[0]]}
                elif kind == 0x204:
                    yield cell | {"tag": "string", "value": _short_text(body[8:], _unpack("H", body, 6)[0])}
                elif kind == 0x205:
                    yield cell | ({"tag": "error", "value": _ERRORS.get(body[6], "#ERROR")} if body[7] else {"tag": "bool", "value": "TRUE" if body[6] else "FALSE"})
                elif kind == 0x06 and body[12:14] == b"\xff\xff":
                    if body[6] == 0:
                        waiting = cell
                    elif body[6] in (1, 2):
                        yield cell | ({"tag": "bool", "value": "TRUE" if body[8] else "FALSE"} if body[6] == 1 else {"tag": "error", "value": _ERRORS.get(body[8], "#ERROR")})
                else:
                    x = _rk(_unpack("I", body, 6)[0]) if kind == 0x27E else _unpack("d", body, 6)[0]
                    tag, value = _number(x, style in dates)
                    yield cell | {"tag": tag, "value": value}
            elif kind == 0x207 and waiting is not None:
                yield waiting | {"tag": "string", "value": _short_text(body[2:], _unpack("H", body, 0)[0])}
                waiting = None
            elif kind == 0xBD:
                row, col = _unpack("HH", body, 0)
                for i in range((len(body) - 6) // 6):
                    style, v = _unpack("HI", body, 4 + 6 * i)
                    tag, value = _number(_rk(v), style in dates)
                    yield place(row, col + i) | {"tag": tag, "value": value}


def _parts(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Records of XLSB parts: kind and length in seven bits a byte."""
    at = 0
    while at < len(data):
        kind = data[at]
        at += 1
        if kind & 0x80:
            kind = (kind & 0x7F) | (data[at] & 0x7F) << 7
            at += 1
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 0x7F) << shift
            shift += 7
            if not b & 0x80:
                break
        yield kind, data[at : at + n]
        at += n


def _wide(data: bytes, at: int) -> tuple[str, int]:
    n = _unpack("I", data, at)[0]
    return data[at + 4 : at + 4 + 2 * n].decode("utf-16-le", "replace"), at + 4 + 2 * n


def xlsb_cells(content: bytes) -> Iterator[dict]:
    """Cells of XLSB workbooks, as :func:`xls_cells`."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [_wide(b, 1)[0] for k, b in _parts(z.read("xl/sharedStrings.bin")) if k == 19] if "xl/sharedStrings.bin" in names else []
        formats, styles, inside = {}, [], False
        if "xl/styles.bin" in names:
            for k, b in _parts(z.read("xl/styles.bin")):
                inside = True if k == 617 else False if k == 618 else inside  # the cells' formats, not the named styles'
                if k == 44:
                    formats[_unpack("H", b, 0)[0]] = _wide(b, 2)[0]
                elif k == 47 and inside:
                    styles.append(_unpack("H", b, 2)[0])
        dates = {i for i, f in enumerate(styles) if f in _DATE_FORMATS or _shows_dates(formats.get(f, ""))}
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.bin.rels"))}
        for kind, body in _parts(z.read("xl/workbook.bin")):
            if kind != 156:
                continue
            link, at = _wide(body, 8)
            name, row = _wide(body, at)[0], 0
            for k, b in _parts(z.read("xl/" + links[link].removeprefix("/xl/"))):
                if k == 0:
                    row = _unpack("I", b, 0)[0]
                elif 2 <= k <= 11:
                    col, style = _unpack("II", b, 0)
                    cell = {"sheet": name, "row": row + 1, "col": col + 1, "formula": None}
                    if k in (3, 11):
                        yield cell | {"tag": "error", "value": _ERRORS.get(b[8], "#ERROR")}
                    elif k in (4, 10):
                        yield cell | {"tag": "bool", "value": "TRUE" if b[8] else "FALSE"}
                    elif k in (6, 8):
                        yield cell | {"tag": "string", "value": _wide(b, 8)[0]}
                    elif k == 7:
                        yield cell | {"tag": "string", "value": shared[_unpack("I", b, 8)[0]]}
                    else:
                        tag, value = _number(_rk(_unpack("I", b, 8)[0]) if k == 2 else _unpack("d", b, 8)[0], (style & 0xFFFFFF) in dates)
                        yield cell | {"tag": tag, "value": value}


# Documents

#: Signs of a document's text: paragraph, cell and line ends, page breaks, hyphens.
_DOC_SIGNS = str.maketrans({"\r": "\n", "\x07": "\t", "\x0b": "\n", "\x0c": "\n", "\x1e": "-", "\x1f": "", "\x01": "", "\x08": "", "\x02": "", "\x05": ""})


def doc_text(content: bytes) -> str:
    """The main text, put together from its pieces; of fields, what they show."""
    found = streams(content)
    main = found.get("WordDocument", b"")
    flags = _unpack("H", main, 0x0A)[0]
    if flags & 0x0100:
        raise ValueError("the document is encrypted")
    table = found.get("1Table" if flags & 0x0200 else "0Table", b"")
    length = _unpack("I", main, 0x4C)[0]
    at, n = _unpack("II", main, 0x01A2)
    clx = table[at : at + n]
    i = 0
    while i < len(clx) and clx[i] == 1:
        i += 3 + _unpack("H", clx, i + 1)[0]
    if i >= len(clx) or clx[i] != 2:
        raise ValueError("no piece table")
    size = _unpack("I", clx, i + 1)[0]
    pieces = clx[i + 5 : i + 5 + size]
    k = (size - 4) // 12
    ends = _unpack(f"{k + 1}I", pieces, 0)
    out = []
    for j in range(k):
        start = _unpack("I", pieces, 4 * (k + 1) + 8 * j + 2)[0]
        chars = ends[j + 1] - ends[j]
        if start & 0x40000000:
            start = (start & 0x3FFFFFFF) // 2
            out.append(main[start : start + chars].decode("cp1252", "replace"))
        else:
            out.append(main[start : start + 2 * chars].decode("utf-16-le", "replace"))
    text = "".join(out)[:length]
    shown: list[str] = []
    fields: list[bool] = []  # of those that are open, whether their code is read
    for part in re.split(r"([\x13\x14\x15])", text):
        if part == "\x13":
            fields.append(True)
        elif part == "\x14" and fields:
            fields[-1] = False
        elif part == "\x15" and fields:
            fields.pop()
        elif part not in ("\x14", "\x15") and not any(fields):
            shown.append(part)
    return "".join(shown).translate(_DOC_SIGNS).rstrip("\n")


def ppt_texts(content: bytes) -> list[str]:
    """All texts of a presentation in the order of its records: those of the outline, then of the shapes."""
    data = streams(content).get("PowerPoint Document", b"")
    out: list[str] = []
    todo = [(0, len(data))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            version, kind, n = struct.unpack_from("<HHI", data, at)
            body = (at + 8, min(at + 8 + n, end))
            at += 8 + n
            if version & 0xF == 0xF:
                todo.append((at, end))
                at, end = body
            elif kind == 4000:
                out.append(data[slice(*body)].decode("utf-16-le", "replace").replace("\r", "\n"))
            elif kind == 4008:
                out.append(data[slice(*body)].decode("latin-1").replace("\r", "\n"))
    return out


# Compressed RTF

#: Fixed value: what the window holds before the first byte.
_WINDOW = (
    b"{\\rtf1\\ansi\\mac\\deff0\\deftab720{\\fonttbl;}{\\f0\\fnil \\froman \\fswiss \\fmodern \\fscript \\fdecor MS Sans SerifSymbolArialTimes New RomanCourier"
    b"{\\colortbl\\red0\\green0\\blue0\r\n\\par \\pard\\plain\\f0\\fs20\\b\\i\\u\\tab\\tx"
)


def decompress_rtf(content: bytes) -> bytes:
    """RTF from its compressed form: bytes as they are, or copies from a window of the last 4096."""
    _, size, magic, _ = _unpack("IIII", content, 0)
    if magic == 0x414C454D:
        return content[16 : 16 + size]
    if magic != 0x75465A4C:
        raise ValueError("no compressed RTF")
    window = bytearray(_WINDOW.ljust(4096, b"\0"))
    at, write, out = 16, len(_WINDOW), bytearray()
    while at < len(content) and len(out) < size:
        control = content[at]
        at += 1
        for bit in range(8):
            if control >> bit & 1:
                if at + 2 > len(content):
                    return bytes(out[:size])
                pair = content[at] << 8 | content[at + 1]
                at += 2
                read, n = pair >> 4, (pair & 15) + 2
                if read == write:
                    return bytes(out[:size])
            else:
                if at >= len(content):
                    break
                read, n = -1, 1
            for _ in range(n):
                if read < 0:
                    b = content[at]
                    at += 1
                else:
                    b, read = window[read], (read + 1) & 4095
                out.append(b)
                window[write] = b
                write = (write + 1) & 4095
    return bytes(out[:size])
