"""Binary office files against files put together here, by the published layouts."""

import io
import struct
import zipfile

import pytest

from tabulon.sources import binary, office, readers

FREE, END = 0xFFFFFFFF, 0xFFFFFFFE


def container(streams):
    """An OLE2 file of version 3: streams of 4096 bytes or more in sectors, smaller ones in the small stream."""
    sectors, fat, small, small_fat, places = [], [], b"", [], {}

    def put(data):
        start = len(sectors)
        n = max(1, -(-len(data) // 512))
        for i in range(n):
            sectors.append(data[512 * i : 512 * (i + 1)].ljust(512, b"\0"))
            fat.append(start + i + 1 if i + 1 < n else END)
        return start

    for name, data in streams.items():
        if len(data) >= 4096:
            places[name] = put(data)
        else:
            places[name], n = len(small_fat), max(1, -(-len(data) // 64))
            small_fat += [*range(len(small_fat) + 1, len(small_fat) + n), END]
            small += data.ljust(64 * n, b"\0")
    root = put(small) if small else END
    small_start = put(struct.pack(f"<{len(small_fat)}I", *small_fat).ljust(512, b"\xff")) if small_fat else END
    names = list(streams)

    def entry(name, kind, right, child, start, size):
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, FREE, right, child) + bytes(36) + struct.pack("<IQ", start, size)

    directory = entry("Root Entry", 5, FREE, 1 if names else FREE, root, len(small))
    for i, name in enumerate(names, 1):
        directory += entry(name, 2, i + 1 if i < len(names) else FREE, FREE, places[name], len(streams[name]))
    start = put(directory)
    fat_at = len(sectors)
    fat.append(0xFFFFFFFD)
    sectors.append(struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff"))
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH6xIIIIIIIIII", 0x3E, 3, 0xFFFE, 9, 6, 0, 1, start, 0, 4096, small_start, len(small_fat) and 1, END, 0, fat_at)
    return head.ljust(512, b"\xff") + b"".join(sectors)


def record(kind, body):
    return struct.pack("<HH", kind, len(body)) + body


def test_streams_of_either_size():
    streams = {"Big": bytes(range(256)) * 20, "Small": b"abc", "Other": b"x" * 700, "None": b""}
    assert binary.streams(container(streams)) == streams
    with pytest.raises(ValueError):
        binary.streams(container(streams)[:1500])
    with pytest.raises(ValueError):
        binary.streams(b"no container")


def book(shared_parts):
    head = record(0x809, bytes(16)) + record(0xE0, struct.pack("<HH", 0, 0).ljust(20, b"\0")) + record(0xE0, struct.pack("<HH", 0, 164).ljust(20, b"\0")) + record(0x41E, struct.pack("<HHB", 164, 10, 0) + b"yyyy-mm-dd")
    tail = b"".join(record(0xFC if i == 0 else 0x3C, p) for i, p in enumerate(shared_parts)) + record(0x0A, b"")
    sheet = record(0x809, bytes(16)) + record(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + record(0xFD, struct.pack("<HHHI", 0, 1, 0, 1)) + record(0x203, struct.pack("<HHHd", 1, 0, 0, 2.5)) + record(0x27E, struct.pack("<HHHI", 1, 1, 0, 7 << 2 | 2))
    sheet += record(0xBD, struct.pack("<HHHIHIH", 2, 0, 0, 123 << 2 | 3, 1, 45351 << 2 | 2, 1)) + record(0x205, struct.pack("<HHHBB", 3, 0, 0, 1, 0)) + record(0x205, struct.pack("<HHHBB", 3, 1, 0, 0x2A, 1)) + record(0x204, struct.pack("<HHHHB", 3, 2, 0, 2, 0) + b"hi")
    sheet += record(0x06, struct.pack("<HHHdHIH", 4, 0, 0, 8.0, 0, 0, 0)) + record(0x06, struct.pack("<HHHBBBBHHHIH", 4, 1, 0, 0, 0, 0, 0, 0, 0xFFFF, 0, 0, 0)) + record(0x207, struct.pack("<HB", 3, 0) + b"sum") + record(0x0A, b"")
    bound = lambda at: record(0x85, struct.pack("<IHBB", at, 0, 5, 0) + b"First")
    at = len(head) + len(bound(0)) + len(tail)
    return head + bound(at) + tail + sheet


def text_of(s, wide=False, rich=0):
    return struct.pack("<HB", len(s), wide | 8 * bool(rich)) + (struct.pack("<H", rich) if rich else b"") + s.encode("utf-16-le" if wide else "latin-1") + bytes(4 * rich)


WANT = [(1, 1, "string", "one"), (1, 2, "string", "zwei €"), (2, 1, "float", "2.5"), (2, 2, "int", "7"), (3, 1, "float", "1.23"), (3, 2, "datetime", "45351"), (4, 1, "bool", "TRUE"), (4, 2, "error", "#N/A"), (4, 3, "string", "hi"), (5, 1, "int", "8"), (5, 2, "string", "sum")]


@pytest.mark.parametrize("cut", [None, 16, 26])
def test_xls_cells(cut):
    head = struct.pack("<II", 2, 2) + text_of("one", rich=1)
    second = text_of("zwei €", wide=True)
    if cut is None:
        parts = [head + second]
    elif cut == 16:  # between two strings
        parts = [head, second]
    else:  # within one: what follows is not wide any more where it need not be
        parts = [head + second[: 3 + 2 * 5], b"\1" + second[3 + 2 * 5 :]]
    data = container({"Workbook": book(parts).ljust(5000, b"\0")})
    assert office.detect(data) == "xls"
    assert [(c["row"], c["col"], c["tag"], c["value"]) for c in binary.xls_cells(data)] == WANT and {c["sheet"] for c in binary.xls_cells(data)} == {"First"}


def part(kind, body):
    head = bytes([kind]) if kind < 128 else bytes([kind & 0x7F | 0x80, kind >> 7])
    n, out = len(body), b""
    while True:
        out += bytes([n & 0x7F | (0x80 if n > 127 else 0)])
        n >>= 7
        if not n:
            return head + out + body


def wide(s):
    return struct.pack("<I", len(s)) + s.encode("utf-16-le")


def test_xlsb_cells():
    at = lambda c, style=0: struct.pack("<II", c, style)
    sheet = part(0, struct.pack("<I", 0).ljust(17, b"\0")) + part(7, at(0) + struct.pack("<I", 0)) + part(6, at(1) + wide("zwei €")) + part(0, struct.pack("<I", 1)) + part(5, at(0) + struct.pack("<d", 2.5)) + part(2, at(1) + struct.pack("<I", 7 << 2 | 2))
    sheet += part(0, struct.pack("<I", 2)) + part(2, at(0) + struct.pack("<I", 123 << 2 | 3)) + part(9, at(1, 1) + struct.pack("<d", 45351)) + part(1, at(2)) + part(0, struct.pack("<I", 3)) + part(4, at(0) + b"\1") + part(3, at(1) + b"\x2a") + part(8, at(2) + wide("hi") + bytes(200))
    sheet += part(0, struct.pack("<I", 4)) + part(2, at(0) + struct.pack("<I", 8 << 2 | 2)) + part(6, at(1) + wide("sum"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.bin", part(156, struct.pack("<II", 0, 1) + wide("rId1") + wide("First")))
        z.writestr("xl/_rels/workbook.bin.rels", '<Relationships><Relationship Target="worksheets/sheet1.bin" Id="rId1"/></Relationships>')
        z.writestr("xl/sharedStrings.bin", part(19, b"\0" + wide("one")))
        z.writestr("xl/styles.bin", part(44, struct.pack("<H", 164) + wide("d.m.yy")) + part(626, b"") + part(47, bytes(16)) + part(617, b"") + part(47, bytes(16)) + part(47, struct.pack("<HH", 0, 164).ljust(16, b"\0")) + part(618, b""))
        z.writestr("xl/worksheets/sheet1.bin", sheet)
    data = out.getvalue()
    assert office.detect(data) == "xlsb" and [(c["row"], c["col"], c["tag"], c["value"]) for c in binary.xlsb_cells(data)] == WANT


def doc(text, flags=0x0200, wide_from=12):
    plain, rest = text[:wide_from], text[wide_from:]
    main = bytearray(0x600)
    struct.pack_into("<H", main, 0x0A, flags)
    struct.pack_into("<I", main, 0x4C, len(text))
    pieces = struct.pack("<III", 0, len(plain), len(text)) + struct.pack("<HIH", 0, 0x400 * 2 | 0x40000000, 0) + struct.pack("<HIH", 0, 0x500, 0)
    clx = b"\1" + struct.pack("<H", 3) + b"abc" + b"\2" + struct.pack("<I", len(pieces)) + pieces
    struct.pack_into("<II", main, 0x01A2, 10, len(clx))
    main[0x400 : 0x400 + len(plain)] = plain.encode("cp1252")
    main[0x500 : 0x500 + 2 * len(rest)] = rest.encode("utf-16-le")
    return container({"WordDocument": bytes(main).ljust(4096, b"\0"), "1Table": bytes(10) + clx})


def test_doc_text():
    data = doc("Héllo “x”\rone\x07two\x07\rsee \x13 HYPERLINK \x13 a \x14 b\x15\x14here\x15 日本\r")
    assert office.detect(data) == "doc" and binary.doc_text(data) == "Héllo “x”\none\ttwo\t\nsee here 日本"
    with pytest.raises(ValueError):
        binary.doc_text(doc("secret", flags=0x0300))


def test_ppt_texts():
    atom = lambda kind, body, version=0: struct.pack("<HHI", version, kind, len(body)) + body
    slide = atom(1006, atom(1036, atom(4008, b"shape\rtext"), 0xF) + atom(3999, b"\0\0\0\0"), 0xF)
    data = container({"PowerPoint Document": atom(1000, atom(4080, atom(4000, "Títle".encode("utf-16-le")), 0xF), 0xF) + slide, "Current User": b"u"})
    assert office.detect(data) == "ppt" and binary.ppt_texts(data) == ["Títle", "shape\ntext"]


def test_compressed_rtf():
    body = bytes([0b00000010]) + b"{" + struct.pack(">H", 0 << 4 | 4) + b"hello "  # six bytes from the window's start
    rtf = b"{{\\rtf1hello "
    plain = binary.decompress_rtf(struct.pack("<IIII", len(body) + 12, len(rtf), 0x75465A4C, 0) + body)
    assert plain == rtf
    again = bytes([0b00000100]) + b"ab" + struct.pack(">H", (len(binary._WINDOW)) << 4 | 6)  # copies what it writes
    assert binary.decompress_rtf(struct.pack("<IIII", 0, 10, 0x75465A4C, 0) + again) == b"ab" * 5
    assert binary.decompress_rtf(struct.pack("<IIII", 0, 3, 0x414C454D, 0) + b"abc") == b"abc" and len(binary._WINDOW) == 207
    with pytest.raises(ValueError):
        binary.decompress_rtf(bytes(20))


def test_readers_of_binary_files(spark):
    files = spark.createDataFrame([("a.xls", container({"Workbook": book([struct.pack("<II", 2, 2) + text_of("one") + text_of("zwei €", True)]).ljust(5000, b"\0")})), ("bad.xls", b"nothing"), ("cut.xls", container({"Workbook": b"x" * 9})[:700]), ("locked.xls", container({"Workbook": record(0x2F, b"")}))], "path string, content binary")
    rows = readers.read_content(files, "xls").collect()
    assert sum(r["path"] == "a.xls" for r in rows) == len(WANT) and [(r["path"], r["row"]) for r in rows if r["path"] != "a.xls"] == [("bad.xls", None), ("cut.xls", None), ("locked.xls", None)]
