"""Office files without further libraries: format detection, and text and cells of XLSX, DOCX, PPTX, ODF and RTF.

Parsers take one file's bytes; they use the standard zip and XML readers only.  An XML member that declares
entities is refused.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from tabulon.sources import binary
from tabulon.sources.text_tables import infer

_OLE2, _ZIP, _RTF = bytes.fromhex("D0CF11E0A1B11AE1"), b"PK\x03\x04", b"{\\rtf"
#: Formats by a member of the zip container.
_MEMBERS = [("word/document.xml", "docx"), ("xl/workbook.xml", "xlsx"), ("xl/workbook.bin", "xlsb"), ("ppt/presentation.xml", "pptx"), ("Index/Document.iwa", "iwork")]
#: Formats by the mimetype member of OpenDocument containers.
_MIMETYPES = {"application/vnd.oasis.opendocument.text": "odt", "application/vnd.oasis.opendocument.spreadsheet": "ods", "application/vnd.oasis.opendocument.presentation": "odp"}


def detect(content: bytes) -> str | None:
    """OLE2 first, then zip containers, then RTF; None where nothing fits."""
    if content.startswith(_OLE2):
        return binary.kind_of(content)
    if content.startswith(_ZIP):
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                names = set(z.namelist())
                if "mimetype" in names and (m := z.read("mimetype").decode("ascii", "replace").strip()) in _MIMETYPES:
                    return _MIMETYPES[m]
                return next((f for name, f in _MEMBERS if name in names), "zip")
        except zipfile.BadZipFile:
            return None
    return "rtf" if content.startswith(_RTF) else None


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element:
    data = z.read(name)
    if b"<!ENTITY" in data:
        raise ValueError(f"{name} declares entities")
    return ET.fromstring(data)


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _find(e: ET.Element, *names: str) -> Iterator[ET.Element]:
    return (x for x in e.iter() if _local(x) in names)


def _attr(e: ET.Element, name: str, default: str | None = None) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), default)


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


#: Built-in number formats that show dates or times.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def xlsx_cells(content: bytes) -> Iterator[dict]:
    """sheet, row, col (from 1), tag (int, float, datetime, bool, string, error), value as text, formula."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in _find(si, "t")) for si in _find(_xml(z, "xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in names else []
        dates: set[int] = set()
        if "xl/styles.xml" in names:
            styles = _xml(z, "xl/styles.xml")
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in _find(styles, "numFmt")}
            for xfs in _find(styles, "cellXfs"):
                for i, xf in enumerate(xfs):
                    f = int(xf.get("numFmtId", "0"))
                    if f in _DATE_FORMATS or re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(f, "")), re.I):
                        dates.add(i)
        targets = {r.get("Id"): r.get("Target") for r in _find(_xml(z, "xl/_rels/workbook.xml.rels"), "Relationship")}
        for sheet in _find(_xml(z, "xl/workbook.xml"), "sheet"):
            target = targets[_attr(sheet, "id")]
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            row_no = 0
            for row in _find(_xml(z, path), "row"):
                row_no = int(row.get("r", row_no + 1))
                col = 0
                for c in _find(row, "c"):
                    col = _column(c.get("r", "")) or col + 1
                    v = next((x.text for x in c if _local(x) == "v"), None)
                    formula = next((x.text for x in c if _local(x) == "f"), None)
                    kind = c.get("t", "n")
                    if kind == "inlineStr":
                        tag, v = "string", "".join(t.text or "" for t in _find(c, "t"))
                    elif v is None:
                        if formula is None:
                            continue
                        tag = "empty"
                    elif kind == "s":
                        tag, v = "string", shared[int(v)]
                    elif kind in ("str", "b", "e"):
                        tag = {"str": "string", "b": "bool", "e": "error"}[kind]
                        v = {"1": "TRUE", "0": "FALSE"}.get(v, v) if kind == "b" else v
                    else:
                        tag = "datetime" if int(c.get("s", "0")) in dates else "int" if isinstance(infer(v), int) else "float"
                    yield {"sheet": sheet.get("name"), "row": row_no, "col": col, "tag": tag, "value": v, "formula": formula}


def ods_cells(content: bytes) -> Iterator[dict]:
    """As :func:`xlsx_cells`; repeated rows and cells are spread out where they hold a value."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = _xml(z, "content.xml")
    tags = {"float": "float", "percentage": "float", "currency": "float", "boolean": "bool", "date": "datetime", "time": "datetime", "string": "string"}
    for table in _find(root, "table"):
        row_no = 1
        for row in _find(table, "table-row"):
            times, col, found = int(_attr(row, "number-rows-repeated", "1")), 1, []
            for cell in row:
                if _local(cell) not in ("table-cell", "covered-table-cell"):
                    continue
                n, kind = int(_attr(cell, "number-columns-repeated", "1")), _attr(cell, "value-type")
                if kind:
                    text = "\n".join("".join(p.itertext()) for p in _find(cell, "p"))
                    v = _attr(cell, "value") or _attr(cell, "boolean-value") or _attr(cell, "date-value") or _attr(cell, "time-value") or text
                    found += [{"sheet": _attr(table, "name"), "col": col + i, "tag": tags.get(kind, "string"), "value": v.upper() if kind == "boolean" else v, "formula": _attr(cell, "formula")} for i in range(n)]
                col += n
            for i in range(times if found else 0):
                yield from ({**f, "row": row_no + i} for f in found)
            row_no += times


def _on(properties: ET.Element | None, name: str) -> bool:
    e = None if properties is None else next((x for x in properties if _local(x) == name), None)
    return e is not None and _attr(e, "val", "1") not in ("0", "false", "none")


def docx_elements(content: bytes) -> Iterator[dict]:
    """elem, kind (paragraph or table), style, and its runs or table cells, in document order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = next(_find(_xml(z, "word/document.xml"), "body"))

    def runs(p: ET.Element) -> list[dict]:
        out = []
        for r in _find(p, "r"):
            text = "".join({"t": x.text or "", "tab": "\t", "br": "\n"}.get(_local(x), "") for x in r)
            pr = next((x for x in r if _local(x) == "rPr"), None)
            if text:
                vertical = next((_attr(x, "val") for x in (pr if pr is not None else ()) if _local(x) == "vertAlign"), None)
                out.append({"text": text, "bold": _on(pr, "b"), "italic": _on(pr, "i"), "strike": _on(pr, "strike"), "vertical_position": vertical})
        return out

    for i, e in enumerate(x for x in body if _local(x) in ("p", "tbl")):
        if _local(e) == "p":
            style = next((_attr(x, "val") for x in _find(e, "pStyle")), None)
            r = runs(e)
            yield {"elem": i, "kind": "paragraph", "style": style, "text": "".join(x["text"] for x in r), "runs": r, "cells": []}
        else:
            cells = []
            for y, tr in enumerate(x for x in e if _local(x) == "tr"):
                for x, tc in enumerate(t for t in tr if _local(t) == "tc"):
                    text = "\n".join("".join(k["text"] for k in runs(p)) for p in tc if _local(p) == "p")
                    span = next((int(_attr(g, "val")) for g in _find(tc, "gridSpan")), 1)
                    merge = next((_attr(g, "val", "continue") for g in _find(tc, "vMerge")), None)
                    cells.append({"row": y, "col": x, "text": text, "grid_span": span, "v_merge": merge})
            yield {"elem": i, "kind": "table", "style": None, "text": "\n".join(c["text"] for c in cells), "runs": [], "cells": cells}


def pptx_slides(content: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for i, name in enumerate(slides, 1):
            root = _xml(z, name)
            text = "\n".join("".join(t.text or "" for t in _find(p, "t")) for p in _find(root, "p"))
            yield {"slide_no": i, "name": next((_attr(c, "name") for c in _find(root, "cSld")), None) or "", "text": text, "shape_count": sum(1 for _ in _find(root, "sp", "pic", "graphicFrame"))}


def odf_paragraphs(content: bytes) -> Iterator[dict]:
    """Headings and paragraphs of a text document, or of the pages of a presentation (``page`` from 1)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = _xml(z, "content.xml")

    def text(e: ET.Element) -> str:
        out = e.text or ""
        for x in e:
            out += {"s": " " * int(_attr(x, "c", "1")), "tab": "\t", "line-break": "\n"}.get(_local(x), None) or text(x)
            out += x.tail or ""
        return out

    pages = list(_find(root, "page"))
    for page, scope in enumerate(pages or [root], 1 if pages else 0):
        for e in _find(scope, "h", "p"):
            yield {"page": page, "kind": "heading" if _local(e) == "h" else "paragraph", "level": int(_attr(e, "outline-level", "0")), "text": text(e)}


#: Members that hold the properties of a document, by format family.
_PROPERTIES = ("docProps/core.xml", "meta.xml")
#: Properties by the names that the families give them.
_PROPERTY_NAMES = {
    "title": "title", "subject": "subject", "creator": "creator", "initial-creator": "author", "description": "description", "keywords": "keywords", "keyword": "keywords", "lastModifiedBy": "last_modified_by",
    "created": "created", "creation-date": "created", "modified": "modified", "date": "modified", "category": "category", "revision": "revision", "editing-cycles": "revision", "language": "language",
}


def properties(content: bytes) -> Iterator[dict]:
    """name and value of the document's properties, of an office or OpenDocument package."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for member in _PROPERTIES:
            if member in z.namelist():
                for e in _xml(z, member).iter():
                    if _local(e) in _PROPERTY_NAMES and (e.text or "").strip():
                        yield {"name": _PROPERTY_NAMES[_local(e)], "value": e.text.strip()}


def _text(e: ET.Element) -> str:
    """Paragraphs of an element, a line each."""
    lines = ["".join(t.text or "" for t in _find(p, "t")) for p in _find(e, "p")]
    return "\n".join(lines) if lines else "".join(t.text or "" for t in _find(e, "t"))


def _links(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, _, name = part.rpartition("/")
    rels = f"{folder}/_rels/{name}.rels"
    return {r.get("Id"): r.get("Target") for r in _find(_xml(z, rels), "Relationship")} if rels in z.namelist() else {}


def extras(content: bytes) -> Iterator[dict]:
    """What stands beside a document's text: kind, place, name, author, date and text, in the order of its parts.

    Hyperlinks, comments, notes, headers, footers and bookmarks of DOCX; merged cells, hyperlinks, comments, defined
    names and tables of XLSX; notes, comments and tables of PPTX; annotations, notes, links and bookmarks of
    OpenDocument files.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        if "word/document.xml" in names:
            yield from _docx_extras(z, names)
        elif "xl/workbook.xml" in names:
            yield from _xlsx_extras(z, names)
        elif "ppt/presentation.xml" in names:
            yield from _pptx_extras(z, names)
        elif "content.xml" in names:
            yield from _odf_extras(_xml(z, "content.xml"))


def _comments(root: ET.Element, kind: str = "comment") -> Iterator[dict]:
    for c in _find(root, "comment", "cm"):
        yield {"kind": kind, "place": _attr(c, "ref") or _attr(c, "id"), "author": _attr(c, "author"), "date": _attr(c, "date") or _attr(c, "dt"), "text": _text(c) or "".join(x.text or "" for x in _find(c, "text"))}


def _docx_extras(z: zipfile.ZipFile, names: list[str]) -> Iterator[dict]:
    links, root = _links(z, "word/document.xml"), _xml(z, "word/document.xml")
    for e in _find(root, "hyperlink", "bookmarkStart"):
        if _local(e) == "hyperlink":
            target = links.get(_attr(e, "id", "")) or "#" + _attr(e, "anchor", "")
            yield {"kind": "hyperlink", "place": target, "text": "".join(t.text or "" for t in _find(e, "t"))}
        else:
            yield {"kind": "bookmark", "place": _attr(e, "id"), "name": _attr(e, "name")}
    for name in sorted(n for n in names if re.fullmatch(r"word/(comments|footnotes|endnotes|header\d*|footer\d*)\.xml", n)):
        kind = re.match(r"word/([a-z]+)", name)[1]
        part = _xml(z, name)
        if kind == "comments":
            yield from _comments(part)
        elif kind in ("footnotes", "endnotes"):
            yield from ({"kind": kind[:-1], "place": _attr(n, "id"), "text": _text(n)} for n in _find(part, kind[:-1]) if _attr(n, "type") is None)
        else:
            yield {"kind": kind, "place": name.rpartition("/")[2], "text": _text(part)}


def _xlsx_extras(z: zipfile.ZipFile, names: list[str]) -> Iterator[dict]:
    book, targets = _xml(z, "xl/workbook.xml"), _links(z, "xl/workbook.xml")
    for n in _find(book, "definedName"):
        yield {"kind": "defined name", "name": n.get("name"), "text": n.text}
    for sheet in _find(book, "sheet"):
        part = "xl/" + targets[_attr(sheet, "id")].removeprefix("/xl/")
        own, where = _links(z, part), sheet.get("name")
        root = _xml(z, part)
        for e in _find(root, "mergeCell", "hyperlink"):
            if _local(e) == "mergeCell":
                yield {"kind": "merged cells", "place": e.get("ref"), "name": where}
            else:
                yield {"kind": "hyperlink", "place": e.get("ref"), "name": where, "text": own.get(_attr(e, "id", "")) or "#" + e.get("location", "")}
        for target in own.values():
            path = "xl/" + target.removeprefix("../").removeprefix("/xl/")
            if path in names and "table" in path:
                t = _xml(z, path)
                yield {"kind": "table", "place": t.get("ref"), "name": t.get("displayName") or t.get("name"), "text": ",".join(c.get("name", "") for c in _find(t, "tableColumn"))}
            elif path in names and "comments" in path:
                authors = [a.text or "" for a in _find(_xml(z, path), "author")]
                for c in _find(_xml(z, path), "comment"):
                    yield {"kind": "comment", "place": c.get("ref"), "name": where, "author": authors[int(c.get("authorId", "0"))] if authors else None, "text": "".join(t.text or "" for t in _find(c, "t"))}


def _pptx_extras(z: zipfile.ZipFile, names: list[str]) -> Iterator[dict]:
    number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
    for name in sorted((n for n in names if re.fullmatch(r"ppt/(notesSlides/notesSlide|comments/comment|slides/slide)\d+\.xml", n)), key=lambda n: (n.split("/")[1], number(n))):
        root, place = _xml(z, name), str(number(name))
        if "notesSlide" in name:
            yield {"kind": "notes", "place": place, "text": _text(root)}
        elif "comment" in name:
            yield from _comments(root)
        else:
            for t in _find(root, "tbl"):
                rows = ["\t".join(_text(c) for c in _find(r, "tc")) for r in _find(t, "tr")]
                yield {"kind": "table", "place": place, "text": "\n".join(rows)}


def _odf_extras(root: ET.Element) -> Iterator[dict]:
    for e in _find(root, "annotation", "note", "a", "bookmark", "bookmark-start"):
        kind = _local(e)
        if kind == "annotation":
            by, at = (next((x.text for x in e if _local(x) == n), None) for n in ("creator", "date"))
            yield {"kind": "comment", "author": by, "date": at, "text": "\n".join("".join(p.itertext()) for p in _find(e, "p"))}
        elif kind == "note":
            yield {"kind": _attr(e, "note-class", "footnote"), "place": _attr(e, "id"), "text": "\n".join("".join(p.itertext()) for p in _find(e, "p"))}
        elif kind == "a":
            yield {"kind": "hyperlink", "place": _attr(e, "href"), "text": "".join(e.itertext())}
        else:
            yield {"kind": "bookmark", "name": _attr(e, "name")}


_RTF_TOKEN = re.compile(rb"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-z'])|([{}])|([^\\{}\r\n]+)|[\r\n]+", re.I)
#: Destinations whose text is none of the document's.
_RTF_SKIP = {b"fonttbl", b"colortbl", b"stylesheet", b"info", b"pict", b"header", b"footer", b"generator", b"themedata", b"listtable", b"listoverridetable", b"rsidtbl", b"object"}
_RTF_SIGNS = {b"par": "\n", b"line": "\n", b"tab": "\t", b"emdash": "—", b"endash": "–", b"lquote": "‘", b"rquote": "’", b"ldblquote": "“", b"rdblquote": "”", b"bullet": "•", b"cell": "\t", b"row": "\n", b"sect": "\n", b"page": "\n"}


def rtf_text(content: bytes) -> str:
    """The document's text: code page and Unicode escapes decoded, other destinations left out."""
    out: list[str] = []
    stack: list[tuple[bool, int]] = []
    skip, unicode_skip, pending, code, fresh = False, 1, 0, "cp1252", False
    for m in _RTF_TOKEN.finditer(content):
        word, number, hexed, sign, brace, text = m.groups()
        if brace == b"{":
            stack.append((skip, unicode_skip))
            fresh = True
            continue
        if brace == b"}":
            skip, unicode_skip = stack.pop() if stack else (False, 1)
        elif word is not None:
            if word == b"ansicpg" and number:
                code = f"cp{int(number)}"
            elif word == b"uc" and number:
                unicode_skip = int(number)
            elif word == b"u" and number and not skip:
                out.append(chr(int(number) % 65536))
                pending = unicode_skip
            elif fresh and word in _RTF_SKIP:
                skip = True
            elif not skip and word in _RTF_SIGNS:
                out.append(_RTF_SIGNS[word])
        elif sign == b"*" and fresh:
            skip = True
        elif not skip:
            piece = bytes.fromhex(hexed.decode()) if hexed else sign if sign in (b"\\", b"{", b"}") else b" " if sign == b"~" else text or b""
            drop = min(pending, len(piece))
            pending -= drop
            out.append(piece[drop:].decode(code, "replace"))
        fresh = False
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace").strip("\n")
