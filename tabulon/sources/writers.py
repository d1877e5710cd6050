"""Writers: rows of cells to XLSX, ODS and DOCX bytes, and DataFrames to text tables.

A cell is None, a bool, an int, a float, a date or a str; a str that starts with ``=`` is a formula in XLSX and ODS.
Packages are built with fixed times, so that equal rows give equal bytes.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator
from datetime import date, datetime
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.sources import text_tables

#: Namespaces and content types of the packages.
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_TYPES = "application/vnd.openxmlformats-officedocument"
_ODF = "urn:oasis:names:tc:opendocument:xmlns"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


def _package(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            z.writestr(info, text)
    return out.getvalue()


def _relations(of: dict[str, tuple[str, str]]) -> str:
    return f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="{i}" Type="{t}" Target="{target}"/>' for i, (t, target) in of.items()) + "</Relationships>"


def _content_types(of: dict[str, str]) -> str:
    rest = "".join(f'<Override PartName="/{p}" ContentType="{t}"/>' for p, t in of.items())
    return f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{rest}</Types>'


def column_name(n: int) -> str:
    """A, B, ..., Z, AA, ... of 1, 2, ..."""
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _clean(s: str) -> str:
    """Without the control characters that XML cannot hold."""
    return "".join(c for c in s if c in "\t\n\r" or ord(c) >= 32)


def serial(d: date) -> float:
    """Days since 1899-12-30."""
    t = d if isinstance(d, datetime) else datetime(d.year, d.month, d.day)
    return (t - datetime(1899, 12, 30)).total_seconds() / 86400


def xlsx_bytes(sheets: dict[str, Iterable[list]], title: str = "") -> bytes:
    """A workbook; dates carry a date style, text is shared."""
    shared: dict[str, int] = {}

    def cell(ref: str, v) -> str:
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, date):
            return f'<c r="{ref}" s="1"><v>{text_tables.show(serial(v))}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v!r}</v></c>'
        if v.startswith("="):
            return f'<c r="{ref}"><f>{escape(v[1:])}</f></c>'
        return f'<c r="{ref}" t="s"><v>{shared.setdefault(_clean(v), len(shared))}</v></c>'

    parts = {}
    for i, rows in enumerate(sheets.values(), 1):
        body = "".join(f'<row r="{r}">{"".join(cell(f"{column_name(c)}{r}", v) for c, v in enumerate(row, 1))}</row>' for r, row in enumerate(rows, 1))
        parts[f"xl/worksheets/sheet{i}.xml"] = f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>'
    names = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
    links = {f"rId{i}": (f"{_OFFICE}/worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(sheets) + 1)}
    links |= {"rIdS": (f"{_OFFICE}/sharedStrings", "sharedStrings.xml"), "rIdY": (f"{_OFFICE}/styles", "styles.xml")}
    types = {p: f"{_TYPES}.spreadsheetml.worksheet+xml" for p in parts} | {"xl/workbook.xml": f"{_TYPES}.spreadsheetml.sheet.main+xml", "xl/sharedStrings.xml": f"{_TYPES}.spreadsheetml.sharedStrings+xml", "xl/styles.xml": f"{_TYPES}.spreadsheetml.styles+xml"}
    return _package({
        "[Content_Types].xml": _content_types(types), "_rels/.rels": _relations({"rId1": (f"{_OFFICE}/officeDocument", "xl/workbook.xml"), "rId2": (f"{_PACKAGE}/relationships/metadata/core-properties", "docProps/core.xml")}),
        "docProps/core.xml": _core(title), "xl/workbook.xml": f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>{names}</sheets></workbook>', "xl/_rels/workbook.xml.rels": _relations(links),
        "xl/styles.xml": f'{_HEAD}<styleSheet xmlns="{_MAIN}"><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": f'{_HEAD}<sst xmlns="{_MAIN}">{"".join(f"<si><t xml:space={chr(34)}preserve{chr(34)}>{escape(s)}</t></si>" for s in shared)}</sst>', **parts,
    })


def _core(title: str) -> str:
    return f'{_HEAD}<cp:coreProperties xmlns:cp="{_PACKAGE}/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(_clean(title))}</dc:title></cp:coreProperties>'


def ods_bytes(sheets: dict[str, Iterable[list]]) -> bytes:
    def cell(v) -> str:
        if v is None:
            return "<table:table-cell/>"
        if isinstance(v, bool):
            return f'<table:table-cell office:value-type="boolean" office:boolean-value="{str(v).lower()}"><text:p>{text_tables.show(v)}</text:p></table:table-cell>'
        if isinstance(v, date):
            return f'<table:table-cell office:value-type="date" office:date-value="{v.isoformat()}"><text:p>{v.isoformat()}</text:p></table:table-cell>'
        if isinstance(v, (int, float)):
            return f'<table:table-cell office:value-type="float" office:value="{v!r}"><text:p>{v!r}</text:p></table:table-cell>'
        return f'<table:table-cell office:value-type="string">{"".join(f"<text:p>{escape(_clean(line))}</text:p>" for line in v.split(chr(10)))}</table:table-cell>'

    tables = "".join(f"<table:table table:name={quoteattr(n)}>{''.join(f'<table:table-row>{chr(0).join(map(cell, r)).replace(chr(0), str())}</table:table-row>' for r in rows)}</table:table>" for n, rows in sheets.items())
    kinds = " ".join(f'xmlns:{k}="{_ODF}:{k}:1.0"' for k in ("office", "table", "text"))
    mime = "application/vnd.oasis.opendocument.spreadsheet"
    manifest = f'{_HEAD}<manifest:manifest xmlns:manifest="{_ODF}:manifest:1.0"><manifest:file-entry manifest:full-path="/" manifest:media-type="{mime}"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>'
    return _package({"mimetype": mime, "content.xml": f"{_HEAD}<office:document-content {kinds}><office:body><office:spreadsheet>{tables}</office:spreadsheet></office:body></office:document-content>", "META-INF/manifest.xml": manifest})


def docx_bytes(elements: Iterable[dict], title: str = "") -> bytes:
    """Elements are ``{"text", "style", "bold", "italic"}`` paragraphs or ``{"rows": [[...], ...]}`` tables."""

    def paragraph(text: str, style: str | None = None, bold: bool = False, italic: bool = False) -> str:
        marks = f"<w:rPr>{'<w:b/>' * bold}{'<w:i/>' * italic}</w:rPr>" if bold or italic else ""
        looks = f"<w:pPr><w:pStyle w:val={quoteattr(style)}/></w:pPr>" if style else ""
        lines = "<w:br/>".join(f'<w:t xml:space="preserve">{escape(_clean(s))}</w:t>' for s in text.split("\n"))
        return f"<w:p>{looks}<w:r>{marks}{lines}</w:r></w:p>"

    body = []
    for e in elements:
        if "rows" in e:
            body.append("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(text_tables.show(v))}</w:tc>" for v in r) + "</w:tr>" for r in e["rows"]) + "</w:tbl>")
        else:
            body.append(paragraph(**e))
    return _package({
        "[Content_Types].xml": _content_types({"word/document.xml": f"{_TYPES}.wordprocessingml.document.main+xml"}), "_rels/.rels": _relations({"rId1": (f"{_OFFICE}/officeDocument", "word/document.xml"), "rId2": (f"{_PACKAGE}/relationships/metadata/core-properties", "docProps/core.xml")}),
        "docProps/core.xml": _core(title), "word/document.xml": f'{_HEAD}<w:document xmlns:w="{_WORD}"><w:body>{"".join(body)}</w:body></w:document>',
    })


def rtf_bytes(paragraphs: Iterable[str]) -> bytes:
    def sign(c: str) -> str:
        return "\\" + c if c in "\\{}" else c if ord(c) < 128 else "".join(f"\\u{int.from_bytes(u, 'little', signed=True)}?" for u in _units(c))

    return ("{\\rtf1\\ansi\\uc1 " + "\\par ".join("".join(map(sign, p)) for p in paragraphs) + "}").encode("ascii")


def _units(c: str) -> Iterator[bytes]:
    data = c.encode("utf-16-le", "surrogatepass")
    return (data[i : i + 2] for i in range(0, len(data), 2))


#: Kinds of files that :func:`workbooks` makes, from one sheet's rows.
FORMATS = {
    "xlsx": lambda rows: xlsx_bytes({"Sheet1": rows}), "ods": lambda rows: ods_bytes({"Sheet1": rows}), "csv": lambda rows: text_tables.write_delimited(rows).encode(), "tsv": lambda rows: text_tables.write_delimited(rows, "\t").encode(),
    "dif": lambda rows: text_tables.write_dif(rows).encode(), "sylk": lambda rows: text_tables.write_sylk(rows).encode(), "docx": lambda rows: docx_bytes([{"rows": rows}]),
}


def workbooks(df: DataFrame, by: str, order: list[str], columns: list[str], kind: str) -> DataFrame:
    """(path, content): a file for each value of ``by``, with the columns' names and its rows in order.

    A file's rows meet in one task, for they end in one file; null values of ``by`` make a file called null.
    """
    make = FORMATS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                body = [columns, *[list(r["row"].values()) for r in rows]]
                yield pa.RecordBatch.from_arrays([pa.array([f"{key}.{kind}"]), pa.array([make(body)], pa.binary())], names=["path", "content"])

    key = F.coalesce(F.col(f"`{by}`").cast("string"), F.lit("null"))
    cells = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    rows = df.select(key.alias("k"), F.struct(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)], cells.alias("row")).alias("r"))
    return rows.groupBy("k").agg(F.array_sort(F.collect_list("r")).alias("rows")).mapInArrow(run, "path string, content binary")


def delimited_line(df: DataFrame, columns: list[str], separator: str = ",") -> Column:
    """A row's line as :func:`text_tables.write_delimited` has it, as a Column."""

    def cell(c: str) -> Column:
        v, kind = F.col(f"`{c}`"), df.schema[c].dataType.simpleString()
        if kind == "boolean":
            return F.coalesce(F.when(v, '"TRUE"').when(~v, '"FALSE"'), F.lit(""))
        if kind in ("double", "float"):
            return F.coalesce(F.when((v == F.floor(v)) & (F.abs(v) < 1e15), v.cast("decimal(38,0)").cast("string")).otherwise(v.cast("string")), F.lit(""))
        s = F.coalesce(v.cast("string"), F.lit(""))
        if kind != "string":
            return s
        quoted = F.concat(F.lit('"'), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(s.rlike(r'["\r\n\\]') | s.contains(separator), quoted).otherwise(s)

    return F.concat_ws(separator, *map(cell, columns))


def write_delimited(df: DataFrame, path: str, separator: str = ",") -> None:
    """The rows as text files under ``path``, a part for each partition, each with a line of the columns' names."""
    head = text_tables.write_delimited([df.columns], separator)
    line = delimited_line(df, df.columns, separator)
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    df.select(F.when(first, F.concat(F.lit(head + "\n"), line)).otherwise(line).alias("value")).write.text(path)


def write_fixed(df: DataFrame, path: str, widths: dict[str, int]) -> None:
    """Columns cut or filled with spaces to their widths: numbers on the right, all else on the left."""

    def cell(c: str, n: int) -> Column:
        s = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        numeric = df.schema[c].dataType.simpleString().partition("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
        return F.lpad(s, n, " ") if numeric else F.rpad(s, n, " ")

    df.select(F.concat(*[cell(c, n) for c, n in widths.items()]).alias("value")).write.text(path)
