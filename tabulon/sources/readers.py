"""Files to DataFrames: one task row a file, parsed where it is read; columns as in the relational schemas."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tabulon.sources import binary, office, text_tables

_CELLS = "path string, sheet string, row int, col int, tag string, value string, formula string"
_RUN = "array<struct<text:string,bold:boolean,italic:boolean,strike:boolean,vertical_position:string>>"
_TABLE = "array<struct<row:int,col:int,text:string,grid_span:int,v_merge:string>>"


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of the files under a path, by Spark's own reader, from any store it knows."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def parsed(content: DataFrame, parse: Callable[[bytes], Iterator[dict]], schema: str) -> DataFrame:
    """``parse`` over each file; a file it can't read gives one row with its path and nulls."""
    names = [f.split()[0] for f in _split(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[dict] = []
                try:
                    rows = [{"path": path, **r} for r in parse(data or b"")]
                except (ValueError, KeyError, IndexError, SyntaxError, StopIteration, RuntimeError, office.zipfile.BadZipFile, NotImplementedError):
                    rows = [{"path": path}]
                if rows:
                    yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=_arrow(schema))

    return content.select("path", "content").mapInArrow(run, schema)


def _split(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += c in "<"
        depth -= c in ">"
        if c == "," and not depth:
            out.append(schema[at:i].strip())
            at = i + 1
    return [*out, schema[at:].strip()]


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}


def _arrow(schema: str) -> pa.Schema:
    def kind(t: str) -> pa.DataType:
        if t.startswith("array<struct<"):
            return pa.list_(pa.struct([(f.partition(":")[0], kind(f.partition(":")[2])) for f in t[13:-2].split(",")]))
        return _ARROW[t]

    return pa.schema([(f.split()[0], kind(f.split(None, 1)[1])) for f in _split(schema)])


def _grid(parse: Callable[[str], Iterator[list]]) -> Callable[[bytes], Iterator[dict]]:
    def run(data: bytes) -> Iterator[dict]:
        tags = {bool: "bool", int: "int", float: "float", str: "string"}
        for r, row in enumerate(parse(data.decode("utf-8-sig", "replace")), 1):
            for c, v in enumerate(row, 1):
                yield {"sheet": "Sheet1", "row": r, "col": c, "tag": "empty" if v is None else tags[type(v)], "value": None if v is None else text_tables.show(v)}

    return run


def read_delimited(spark: SparkSession, path: str, preset: str = "csv") -> DataFrame:
    """Cells of delimited files by the dialect of :func:`text_tables.parse_delimited`."""
    separator = text_tables.PRESETS.get(preset, preset)
    return parsed(files(spark, path), _grid(lambda s: text_tables.parse_delimited(s, separator)), _CELLS)


def read_dif(spark: SparkSession, path: str) -> DataFrame:
    return parsed(files(spark, path), _grid(text_tables.parse_dif), _CELLS)


def read_sylk(spark: SparkSession, path: str) -> DataFrame:
    return parsed(files(spark, path), _grid(text_tables.parse_sylk), _CELLS)


def read_fixed(spark: SparkSession, path: str, widths: list[int] | None = None) -> DataFrame:
    return parsed(files(spark, path), _grid(lambda s: text_tables.parse_fixed(s, widths)), _CELLS)


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    return parsed(files(spark, path), office.xlsx_cells, _CELLS)


def read_xls(spark: SparkSession, path: str) -> DataFrame:
    return parsed(files(spark, path), binary.xls_cells, _CELLS)


def read_xlsb(spark: SparkSession, path: str) -> DataFrame:
    return parsed(files(spark, path), binary.xlsb_cells, _CELLS)


def read_doc(spark: SparkSession, path: str) -> DataFrame:
    return parsed(files(spark, path), lambda b: iter([{"text": binary.doc_text(b)}]), "path string, text string")


def read_ppt(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): a row for each text of a presentation, in order."""
    return parsed(files(spark, path), lambda b: ({"text": t} for t in binary.ppt_texts(b)), "path string, text string")


def read_ods(spark: SparkSession, path: str) -> DataFrame:
    return parsed(files(spark, path), office.ods_cells, _CELLS)


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    return parsed(files(spark, path), office.docx_elements, f"path string, elem int, kind string, style string, text string, runs {_RUN}, cells {_TABLE}")


def read_pptx(spark: SparkSession, path: str) -> DataFrame:
    return parsed(files(spark, path), office.pptx_slides, "path string, slide_no int, name string, text string, shape_count int")


def read_odf(spark: SparkSession, path: str) -> DataFrame:
    return parsed(files(spark, path), office.odf_paragraphs, "path string, page int, kind string, level int, text string")


def read_rtf(spark: SparkSession, path: str) -> DataFrame:
    return parsed(files(spark, path), lambda b: iter([{"text": office.rtf_text(b)}]), "path string, text string")


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, value) of the files' document properties."""
    return parsed(files(spark, path), office.properties, "path string, name string, value string")


_EXTRAS = "path string, kind string, place string, name string, author string, date string, text string"


def read_extras(spark: SparkSession, path: str) -> DataFrame:
    """What stands beside the files' text, as :func:`office.extras` has it."""
    return parsed(files(spark, path), office.extras, _EXTRAS)


#: Parsers by format, with the schema of their rows: what :func:`read_any` and the readers of content share.
PARSERS: dict[str, tuple[Callable[[bytes], Iterator[dict]], str]] = {
    "csv": (_grid(lambda s: text_tables.parse_delimited(s, ",")), _CELLS), "tsv": (_grid(lambda s: text_tables.parse_delimited(s, "\t")), _CELLS), "dif": (_grid(text_tables.parse_dif), _CELLS), "sylk": (_grid(text_tables.parse_sylk), _CELLS),
    "fixed": (_grid(text_tables.parse_fixed), _CELLS), "xlsx": (office.xlsx_cells, _CELLS), "ods": (office.ods_cells, _CELLS), "docx": (office.docx_elements, f"path string, elem int, kind string, style string, text string, runs {_RUN}, cells {_TABLE}"),
    "pptx": (office.pptx_slides, "path string, slide_no int, name string, text string, shape_count int"), "rtf": (lambda b: iter([{"text": office.rtf_text(b)}]), "path string, text string"), "compressed rtf": (lambda b: iter([{"text": office.rtf_text(binary.decompress_rtf(b))}]), "path string, text string"),
    "xls": (binary.xls_cells, _CELLS), "xlsb": (binary.xlsb_cells, _CELLS), "doc": (lambda b: iter([{"text": binary.doc_text(b)}]), "path string, text string"), "ppt": (lambda b: ({"text": t} for t in binary.ppt_texts(b)), "path string, text string"), "properties": (office.properties, "path string, name string, value string"), "extras": (office.extras, _EXTRAS),
}


def read_content(content: DataFrame, kind: str) -> DataFrame:
    """Rows of files that are held as (path, content)."""
    return parsed(content, *PARSERS[kind])


_CELL_PARSERS = {"xlsx": office.xlsx_cells, "ods": office.ods_cells, "xls": binary.xls_cells, "xlsb": binary.xlsb_cells}


def _any_text(data: bytes) -> Iterator[dict]:
    kind = office.detect(data)
    if kind in _CELL_PARSERS:
        rows: dict[tuple, list[str]] = {}
        for c in _CELL_PARSERS[kind](data):
            rows.setdefault((c["sheet"], c["row"]), []).append(c["value"] or "")
        text = "\n".join("\t".join(r) for r in rows.values())
    elif kind == "docx":
        text = "\n".join(e["text"] for e in office.docx_elements(data))
    elif kind == "pptx":
        text = "\n".join(s["text"] for s in office.pptx_slides(data))
    elif kind in ("odt", "odp"):
        text = "\n".join(p["text"] for p in office.odf_paragraphs(data))
    elif kind == "rtf":
        text = office.rtf_text(data)
    elif kind == "doc":
        text = binary.doc_text(data)
    elif kind == "ppt":
        text = "\n".join(binary.ppt_texts(data))
    else:
        text = data.decode("utf-8", "replace") if kind is None else None
    yield {"format": kind or "text", "text": text}


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, text): each file's format told from its bytes, and its text, in one reading; text is null for
    formats that are told apart only."""
    return parsed(files(spark, path), _any_text, "path string, format string, text string")


def detect(spark: SparkSession, path: str) -> DataFrame:
    """(path, format)."""
    return parsed(files(spark, path), lambda b: iter([{"format": office.detect(b)}]), "path string, format string")
