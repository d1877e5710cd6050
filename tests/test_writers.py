"""Writers against the readers, and what stands beside a document's text."""

import io
import time
import zipfile
from datetime import date, datetime

import pytest

from tabulon.functions import documents as doc
from tabulon.plans import formula as fx
from tabulon.plans import grid
from tabulon.sources import office, readers, text_tables, writers

ROWS = [["name", "n"], ["a|b \"c\" & <d>", 5], [None, -2.5], [True, "two\nlines"], ["é😀", None]]


def package(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in members.items():
            z.writestr(k, v)
    return out.getvalue()


@pytest.mark.parametrize("kind", ["xlsx", "ods"])
def test_workbooks_round_trip(kind):
    data = writers.xlsx_bytes({"One": ROWS, "Two & 3": [[date(2024, 2, 29), "=A1+1"]]}, "T") if kind == "xlsx" else writers.ods_bytes({"One": ROWS, "Two & 3": [[date(2024, 2, 29)]]})
    assert office.detect(data) == kind
    cells = {(c["sheet"], c["row"], c["col"]): (c["tag"], c["value"]) for c in (office.xlsx_cells if kind == "xlsx" else office.ods_cells)(data)}
    want = {("One", r, c): v for r, row in enumerate(ROWS, 1) for c, v in enumerate(row, 1) if v is not None}
    assert {k for k in cells if k[0] == "One"} == set(want)
    for k, v in want.items():
        assert cells[k][1] == ("TRUE" if v is True else str(v)), k
    assert cells["Two & 3", 1, 1] == (("datetime", "45351") if kind == "xlsx" else ("datetime", "2024-02-29"))
    assert kind == "ods" or cells["Two & 3", 1, 2] == ("empty", None)
    assert (writers.xlsx_bytes({"S": ROWS}) == writers.xlsx_bytes({"S": ROWS})) and writers.column_name(703) == "AAA" and writers.serial(datetime(1900, 1, 1, 12)) == 2.5


def test_documents_round_trip():
    data = writers.docx_bytes([{"text": "Title", "style": "Heading1"}, {"text": "bold\nline", "bold": True}, {"rows": ROWS[:2]}], "About")
    elements = list(office.docx_elements(data))
    assert [e["kind"] for e in elements] == ["paragraph", "paragraph", "table"] and elements[0]["style"] == "Heading1"
    assert elements[1]["text"] == "bold\nline" and elements[1]["runs"][0]["bold"] and [c["text"] for c in elements[2]["cells"]] == ["name", "n", 'a|b "c" & <d>', "5"]
    assert list(office.properties(data)) == [{"name": "title", "value": "About"}]
    assert office.rtf_text(writers.rtf_bytes(["a {b} \\c", "é😀 z"])) == "a {b} \\c\né😀 z"


def test_extras_of_each_format():
    w = 'xmlns:w="w" xmlns:r="r"'
    docx = package({
        "word/document.xml": f'<w:document {w}><w:body><w:p><w:bookmarkStart w:id="0" w:name="here"/><w:hyperlink r:id="r1"><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p></w:body></w:document>',
        "word/_rels/document.xml.rels": '<Relationships><Relationship Id="r1" Target="http://x.y"/></Relationships>',
        "word/comments.xml": f'<w:comments {w}><w:comment w:id="3" w:author="Ann" w:date="2024"><w:p><w:r><w:t>hm</w:t></w:r></w:p></w:comment></w:comments>',
        "word/footnotes.xml": f'<w:footnotes {w}><w:footnote w:id="-1" w:type="separator"/><w:footnote w:id="2"><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote></w:footnotes>', "word/header1.xml": f"<w:hdr {w}><w:p><w:r><w:t>top</w:t></w:r></w:p></w:hdr>",
    })
    short = lambda data: [(e["kind"], e.get("place"), e.get("name"), e.get("text")) for e in office.extras(data)]
    assert short(docx) == [("bookmark", "0", "here", None), ("hyperlink", "http://x.y", None, "link"), ("comment", "3", None, "hm"), ("footnote", "2", None, "note"), ("header", "header1.xml", None, "top")]
    xlsx = package({
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="a"/></sheets><definedNames><definedName name="total">S!$A$1</definedName></definedNames></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": '<worksheet xmlns:r="r"><mergeCells><mergeCell ref="A1:B2"/></mergeCells><hyperlinks><hyperlink ref="C1" r:id="h"/><hyperlink ref="C2" location="S!A1"/></hyperlinks></worksheet>',
        "xl/worksheets/_rels/sheet1.xml.rels": '<Relationships><Relationship Id="h" Target="http://z"/><Relationship Id="t" Target="../tables/table1.xml"/><Relationship Id="c" Target="../comments1.xml"/></Relationships>',
        "xl/tables/table1.xml": '<table ref="A1:B9" displayName="Sales"><tableColumns><tableColumn name="a"/><tableColumn name="b"/></tableColumns></table>', "xl/comments1.xml": '<comments><authors><author>Bo</author></authors><commentList><comment ref="A2" authorId="0"><text><t>why</t></text></comment></commentList></comments>',
    })
    assert short(xlsx) == [("defined name", None, "total", "S!$A$1"), ("merged cells", "A1:B2", "S", None), ("hyperlink", "C1", "S", "http://z"), ("hyperlink", "C2", "S", "#S!A1"), ("table", "A1:B9", "Sales", "a,b"), ("comment", "A2", "S", "why")]
    pptx = package({"ppt/presentation.xml": "<p/>", "ppt/slides/slide1.xml": "<s><tbl><tr><tc><p><t>a</t></p></tc><tc><p><t>b</t></p></tc></tr></tbl></s>", "ppt/notesSlides/notesSlide1.xml": "<n><p><t>say</t></p></n>"})
    assert short(pptx) == [("notes", "1", None, "say"), ("table", "1", None, "a\tb")]
    odt = package({"content.xml": '<c xmlns:t="t" xmlns:o="o" xmlns:d="d" xmlns:x="x"><t:p><t:a x:href="http://q">w</t:a><o:annotation><d:creator>Cy</d:creator><d:date>2024</d:date><t:p>so</t:p></o:annotation><t:note t:note-class="endnote" t:id="n1"><t:note-body><t:p>end</t:p></t:note-body></t:note><t:bookmark t:name="m"/></t:p></c>'})
    assert short(odt) == [("hyperlink", "http://q", None, "w"), ("comment", None, None, "so"), ("endnote", "n1", None, "end"), ("bookmark", None, "m", None)]


def test_markdown_of_documents(spark):
    elements = [{"text": "Top_ic", "style": "Heading 2"}, {"text": "plain", "italic": True, "bold": True}, {"text": ""}, {"text": "item", "style": "ListBullet"}, {"rows": [["a|b", 1], ["c", None]]}]
    files = spark.createDataFrame([("d.docx", writers.docx_bytes(elements)), ("bad", b"PK\x03\x04 no zip"), ("none", None)], "path string, content binary")
    read = readers.read_content(files, "docx")
    assert {r["path"] for r in read.collect()} == {"d.docx", "bad", "none"}
    (row,) = doc.document_markdown(read).collect()
    assert row["markdown"] == "## Top\\_ic\n\n***plain***\n\n- item\n\n| a\\|b | 1 |\n| --- | --- |\n| c |  |"


def test_markdown_of_tables_in_one_pass(spark):
    ragged = [[(0, "a"), (0, "b"), (3, "c")], [(2, "x"), (2, None)], [(1, "q"), (0, "p|\n")], [(0, "only")]]
    want = ["| a | b |\n| --- | --- |\n|  |\n|  |\n| c |", "|  |\n|\n|  |\n| x |  |", "| p\\|  |\n| --- |\n| q |", "| only |\n| --- |"]
    n = 20_000
    tables = [*ragged, [(y, f"{y}.{x}") for y in range(n) for x in range(2)]]
    fields = "path string, elem int, kind string, style string, text string, runs array<struct<text:string,bold:boolean,italic:boolean,strike:boolean>>, cells array<struct<row:int,text:string>>"
    df = spark.createDataFrame([(str(i), 0, "table", None, "t", [], cells) for i, cells in enumerate(tables)], fields)
    start = time.monotonic()
    got = {int(r["path"]): r["markdown"] for r in doc.document_markdown(df).collect()}
    assert time.monotonic() - start < 20  # twice as many rows take twice the time, not four times
    assert [got[i] for i in range(4)] == want
    assert got[4].split("\n") == ["| 0.0 | 0.1 |", "| --- | --- |", *[f"| {y}.0 | {y}.1 |" for y in range(1, n)]]


def test_delimited_sink(spark, tmp_path):
    rows = [("x", 1.0, True, 5), ('say "hi", you', 2.5, False, None), ("back\\slash\nline", None, None, -1), (None, 1e20, True, 0)]
    df = spark.createDataFrame(rows, "s string, d double, b boolean, n int")
    writers.write_delimited(df.coalesce(1), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    text = part.read_text()
    assert text == text_tables.write_delimited([df.columns, *map(list, rows[:3])]) + "\n,1.0E20,\"TRUE\",0\n"
    assert list(text_tables.parse_delimited(text))[1:3] == [["x", 1, True, 5], ['say "hi", you', 2.5, False, None]]
    writers.write_fixed(df.select("s", "n").limit(1), str(tmp_path / "fixed"), {"s": 4, "n": 3})
    assert [p.read_text() for p in (tmp_path / "fixed").glob("part-*")] == ["x     5\n"]


@pytest.mark.parametrize("text", ["a,b\n1,2.5\n", "# no\na\r\n\n,x,\nlast", "", "\n", "a,,\n,,"])
def test_the_short_way_of_plain_text_is_the_long_one(text):
    quoted = text + ('"' if text.endswith("\n") or not text else "")
    plain, long = list(text_tables.parse_delimited(text)), list(text_tables.parse_delimited(text.replace("a", '"a"', 1) if "a" in text else quoted + ('"' if quoted != text else "")))
    assert plain == (long if "a" in text else long[: len(plain)])


def test_any_file_in_one_reading(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(writers.xlsx_bytes({"S": [["x", 1], ["y", 2]]}))
    (tmp_path / "b.docx").write_bytes(writers.docx_bytes([{"text": "hello"}]))
    (tmp_path / "c.txt").write_text("plain")
    (tmp_path / "d.rtf").write_bytes(writers.rtf_bytes(["rich"]))
    rows = {r["path"].rpartition("/")[2]: (r["format"], r["text"]) for r in readers.read_any(spark, str(tmp_path)).collect()}
    assert rows == {"a.xlsx": ("xlsx", "x\t1\ny\t2"), "b.docx": ("docx", "hello"), "c.txt": ("text", "plain"), "d.rtf": ("rtf", "rich")}


def test_grid_references(spark):
    sheets = {"Sheet1": [["k", "v"], ["a", 1], ["b", 2], [None, "x"]], "My 'own'": [[10, 20], [30, "=A1"]]}
    cells = readers.read_content(spark.createDataFrame([("w", writers.xlsx_bytes(sheets))], "path string, content binary"), "xlsx")
    f = {
        "a": "=SUM(B1:B4)", "b": "=B2+$B$3*2", "c": "=SUM('My ''own'''!A1:B2)", "d": '=CONCAT("B2:", COUNT(A1:B4))', "e": "=COUNTBLANK(A1:A4)", "f": "=ROWS(A1:B4)*COLUMNS(A1:B4)", "g": "=a+b", "h": "=IFERROR(A2+1, -1)",
        "i": "=MAX(all_v, 1.5)", "j": '=COUNTIF(A1:A4, "a")', "k": "=MEDIAN(B4:B2)", "l": "=C9+1", "m": '=IF(B2=1, "one", "other")',
    }
    (r,) = grid.evaluate(cells, f, {"all_v": "Sheet1!$B$1:$B$4"}).collect()
    want = {"a": 3.0, "b": 5.0, "c": 60.0, "d": "B2:2", "e": 1.0, "f": 8.0, "g": 8.0, "h": -1.0, "i": 2.0, "j": 1.0, "k": 1.5, "l": None, "m": "one"}
    assert {k: r[k] for k in want} == want and r["l_err"] == "#VALUE!" and r["a_err"] is None
    for bad in ("=x", "=SUMPRODUCT(A1:A2,B1:B2)", "=UPPER(A1:A2)"):
        with pytest.raises(fx.FormulaError):
            grid.evaluate(cells, {"v": bad})
    with pytest.raises(fx.FormulaError):
        grid.evaluate(cells, {"p": "=q", "q": "=p+1"})
