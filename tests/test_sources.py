import io
import zipfile

import pytest

from tabulon.sources import office, readers, text_tables as tt


def packed(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in members.items():
            z.writestr(k, v)
    return out.getvalue()


def xlsx():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    return packed(**{
        "xl/workbook.xml": f'<workbook {ns} xmlns:r="r"><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {ns}><si><t>Name</t></si><si><r><t>A</t></r><r><t>b</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {ns}><numFmts><numFmt numFmtId="164" formatCode="yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="b"><v>1</v></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3" s="1"><v>45351</v></c><c r="C3"><f>A3*2</f><v>2.5</v></c><c r="D3" t="e"><v>#N/A</v></c></row></sheetData></worksheet>',
    })


def docx():
    w = 'xmlns:w="w"'
    return packed(**{"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:rPr><w:b/><w:i w:val="0"/></w:rPr><w:t>Bold</w:t></w:r><w:r><w:t> rest</w:t><w:tab/></w:r></w:p><w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})


def odt(kind="text", body='<o:body><t:h t:outline-level="2">Head</t:h><t:p>a<t:s t:c="2"/>b<t:tab/>c</t:p></o:body>'):
    return packed(mimetype=f"application/vnd.oasis.opendocument.{kind}", **{"content.xml": f'<o:document-content xmlns:o="o" xmlns:t="t">{body}</o:document-content>'})


ODS = odt("spreadsheet", '<o:body><t:table t:name="S"><t:table-row><t:table-cell o:value-type="float" o:value="1.5" t:number-columns-repeated="2"><t:p>1.5</t:p></t:table-cell></t:table-row><t:table-row t:number-rows-repeated="2"><t:table-cell/><t:table-cell o:value-type="string"><t:p>x</t:p></t:table-cell></t:table-row></t:table></o:body>')
PPTX = packed(**{"ppt/presentation.xml": "<p/>", "ppt/slides/slide2.xml": '<s><cSld name="b"><sp><p><r><t>two</t></r></p></sp></cSld></s>', "ppt/slides/slide1.xml": "<s><cSld><sp><p><r><t>on</t></r><r><t>e</t></r></p></sp><pic/></cSld></s>"})
RTF = rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Times;}}{\*\generator x;}Caf\'e9 \u8364?10\par \b bold\b0\tab {\i x}\{y\}}"


def test_delimited_dialect():
    text = '# note\na,"b,""c""",1\r\n"x\\"y\nz",TRUE,2.5\n\n,no,abc"d,e"f\n'
    assert list(tt.parse_delimited(text)) == [["a", 'b,"c"', 1], ['x"y\nz', True, 2.5], [None], [None, False, "abcd,ef"]]
    rows = [["a,b", 1, True], [None, 2.5, 'q"\\']]
    assert list(tt.parse_delimited(tt.write_delimited(rows))) == rows


def test_interchange_round_trips():
    rows = [["Name", 1, True], ['q"; x', 2.5, None]]
    assert list(tt.parse_dif(tt.write_dif(rows))) == rows
    assert list(tt.parse_sylk(tt.write_sylk(rows))) == rows
    plain = [["ab", 12, None], ["c", 3, "d e"]]
    assert list(tt.parse_fixed(tt.write_fixed(plain), [3, 3, 4])) == plain
    assert tt.column_widths(["ab  12 x", "abc 1  y", "a   123z"])[0] == 4


def test_detection():
    assert [office.detect(b) for b in (xlsx(), docx(), PPTX, odt(), ODS, RTF, b"plain", b"", b"PK\x03\x04broken")] == ["xlsx", "docx", "pptx", "odt", "ods", "rtf", None, None, None]
    assert office.detect(bytes.fromhex("D0CF11E0A1B11AE1") + "Workbook".encode("utf-16-le")) == "xls"


def test_office_parsers():
    cells = {(c["row"], c["col"]): (c["tag"], c["value"], c["formula"]) for c in office.xlsx_cells(xlsx())}
    assert cells == {(1, 1): ("string", "Name", None), (1, 3): ("bool", "TRUE", None), (3, 1): ("string", "Ab", None), (3, 2): ("datetime", "45351", None), (3, 3): ("float", "2.5", "A3*2"), (3, 4): ("error", "#N/A", None)}
    p, t = office.docx_elements(docx())
    assert (p["style"], p["text"], p["runs"][0]["bold"], p["runs"][0]["italic"]) == ("Heading1", "Bold rest\t", True, False)
    assert t["cells"] == [{"row": 0, "col": 0, "text": "cell", "grid_span": 2, "v_merge": None}]
    assert [(s["text"], s["shape_count"]) for s in office.pptx_slides(PPTX)] == [("one", 2), ("two", 1)]
    assert [(e["kind"], e["level"], e["text"]) for e in office.odf_paragraphs(odt())] == [("heading", 2, "Head"), ("paragraph", 0, "a  b\tc")]
    assert [(c["row"], c["col"], c["value"]) for c in office.ods_cells(ODS)] == [(1, 1, "1.5"), (1, 2, "1.5"), (2, 2, "x"), (3, 2, "x")]
    assert office.rtf_text(RTF) == "Café €10\nbold\tx{y}"
    with pytest.raises(ValueError):
        list(office.odf_paragraphs(odt(body='<!DOCTYPE a [<!ENTITY b "c">]>')))


def test_readers(spark, tmp_path):
    for name, data in (("a.xlsx", xlsx()), ("b.docx", docx()), ("c.rtf", RTF), ("d.ods", ODS), ("e.pptx", PPTX), ("f.odt", odt())):
        (tmp_path / name[0]).mkdir()
        (tmp_path / name[0] / name).write_bytes(data)
    at = lambda x: str(tmp_path / x)
    assert readers.read_xlsx(spark, at("a")).count() == 6 and readers.read_ods(spark, at("d")).count() == 4
    assert readers.read_docx(spark, at("b")).selectExpr("runs[0].text").first()[0] == "Bold"
    assert readers.read_rtf(spark, at("c")).first()["text"].startswith("Café") and readers.read_pptx(spark, at("e")).count() == 2 and readers.read_odf(spark, at("f")).count() == 2
    assert sorted(r["format"] for r in readers.detect(spark, str(tmp_path)).collect()) == ["docx", "ods", "odt", "pptx", "rtf", "xlsx"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.csv").write_text("a,1\nb,2.5\n")
    assert [(r["row"], r["col"], r["tag"], r["value"]) for r in readers.read_delimited(spark, at("t")).orderBy("row", "col").collect()] == [(1, 1, "string", "a"), (1, 2, "int", "1"), (2, 1, "string", "b"), (2, 2, "float", "2.5")]
    assert readers.read_xlsx(spark, at("t")).first()["row"] is None
