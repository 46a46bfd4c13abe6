"""Workbooks and documents: round trips, written by hand and broken."""

import io
import zipfile

from pyspark.sql import functions as F

from concordat.sources import office

ODD = [["id", "text", ""], ["1", "a\r\nb\tc  ", None], [None, None, "x"], [], ["4", "_x0041_ \x0b <&> \"q\" 🙂", "é"], ["5", "", " "]]


def frame(spark, contents):
    return spark.createDataFrame([(f"f{i}", bytearray(c) if c is not None else None) for i, c in enumerate(contents)], "path string, content binary")


def test_workbooks(spark):
    many = [["n"], *[[str(i)] for i in range(4500)]]
    rows = office.sheet_rows(frame(spark, [office.workbook({"one": ODD, "twö & <2>": many}), office.workbook({"only": [["h"]]})]).repartition(2))
    got = {(r["path"], r["name"], r["row"]): r["cells"] for r in rows.collect()}
    assert len(got) == 6 + 4501 + 1
    for i, want in enumerate(ODD, 1):
        cells = got["f0", "one", i]
        while want and want[-1] is None:
            want = want[:-1]
        assert cells == want
    assert got["f0", "twö & <2>", 4501] == ["4499"]
    assert rows.rdd.getNumPartitions() >= 1
    first = office.table_of(office.sheet_rows(frame(spark, [office.workbook({"one": ODD, "two": many})]), first_only=True))
    assert first.columns == ["id", "text", "column_3", "_path", "_row"] and first.count() == 5


def test_other_writers(spark):
    """Cells of all kinds, missing places, rich text and a sheet named by an absolute path."""
    sheet = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row><c t="inlineStr"><is><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></is></c><c><v>1.5</v></c><c t="b"><v>1</v></c></row>
<row r="7"><c r="C7" t="str"><v>f</v></c><c r="AA7" t="e"><v>#N/A</v></c><c r="AB7" t="s"/></row></sheetData></worksheet>"""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/x.xml", sheet)
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="u"><sheets><sheet name="s" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="/xl/worksheets/x.xml"/></Relationships>')
    rows = {r["row"]: r["cells"] for r in office.sheet_rows(frame(spark, [out.getvalue()])).collect()}
    assert rows[1] == ["rich", "1.5", "TRUE"] and rows[7][2] == "f" and rows[7][26] == "#N/A" and len(rows[7]) == 28 and rows[7][0] is None


def test_broken_files(spark):
    good = office.workbook({"s": [["a"]]})
    cut = io.BytesIO()
    with zipfile.ZipFile(cut, "w") as z:
        z.writestr("xl/workbook.xml", "<workbook><sheets>")
    rows = office.sheet_rows(frame(spark, [b"no archive", good[: len(good) // 2], None, cut.getvalue(), good])).collect()
    assert sorted((r["path"], r["error"] is None) for r in rows) == [("f0", False), ("f1", False), ("f2", False), ("f3", False), ("f4", True)]
    blocks = office.docx_blocks(frame(spark, [b"no archive", good, None])).collect()
    assert len(blocks) == 3 and all(r["error"] and r["text"] is None for r in blocks)
    assert office.sheet_rows(frame(spark, [good]).limit(0)).count() == office.docx_blocks(frame(spark, [good]).limit(0)).count() == 0


def test_documents(spark):
    doc = office.document([("Title", True), (" ", False), (" two\nlines ", False), ("a < b", False)], [[["x", "", "y"], ["", ""]], [["z"]]])
    got = [(r["text"], r["heading"]) for r in office.docx_blocks(frame(spark, [doc])).orderBy("pos").collect()]
    assert got == [("Title", True), ("two\nlines", False), ("a < b", False), ("x | y", False), ("z", False)]


def test_merged_cells(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t, mark="": f"<w:tc><w:tcPr>{mark}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = f'<w:p><w:pPr><w:pStyle w:val="标题 1"/></w:pPr><w:r><w:t>h</w:t><w:tab/><w:t>i</w:t></w:r></w:p><w:tbl><w:tr>{cell("a", "<w:vMerge w:val=" + chr(34) + "restart" + chr(34) + "/>")}{cell("b", "<w:gridSpan w:val=" + chr(34) + "2" + chr(34) + "/>")}</w:tr><w:tr>{cell("", "<w:vMerge/>")}{cell("c")}{cell("d")}</w:tr></w:tbl>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    got = [(r["text"], r["heading"]) for r in office.docx_blocks(frame(spark, [out.getvalue()])).orderBy("pos").collect()]
    assert got == [("h\ti", True), ("a | b | b", False), ("a | c | d", False)]


def test_binary_files(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(office.workbook({"s": [["id", "text"], ["1", "x"]]}))
    t = office.table_of(office.sheet_rows(office.files(spark, f"{tmp_path}/a.xlsx"), first_only=True))
    assert [tuple(r) for r in t.select("id", F.upper("text").alias("t")).collect()] == [("1", "X")]
