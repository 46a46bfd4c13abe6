"""Workbooks (XLSX) and documents (DOCX): zipped XML, read from ``files(path, content)``, as Spark's binary file reader gives
them, or from a binary column.

A file is opened by the task that has its row, its XML is read as a stream of elements, and rows leave in batches. A sheet
is a unit of work of its own: workbooks are dealt out by sheet, since a part of a sheet can't be reached without reading
what stands before. A file that isn't a readable archive gives one row with the reason in ``error`` and nothing else.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 2_000  # in a batch
CELLS = "path string, sheet int, name string, row bigint, cells array<string>, error string"
BLOCKS = "path string, pos int, text string, heading boolean, error string"
_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")
_UNSAFE = re.compile(r"[\x00-\x08\x0b-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attribute(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if _local(k) == name), None)


def _elements(z: zipfile.ZipFile, name: str, wanted: str) -> Iterator[ElementTree.Element]:
    """The elements of that name, one at a time, each emptied after its use."""
    with z.open(name) as f:
        parents: list[ElementTree.Element] = []
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                parents.append(e)
                continue
            parents.pop()
            if _local(e.tag) == wanted:
                yield e
                e.clear()
                if parents:
                    parents[-1].remove(e)


def _said(e: ElementTree.Element) -> str:
    """The text of a string or cell: its ``t`` elements, but for phonetic hints."""
    out = []
    for c in e:
        if _local(c.tag) == "t":
            out.append(c.text or "")
        elif _local(c.tag) == "r":
            out += [t.text or "" for t in c if _local(t.tag) == "t"]
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), "".join(out))


def _column(ref: str | None, after: int) -> int:
    letters = re.match(r"[A-Z]+", ref or "")
    if not letters:
        return after
    n = 0
    for c in letters[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of each sheet, in the workbook's order."""
    to = {_attribute(e, "Id"): _attribute(e, "Target") for e in _elements(z, "xl/_rels/workbook.xml.rels", "Relationship")}
    found = [(_attribute(e, "name") or "", to.get(_attribute(e, "id")) or "") for e in _elements(z, "xl/workbook.xml", "sheet")]
    return [(name, part.lstrip("/") if part.startswith("/") else f"xl/{part}") for name, part in found]


def cells_of(content: bytes, sheet: int) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet's name, row's number, cells) of a sheet's rows; a cell without a value is null, cells to the right may be missing.

    Numbers and dates come as they are stored, truth values as TRUE or FALSE, errors as their names.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        name, part = sheets(z)[sheet]
        shared = [_said(e) for e in _elements(z, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in z.namelist() else []
        number = 0
        for row in _elements(z, part, "row"):
            number = int(_attribute(row, "r") or number + 1)
            out: list[str | None] = []
            for c in row:
                kind, at = _attribute(c, "t"), _column(_attribute(c, "r"), len(out))
                parts = {_local(x.tag): x for x in c}
                value = (parts["v"].text if "v" in parts else None) if kind != "inlineStr" else _said(parts["is"]) if "is" in parts else None
                if kind == "s" and value is not None:
                    value = shared[int(value)]
                elif kind == "b" and value is not None:
                    value = "TRUE" if value == "1" else "FALSE"
                elif kind == "str" and value is not None:
                    value = _ESCAPED.sub(lambda m: chr(int(m[1], 16)), value)
                out += [None] * (at + 1 - len(out))
                out[at] = value
            yield name, number, out


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], f.type) for k, f in enumerate(schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], f.type) for k, f in enumerate(schema)], schema=schema)


def _opened(f: Callable[[], Iterator[tuple]], failed: Callable[[str], tuple]) -> Iterator[tuple]:
    """Rows of a file, or one row with the reason why there are no more."""
    try:
        yield from f()
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError, EOFError, NotImplementedError, RuntimeError) as e:
        yield failed(f"{type(e).__name__}: {e}")


def sheet_rows(found: DataFrame, first_only: bool = False) -> DataFrame:
    """(path, sheet, name, row, cells, error) of all sheets of the workbooks, or of each one's first."""
    schema = pa.schema([("path", pa.string()), ("sheet", pa.int32()), ("name", pa.string()), ("row", pa.int64()), ("cells", pa.list_(pa.string())), ("error", pa.string())])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py() or b"")) as z:
                        n = min(1, len(sheets(z))) if first_only else len(sheets(z))
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, NotImplementedError, RuntimeError):
                    n = 1  # reading it says why
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * n), pa.array(range(n), pa.int32()), pa.array([content.as_py() or b""] * n, pa.binary())], ["path", "sheet", "content"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, sheet, content in zip(*(b.column(c) for c in ("path", "sheet", "content")), strict=True):
                p, k, data = path.as_py(), sheet.as_py(), content.as_py()
                rows = _opened(lambda: ((p, k, name, row, cells, None) for name, row, cells in cells_of(data, k)), lambda e: (p, k, None, None, None, e))
                yield from _batched(rows, schema)

    each = found.select("path", "content").mapInArrow(listed, "path string, sheet int, content binary")
    return each.repartition("path", "sheet").mapInArrow(read, CELLS)


def table_of(rows: DataFrame) -> DataFrame:
    """The first sheet of workbooks of one layout as a table of strings: its first row, of the first path, names the columns.
    Two more columns: ``_path`` and ``_row``."""
    head = rows.where("sheet = 0 AND cells IS NOT NULL").orderBy("path", "row").select("cells").first()
    names = [(c or "").strip() or f"column_{i + 1}" for i, c in enumerate(head["cells"])] if head else []
    first = rows.where("sheet = 0 AND cells IS NOT NULL").groupBy("path").agg(F.min("row").alias("first"))
    body = rows.where("sheet = 0 AND cells IS NOT NULL").join(first, "path").where("row > first")
    return body.select(*[F.try_element_at("cells", F.lit(i + 1)).alias(c) for i, c in enumerate(names)], F.col("path").alias("_path"), F.col("row").alias("_row"))


def _safe(text: str) -> str:
    return escape(_UNSAFE.sub(lambda m: f"_x{ord(m[0]):04X}_", text))


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + text)
    return out.getvalue()


# Names of the formats' parts and relations.
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _package(main: str, kind: str, others: dict[str, str], relations: list[tuple[str, str]]) -> dict[str, str]:
    kinds = "".join(f'<Override PartName="/{n}" ContentType="application/vnd.openxmlformats-officedocument.{k}+xml"/>' for n, k in {main: kind, **others}.items())
    folder, name = main.split("/")
    return {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{kinds}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="{main}"/></Relationships>',
        f"{folder}/_rels/{name}.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{_OFFICE}/{k}" Target="{t}"/>' for i, (k, t) in enumerate(relations, 1)) + "</Relationships>",
    }


def workbook(tables: dict[str, list[list[str | None]]]) -> bytes:
    """A workbook with a sheet of rows for each name; cells are strings in the shared table, null ones are left out."""
    shared: dict[str, int] = {}
    parts, n = {}, len(tables)
    for k, rows in enumerate(tables.values(), 1):
        lines = ["".join(f'<c r="{_letters(j)}{i}" t="s"><v>{shared.setdefault(c, len(shared))}</v></c>' for j, c in enumerate(row) if c is not None) for i, row in enumerate(rows, 1)]
        parts[f"xl/worksheets/sheet{k}.xml"] = f'<worksheet xmlns="{_SHEET}"><sheetData>' + "".join(f'<row r="{i}">{x}</row>' for i, x in enumerate(lines, 1)) + "</sheetData></worksheet>"
    names = "".join(f'<sheet name={quoteattr(name)} sheetId="{k}" r:id="r{k}"/>' for k, name in enumerate(tables, 1))
    parts["xl/workbook.xml"] = f'<workbook xmlns="{_SHEET}" xmlns:r="{_OFFICE}"><sheets>{names}</sheets></workbook>'
    parts["xl/sharedStrings.xml"] = f'<sst xmlns="{_SHEET}">' + "".join(f'<si><t xml:space="preserve">{_safe(s)}</t></si>' for s in shared) + "</sst>"
    kinds = {f"xl/worksheets/sheet{k}.xml": "spreadsheetml.worksheet" for k in range(1, n + 1)} | {"xl/sharedStrings.xml": "spreadsheetml.sharedStrings"}
    relations = [("worksheet", f"worksheets/sheet{k}.xml") for k in range(1, n + 1)] + [("sharedStrings", "sharedStrings.xml")]
    return _zipped(_package("xl/workbook.xml", "spreadsheetml.sheet.main", kinds, relations) | parts)


def _letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _run_text(e: ElementTree.Element) -> str:
    """The text of a paragraph: its texts, tabs and breaks in order."""
    out = []
    for x in e.iter():
        tag = _local(x.tag)
        out.append((x.text or "") if tag == "t" else "\t" if tag == "tab" and not x.attrib else "\n" if tag in ("br", "cr") else "")
    return "".join(out)


def docx_blocks_of(content: bytes) -> Iterator[tuple[str, bool]]:
    """(text, is it a heading): the body's paragraphs, then the rows of its tables as the filled cells joined by `` | ``.

    A heading has a style whose name begins as in ``HEADINGS``. A cell over several columns counts for each, one that goes on
    over rows has the text of the row where it began.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in _elements(z, "word/styles.xml", "style"):
                name = next((_attribute(x, "val") for x in s if _local(x.tag) == "name"), None)
                styles[_attribute(s, "styleId")] = name or ""
        rows: list[str] = []
        with z.open("word/document.xml") as f:
            depth, body = 0, None
            for event, e in ElementTree.iterparse(f, ("start", "end")):
                if event == "start":
                    depth += 1
                    if body is None and _local(e.tag) == "body":
                        body = depth
                    continue
                depth -= 1
                if body is None or depth != body:
                    continue
                if _local(e.tag) == "p":
                    text = _run_text(e).strip()
                    style = next((_attribute(x, "val") for x in e.iter() if _local(x.tag) == "pStyle"), None)
                    name = styles.get(style, style or "")
                    if text:
                        yield text, name.lower().startswith(HEADINGS[0]) or name.startswith(HEADINGS[1])
                elif _local(e.tag) == "tbl":
                    rows += _table_rows(e)
                e.clear()
        yield from ((r, False) for r in rows)


#: How names of heading styles begin (fixed values).
HEADINGS = ("heading", "标题")


def _table_rows(table: ElementTree.Element) -> Iterator[str]:
    above: dict[int, str] = {}
    for row in (x for x in table if _local(x.tag) == "tr"):
        cells, at = [], 0
        for cell in (x for x in row if _local(x.tag) == "tc"):
            marks = {_local(x.tag): x for p in cell if _local(p.tag) == "tcPr" for x in p}
            span = int(_attribute(marks["gridSpan"], "val") or 1) if "gridSpan" in marks else 1
            text = "\n".join(_run_text(p) for p in cell if _local(p.tag) == "p").strip()
            if "vMerge" in marks and _attribute(marks["vMerge"], "val") != "restart":
                text = above.get(at, "")
            for _ in range(span):
                above[at] = text
                cells.append(text)
                at += 1
        if filled := [c for c in cells if c]:
            yield " | ".join(filled)


def docx_blocks(found: DataFrame) -> DataFrame:
    """(path, pos, text, heading, error) of the documents."""
    schema = pa.schema([("path", pa.string()), ("pos", pa.int32()), ("text", pa.string()), ("heading", pa.bool_()), ("error", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                p, data = path.as_py(), content.as_py() or b""
                rows = _opened(lambda: ((p, i, t, h, None) for i, (t, h) in enumerate(docx_blocks_of(data))), lambda e: (p, None, None, None, e))
                yield from _batched(rows, schema)

    return found.select("path", "content").mapInArrow(read, BLOCKS)


def document(paragraphs: list[tuple[str, bool]], tables: list[list[list[str]]]) -> bytes:
    """A DOCX of paragraphs (text, is it a heading) and tables."""
    run = lambda t: '<w:r>' + "<w:br/>".join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in t.split("\n")) + "</w:r>"
    text = "".join(f'<w:p>{"<w:pPr><w:pStyle w:val=" + chr(34) + "H1" + chr(34) + "/></w:pPr>" if h else ""}{run(t)}</w:p>' for t, h in paragraphs)
    for t in tables:
        text += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p>{run(c)}</w:p></w:tc>" for c in row) + "</w:tr>" for row in t) + "</w:tbl>"
    parts = {
        "word/document.xml": f'<w:document xmlns:w="{_WORD}"><w:body>{text}</w:body></w:document>',
        "word/styles.xml": f'<w:styles xmlns:w="{_WORD}"><w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>',
    }
    return _zipped(_package("word/document.xml", "wordprocessingml.document.main", {"word/styles.xml": "wordprocessingml.styles"}, [("styles", "styles.xml")]) | parts)
