"""Word packages and workbooks made with the standard library, one for each row of a table: inputs for queries, tests and benchmarks."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.tables import spread

#: Packages that a task makes and reads: some seconds of work.
DOCUMENTS_A_TASK = 250
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:v="urn:schemas-microsoft-com:vml" xmlns:o="urn:schemas-microsoft-com:office:office" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
SHEET = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
#: The start of a PNG, and what makes each picture another.
PNG = b"\x89PNG\r\n\x1a\n"


def packed(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for name, data in parts.items():
            zf.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _relationships(rows: list[tuple[str, str, str]]) -> str:
    items = "".join(f'<Relationship Id="{i}" Type="{REL}/{kind}" Target="{escape(target)}"/>' for i, kind, target in rows)
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{items}</Relationships>'


def workbook(sheets: list[tuple[str, list[list], list[str]]]) -> bytes:
    """An .xlsx of sheets (name, rows of str, number, bool or None, merged ranges)."""

    def cell(r: int, c: int, v) -> str:
        ref = f"{chr(64 + c)}{r}"
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v!r}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'

    parts: dict[str, str | bytes] = {
        "xl/workbook.xml": f"<workbook {SHEET}><sheets>" + "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, (n, _, _) in enumerate(sheets, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": _relationships([(f"rId{k}", "worksheet", f"worksheets/sheet{k}.xml") for k in range(1, len(sheets) + 1)]),
    }
    for k, (_, rows, merges) in enumerate(sheets, 1):
        body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row, 1)) + "</row>" for r, row in enumerate(rows, 1))
        merged = f"<mergeCells>{''.join(f'<mergeCell ref="{m}"/>' for m in merges)}</mergeCells>" if merges else ""
        parts[f"xl/worksheets/sheet{k}.xml"] = f"<worksheet {SHEET}><sheetData>{body}</sheetData>{merged}</worksheet>"
    return packed(parts)


def run(text: str, bold: bool = False) -> str:
    return f'<w:r>{"<w:rPr><w:b/></w:rPr>" if bold else ""}<w:t xml:space="preserve">{escape(text)}</w:t></w:r>'


def paragraph(inner: str, style: str = "", number: str = "") -> str:
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="0"/><w:numId w:val="{number}"/></w:numPr>' if number else "")
    return f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}{inner}</w:p>"


def mark(name: str) -> str:
    return f'<w:bookmarkStart w:id="1" w:name="{name}"/>'


def document(body: str, rels: list[tuple[str, str, str]], parts: dict[str, str | bytes] | None = None) -> bytes:
    return packed({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": _relationships(rels)} | (parts or {}))


def supplier_document(key: int, name: str, nation: int, balance: float) -> bytes:
    """A document with all that the reader takes: headings, emphasis, a link, a list, a merged table, a workbook, a picture, a note, a text box, a formula."""
    cells = [["key", "balance", "memo"], [key, balance, None], ["total", None, None]]
    table = (
        "<w:tbl><w:tr><w:tc><w:tcPr><w:vMerge w:val=\"restart\"/></w:tcPr>" + paragraph(run(f"n{nation}")) + "</w:tc><w:tc>" + paragraph(run("a|b")) + "</w:tc></w:tr>"
        "<w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr>" + paragraph("") + "</w:tc><w:tc>" + paragraph(run("c")) + paragraph(run("d")) + "</w:tc></w:tr></w:tbl>"
    )
    body = (
        paragraph(mark("heading_1") + run(name), "Heading1")
        + paragraph(mark("heading_2") + run("Balance & more"), "Kind2")
        + paragraph(run("Nation", True) + run(f" {nation} ") + '<w:hyperlink r:id="rId3">' + run("site") + "</w:hyperlink>" + '<w:r><w:footnoteReference w:id="2"/></w:r>')
        + paragraph(run("first"), number="1") + paragraph(run(f"k{key}"), number="1")
        + table
        + paragraph('<w:r><w:object><v:shape><v:imagedata r:id="rId2"/></v:shape><o:OLEObject r:id="rId1"/></w:object></w:r>')
        + paragraph('<w:r><w:pict><v:shape><v:imagedata r:id="rId4"/></v:shape></w:pict></w:r>')
        + paragraph(f"<m:oMathPara><m:oMath><m:r><m:t>x={key}</m:t></m:r></m:oMath></m:oMathPara>")
        + f"<w:p><w:r><w:pict><v:shape><v:textbox><w:txbxContent>{paragraph(run(f'box {key}'))}{paragraph(run('more'))}</w:txbxContent></v:textbox></v:shape></w:pict></w:r></w:p>"
    )
    rels = [("rId1", "package", "embeddings/book.xlsx"), ("rId2", "image", "media/preview.emf"), ("rId3", "hyperlink", f"https://example.com/{key}"), ("rId4", "image", "media/photo.png")]
    parts = {
        "word/numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>',
        "word/footnotes.xml": f'<w:footnotes {W}><w:footnote w:id="2">{paragraph(run(f"Note {key}."))}</w:footnote></w:footnotes>',
        "word/embeddings/book.xlsx": workbook([("few", [["x"]], []), ("most", cells, ["A3:B3"])]),
        "word/media/preview.emf": b"preview" + str(key).encode(),
        "word/media/photo.png": PNG + str(key).encode(),
    }
    return document(body, rels, parts)


def asset_document(key: int) -> bytes:
    """Pictures: one outside the media folder, one that two parts hold, and two parts of one base name."""
    picture = "".join(paragraph(f'<w:r><w:pict><v:shape><v:imagedata r:id="rId{n}"/></v:shape></w:pict></w:r>') for n in (1, 3, 4))
    rels = [("rId1", "image", "other/far.png"), ("rId2", "image", "media/a.png"), ("rId3", "image", "media/b.png"), ("rId4", "image", "media/a.jpeg")]
    same, other = PNG + f"same{key}".encode(), PNG + f"other{key}".encode()
    return document(picture, rels, {"word/other/far.png": PNG + f"far{key}".encode(), "word/media/a.png": same, "word/media/b.png": same, "word/media/a.jpeg": other})


def supplier_files(suppliers: DataFrame, broken: bool = False, assets: bool = False) -> DataFrame:
    """(path, content) of a document for each supplier; with ``broken`` every fifth is no archive, and every seventh of the others one without a document.
    With ``assets`` they hold pictures only."""

    def make(frames):
        for pdf in frames:
            rows = []
            for key, name, nation, balance in zip(pdf["s_suppkey"], pdf["s_name"], pdf["s_nationkey"], pdf["s_acctbal"], strict=True):
                data = asset_document(int(key)) if assets else supplier_document(int(key), name, int(nation), float(balance))
                if broken and key % 5 == 0:
                    data = b"no archive"
                elif broken and key % 7 == 0:
                    data = packed({"word/other.xml": "<x/>"})
                rows.append((f"file:/in/s{key}.docx", data))
            yield pd.DataFrame(rows, columns=["path", "content"])

    return spread(suppliers.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), DOCUMENTS_A_TASK).mapInPandas(make, "path string, content binary")


def key_of(path: str = "path"):
    return F.regexp_extract(path, r"s([0-9]+)\.docx$", 1).cast("long")
