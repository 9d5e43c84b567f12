"""Word packages read with the standard library; document.xml is parsed once for everything that is taken from it."""

from __future__ import annotations

import hashlib
import io
import os
import re
import unicodedata
import zipfile
from dataclasses import dataclass, field
from html import escape
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import html as H
from leafmill.functions.scalars import MIME, QUOTES
from leafmill.sources import xlsx as X
from leafmill.sources.batches import made
from leafmill.sources.xlsx import attribute, child, children, local, parse_xml, read_part

MAIN = "word/document.xml"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """*.docx and *.DOCX of a folder, not of folders in it, as (path, modificationTime, length, content), each once. No content is shuffled."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{docx,DOCX}").load(path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length) of the same files, sorted by path; their contents aren't read."""
    return scan(spark, path).select("path", "modificationTime", "length").orderBy("path")


@dataclass
class Package:
    """What one package holds, in the order of the document."""

    rels: dict[str, tuple[str, str]] = field(default_factory=dict)  # id: type, target
    objects: list[tuple[str | None, str | None]] = field(default_factory=list)
    bookmarks: list[tuple[int, str, str, str]] = field(default_factory=list)  # paragraph, bookmark, style, text
    boxes: list[str] = field(default_factory=list)
    formulas: list[str] = field(default_factory=list)
    html: str = ""
    pictures: list[tuple[str, bytes, str]] = field(default_factory=list)  # key in the HTML, bytes, MIME type
    names: list[str] = field(default_factory=list)


def open_package(content: bytes, limits: X.Limits = X.Limits()) -> zipfile.ZipFile:
    try:
        zf = zipfile.ZipFile(io.BytesIO(content))
        zf.limits = limits
    except zipfile.BadZipFile as e:
        raise X.BadPackage("not a ZIP file") from e
    if MAIN not in zf.namelist():
        raise X.BadPackage("no word/document.xml")
    return zf


def part_path(target: str) -> str:
    import posixpath

    t = (target or "").replace("\\", "/").strip()
    if not t:
        return ""
    t = t.removeprefix("/")
    return posixpath.normpath(t if t.startswith("word/") else posixpath.join("word", t))


def read_relationships(zf: zipfile.ZipFile) -> dict[str, tuple[str, str]]:
    """By id; none if the part is missing or broken."""
    try:
        root = parse_xml(read_part(zf, "word/_rels/document.xml.rels"))
        return {attribute(r, "Id"): (attribute(r, "Type").rpartition("/")[2], attribute(r, "Target")) for r in root.iter() if local(r.tag) == "Relationship"}
    except (KeyError, ET.ParseError, X.BadPackage):
        return {}


def texts(node: ET.Element, tag: str = "t") -> str:
    return "".join(x.text or "" for x in node.iter() if local(x.tag) == tag)


def read_objects(root: ET.Element) -> list[tuple[str | None, str | None]]:
    out = []
    for o in (x for x in root.iter() if local(x.tag) == "object"):
        found = {local(x.tag): attribute(x, "id") or None for x in o.iter() if local(x.tag) in ("OLEObject", "imagedata")}
        out.append((found.get("OLEObject"), found.get("imagedata")))
    return out


def read_bookmarks(root: ET.Element) -> list[tuple[int, str, str, str]]:
    """Paragraphs whose first bookmark is a heading's."""
    out = []
    for n, p in enumerate(x for x in root.iter() if local(x.tag) == "p" and "wordprocessingml" in x.tag):
        mark = next((x for x in p.iter() if local(x.tag) == "bookmarkStart"), None)
        if (name := attribute(mark, "name")).startswith("heading_"):
            out.append((n, name, attribute(child(child(p, "pPr"), "pStyle"), "val"), texts(p)))
    return out


def read_boxes(root: ET.Element) -> list[str]:
    found = [x for x in root.iter() if local(x.tag) == "txbxContent"]
    found.sort(key=lambda x: "wordprocessingShape" in x.tag)
    rows = (("\n".join(t for p in b.iter() if local(p.tag) == "p" and (t := texts(p).strip()))) for b in found)
    return [x for x in rows if x]


def read_formulas(root: ET.Element) -> list[str]:
    """Display formulas first, then those in a line; ones inside another aren't repeated."""
    out, inside = [], set()
    for kind in ("oMathPara", "oMath"):
        for node in [x for x in root.iter() if local(x.tag) == kind]:
            if id(node) in inside:
                continue
            inside |= {id(x) for x in node.iter() if local(x.tag) == "oMath"}
            if text := texts(node).strip():
                out.append(text)
    return out


def heading_level(style: str, text: str) -> int | None:
    if (m := re.search(r"(\d+)\Z", style.strip())) and int(m[1]) > 0:
        return min(int(m[1]), 6)
    m = re.match(r"\s*(\d+(?:\.\d+)*)\s*\.?\s+", text)
    return min(m[1].count(".") + 1, 6) if m else None


class Body:
    """The document's body as HTML: headings, emphasis, links, lists, tables with spans, notes, pictures."""

    def __init__(self, zf: zipfile.ZipFile, root: ET.Element, rels: dict[str, tuple[str, str]]) -> None:
        self.zf, self.rels, self.names = zf, rels, set(zf.namelist())
        self.pictures: list[tuple[str, bytes, str]] = []
        self.notes: list[str] = []
        self.numbering = self._numbering()
        self.html = self.blocks(child(root, "body") if child(root, "body") is not None else root) + self._notes()

    def _part(self, name: str) -> ET.Element | None:
        return parse_xml(read_part(self.zf, name)) if name in self.names else None

    def _numbering(self) -> dict[tuple[str, str], bool]:
        """Whether a list level is ordered."""
        root = self._part("word/numbering.xml")
        if root is None:
            return {}
        kinds = {attribute(a, "abstractNumId"): {attribute(v, "ilvl"): attribute(child(v, "numFmt"), "val") != "bullet" for v in children(a, "lvl")} for a in children(root, "abstractNum")}
        return {(attribute(n, "numId"), level): kind for n in children(root, "num") for level, kind in kinds.get(attribute(child(n, "abstractNumId"), "val"), {}).items()}

    def _notes(self) -> str:
        root = self._part("word/footnotes.xml") if self.notes else None
        if root is None:
            return ""
        bodies = {attribute(f, "id"): f for f in children(root, "footnote")}
        rows = (f'<li id="footnote-{n}">{self.blocks(bodies[n]).removesuffix("</p>")} <a href="#footnote-ref-{n}">↑</a></p></li>' for n in self.notes if n in bodies)
        return f"<ol>{''.join(rows)}</ol>"

    def blocks(self, node: ET.Element) -> str:
        out, open_lists = [], []  # (level, tag)

        def close(to: int) -> None:
            while open_lists and open_lists[-1][0] >= to:
                out.append(f"</li></{open_lists.pop()[1]}>")

        for x in node:
            kind = local(x.tag)
            if kind == "sdt":
                close(0)
                out.append(self.blocks(child(x, "sdtContent") if child(x, "sdtContent") is not None else x))
            elif kind == "tbl":
                close(0)
                out.append(self.table(x))
            elif kind == "p":
                num = child(child(x, "pPr"), "numPr")
                key = attribute(child(num, "numId"), "val"), attribute(child(num, "ilvl"), "val", "0")
                inner = self.inline(x)
                style = attribute(child(child(x, "pPr"), "pStyle"), "val")
                heading = re.fullmatch(r"(?i)heading ?([1-6])", style)
                if num is None or key[0] in ("", "0") or heading:
                    close(0)
                    tag = f"h{heading[1]}" if heading else "p"
                    out.append(f"<{tag}>{inner}</{tag}>" if inner else "")
                    continue
                level, tag = int(key[1]), "ol" if self.numbering.get(key, False) else "ul"
                close(level + 1)
                if open_lists and open_lists[-1] == (level, tag):
                    out.append("</li><li>")
                else:
                    close(level)
                    open_lists.append((level, tag))
                    out.append(f"<{tag}><li>")
                out.append(inner)
        close(0)
        return "".join(out)

    def table(self, node: ET.Element) -> str:
        """Cells that continue one above widen its rowspan."""
        grid: list[list[list]] = []  # rows of [column, colspan, rowspan, html]
        above: dict[int, list] = {}
        for tr in children(node, "tr"):
            row, col = [], 0
            for tc in children(tr, "tc"):
                pr = child(tc, "tcPr")
                wide = int(attribute(child(pr, "gridSpan"), "val", "1") or 1)
                merge = child(pr, "vMerge")
                if merge is not None and attribute(merge, "val", "continue") != "restart" and col in above:
                    above[col][2] += 1
                else:
                    cell = [col, wide, 1, self.blocks(tc)]
                    row.append(cell)
                    above.pop(col, None)
                    if merge is not None:
                        above[col] = cell
                col += wide
            grid.append(row)
        rows = ("".join(f"<td{f' colspan={chr(34)}{w}{chr(34)}' if w > 1 else ''}{f' rowspan={chr(34)}{h}{chr(34)}' if h > 1 else ''}>{x}</td>" for _, w, h, x in row) for row in grid)
        return "<table>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>"

    def inline(self, node: ET.Element) -> str:
        out = []
        for x in node:
            kind = local(x.tag)
            if kind == "r":
                out.append(self.run(x))
            elif kind == "hyperlink":
                target = self.rels.get(attribute(x, "id"), ("", ""))[1] or (f"#{attribute(x, 'anchor')}" if attribute(x, "anchor") else "")
                inner = self.inline(x)
                out.append(f'<a href="{escape(target)}">{inner}</a>' if target else inner)
            elif kind == "bookmarkStart" and attribute(x, "name") != "_GoBack":
                out.append(f'<a id="{escape(attribute(x, "name"))}"></a>')
            elif kind in ("ins", "smartTag", "sdt", "sdtContent", "fldSimple"):
                out.append(self.inline(x))
        return "".join(out)

    def run(self, node: ET.Element) -> str:
        out = []
        for x in node:
            kind = local(x.tag)
            if kind == "t":
                out.append(escape(x.text or "", quote=False))
            elif kind == "tab":
                out.append("\t")
            elif kind == "br" and attribute(x, "type", "textWrapping") == "textWrapping":
                out.append("<br />")
            elif kind == "noBreakHyphen":
                out.append("‑")
            elif kind == "footnoteReference":
                n = attribute(x, "id")
                self.notes.append(n)
                out.append(f'<sup><a href="#footnote-{n}" id="footnote-ref-{n}">[{len(self.notes)}]</a></sup>')
            elif kind in ("drawing", "pict", "object", "AlternateContent"):
                out += self.drawing(x)
        text, pr = "".join(out), child(node, "rPr")
        for name, tag in (("i", "em"), ("b", "strong")):
            mark = child(pr, name)
            if text and mark is not None and attribute(mark, "val", "true") not in ("0", "false"):
                text = f"<{tag}>{text}</{tag}>"
        return text

    def drawing(self, node: ET.Element) -> list[str]:
        seen, out = set(), []
        for x in node.iter():
            rid = attribute(x, "embed") if local(x.tag) == "blip" else attribute(x, "id") if local(x.tag) == "imagedata" else ""
            path = part_path(self.rels.get(rid, ("", ""))[1])
            if path in self.names and rid not in seen:
                seen.add(rid)
                key = f"__PICTURE_{len(self.pictures)}__"
                self.pictures.append((key, read_part(self.zf, path), f"image/{path.rpartition('.')[2].lower()}"))
                out.append(f'<img src="{key}" />')
        return out


def read_package(content: bytes, limits: X.Limits = X.Limits()) -> Package:
    """Raises BadPackage, or the XML parser's error, if the package has no readable document."""
    with open_package(content, limits) as zf:
        rels, root = read_relationships(zf), parse_xml(read_part(zf, MAIN))
        body = Body(zf, root, rels)
        return Package(rels, read_objects(root), read_bookmarks(root), read_boxes(root), read_formulas(root), body.html, body.pictures, zf.namelist())


PARTS = [("path", "string"), ("part_no", "int"), ("part_path", "string"), ("content", "binary"), ("error", "string")]
RELATIONS = [("path", "string"), ("kind", "string"), ("n", "int"), ("a", "string"), ("b", "string"), ("c", "string"), ("error", "string")]
CELLS = [("path", "string"), ("part_path", "string"), ("sheet_no", "int"), ("r", "int"), ("c", "int"), ("v", "string"), ("r1", "int"), ("c1", "int"), ("ref", "string")]


def parts(files: DataFrame, prefixes: tuple[str, ...] = ("word/media/", "word/embeddings/")) -> DataFrame:
    """A row for each wanted part of each package, in the order of the archive; one with ``error`` for a package that can't be read."""

    def read(path: str, content: bytes) -> list[tuple]:
        try:
            with open_package(content) as zf:
                return [(path, n, name, read_part(zf, name), None) for n, name in enumerate(zf.namelist()) if name.startswith(prefixes)]
        except Exception as e:  # one bad file is a row, not a failed job
            return [(path, None, None, None, f"{type(e).__name__}: {e}")]

    return made(files, ["path", "content"], read, PARTS)


def relations(files: DataFrame) -> DataFrame:
    """All small relations of each package from one parse: kind is rel, object, bookmark, picture, box, formula, html or error."""

    def read(path: str, content: bytes) -> list[tuple]:
        try:
            p = read_package(content)
            rows = [("rel", n, i, *x) for n, (i, x) in enumerate(p.rels.items())] + [("object", n, None, *x) for n, x in enumerate(p.objects)]
            rows += [("bookmark", n, name, style, text) for n, name, style, text in p.bookmarks]
            rows += [("picture", n, key, hashlib.sha256(data).hexdigest(), picture_extension(data, mime)) for n, (key, data, mime) in enumerate(p.pictures)]
            rows += [(k, n, x, None, None) for k, found in (("box", p.boxes), ("formula", p.formulas), ("html", [p.html])) for n, x in enumerate(found)]
            return [(path, *r, None) for r in rows]
        except Exception as e:
            return [(path, "error", 0, None, None, None, f"{type(e).__name__}: {e}")]

    return made(files, ["path", "content"], read, RELATIONS)


def xlsx_cells(books: DataFrame) -> DataFrame:
    """(path, part_path, sheet_no, r, c, v) of workbooks' filled cells; a merged range is a row with its reference in ``ref`` and its last cell in r1, c1."""

    def read(path: str, part: str, content: bytes) -> list[tuple]:
        rows = []
        try:
            for n, s in enumerate(X.read_workbook(content)):
                rows += [(path, part, n, r, c, v, None, None, None) for (r, c), v in sorted(s.cells.items())]
                rows += [(path, part, n, r0, c0, None, r1, c1, ref) for r0, r1, c0, c1, ref in s.merges]
        except Exception:
            pass
        return rows

    return made(books, ["path", "part_path", "content"], read, CELLS)


# --- a whole document


def stem_of(path: str) -> str:
    """The output's name for an input's path."""
    from urllib.parse import unquote, urlsplit

    name = os.path.basename(unquote(urlsplit(path).path) if "://" in path or path.startswith("file:") else path)
    raw = os.path.splitext(name)[0]
    out = unicodedata.normalize("NFKC", raw).translate({ord(c): None for c in QUOTES}).translate({ord(c): "_" for c in '\\/:*?"<>|'})
    out = " ".join(out.split()).strip(". ").strip()
    if len(out) > 120:
        out = f"{out[:111]}_{hashlib.sha256(raw.encode()).hexdigest()[:8]}"
    return out or "document"


SIGNATURES = ((0, b"\x89PNG\r\n\x1a\n", ".png"), (0, b"\xff\xd8", ".jpeg"), (0, b"GIF87a", ".gif"), (0, b"GIF89a", ".gif"), (8, b"WEBP", ".webp"), (0, b"BM", ".bmp"), (0, b"II*\0", ".tiff"), (0, b"MM\0*", ".tiff"), (0, b"\xd7\xcd\xc6\x9a", ".wmf"), (40, b" EMF", ".emf"))


def sniff(data: bytes) -> str | None:
    return next((ext for at, sign, ext in SIGNATURES if data[at : at + len(sign)] == sign and (ext != ".webp" or data[:4] == b"RIFF")), None)


def picture_extension(data: bytes, mime: str) -> str:
    return sniff(data) or MIME.get(mime.rpartition("/")[2], ".bin")


def pair_up(rels: dict[str, tuple[str, str]], objects) -> list[tuple[str, str]]:
    """(workbook, preview): those that objects name, then neighbours by relationship number."""
    out = []
    for ole, img in objects:
        if ole in rels and img in rels and (book := part_path(rels[ole][1])).lower().endswith(".xlsx"):
            out.append((book, part_path(rels[img][1])))
    taken = {b for b, _ in out}
    order = sorted(rels, key=lambda r: int(m[1]) if (m := re.fullmatch(r"rId(\d+)", r or "")) else 10**9)
    for here, after in zip(order, order[1:]):  # noqa: B905
        (kind, target), (next_kind, next_target) = rels[here], rels[after]
        if kind == "package" and target.lower().endswith(".xlsx") and next_kind == "image" and (book := part_path(target)) not in taken:
            taken.add(book)
            out.append((book, part_path(next_target)))
    return out


def workbook_tables(held: dict[str, bytes], limits: X.Limits) -> tuple[dict[str, str], list[tuple[str, str]]]:
    """Each workbook's table; (part, error) of those that can't be read, whose preview picture stays in place."""
    tables, rejects = {}, []
    for name, data in held.items():
        if name.startswith("word/embeddings/"):
            try:
                if table := X.workbook_markdown(data, limits):
                    tables[name] = table
            except Exception as e:
                rejects.append((name, f"{type(e).__name__}: {e}"))
    return tables, rejects


def convert(path: str, content: bytes, compat: bool = True, limits: X.Limits = X.Limits()) -> tuple[str, str, list[tuple[str, bytes]], list[tuple[str, str]]]:
    """(stem, markdown, assets, parts that couldn't be read) of one package."""
    package = read_package(content, limits)
    with open_package(content, limits) as zf:
        held = {n: read_part(zf, n) for n in zf.namelist() if n.startswith("word/media/") or n.startswith("word/embeddings/") and n.lower().endswith(".xlsx")}
        tables, rejects = workbook_tables(held, limits)
        queue: dict[str, list[str]] = {}
        previews = set()
        for book, preview in pair_up(package.rels, package.objects):
            if book in tables and preview in package.names:
                queue.setdefault(hashlib.sha256(held.get(preview) or read_part(zf, preview)).hexdigest(), []).append(tables[book])
                previews.add(preview)
    assets: dict[str, bytes] = {}
    asset_of: dict[str, str] = {}
    for name, data in held.items():
        if name.startswith("word/media/") and name not in previews and not name.endswith("/"):
            base, ext = os.path.splitext(os.path.basename(name))
            digest, ext = hashlib.sha256(data).hexdigest(), sniff(data) or ext.lower() or ".png"
            file = base + ext if assets.get(base + ext, data) == data else f"{base}_{digest[:8]}{ext}"
            assets.setdefault(file, data)
            asset_of.setdefault(digest, f"assets/{file}")
    html, spliced, used = package.html, {}, {}
    for key, data, mime in package.pictures:
        digest = hashlib.sha256(data).hexdigest()
        if waiting := queue.get(digest):
            k = used[digest] = used.get(digest, -1) + 1
            spliced[f"![]({key})"] = waiting[min(k, len(waiting) - 1)]
            continue
        if digest not in asset_of:
            file = f"image_{digest[:16]}{picture_extension(data, mime)}"
            assets.setdefault(file, data)
            asset_of[digest] = f"assets/{file}"
        html = html.replace(f'"{key}"', f'"{asset_of[digest]}"')
    levels = {name: level for _, name, style, text in package.bookmarks if (level := heading_level(style, text))}
    md = H.body_markdown(html, levels, compat)
    for mark, table in spliced.items():
        md = md.replace(mark, f"\n\n{table}\n\n")
    md = re.sub(r"\n+\*{0,2}点击图片可查看完整电子表格\*{0,2}\s*\n", "\n", md)
    for items, head, row, missing in (
        (package.boxes, "文本框内容", "> {}\n>\n", lambda b, md: b.splitlines()[0] not in md),
        (package.formulas, "数学公式", "> $$ {} $$\n>\n", lambda f, md: f not in md),
    ):
        if rest := [x for x in items if missing(x, md)]:
            md += f"\n\n---\n\n> **\\[{head}\\]**\n\n" + "".join(row.format(x) for x in rest)
    return stem_of(path), md, list(assets.items()), rejects


RESULT = [
    ("path", "string"), ("stem", "string"), ("markdown", "string"), ("assets", "array<struct<name: string, content: binary>>"), ("error", "string"),
    ("rejects", "array<struct<part: string, error: string>>"),
]


def converted(files: DataFrame, compat: bool = True, limits: X.Limits = X.Limits()) -> DataFrame:
    """A row for each file: stem, markdown and assets, or the error that it met; ``rejects`` are workbooks in it that couldn't be read.
    A file needs no other file, so nothing is shuffled."""

    def run(path: str, content: bytes) -> list[tuple]:
        try:
            stem, md, assets, rejects = convert(path, content, compat, limits)
            return [(path, stem, md, [{"name": n, "content": d} for n, d in assets], None, [{"part": p, "error": e} for p, e in rejects])]
        except Exception as e:
            return [(path, stem_of(path), None, [], f"{type(e).__name__}: {e}", [])]

    return made(files, ["path", "content"], run, RESULT)
