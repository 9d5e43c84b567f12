"""Workbooks read with the standard library: cells with their cached values as text, and merged ranges."""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from dataclasses import dataclass, field
from typing import NamedTuple
from xml.etree import ElementTree as ET

from leafmill.functions import markdown as M


class Limits(NamedTuple):
    """Uncompressed bytes of a part, and its ratio to the compressed ones (in parts of over 1 MB), beyond which a package is refused."""

    part: int = 512 << 20
    ratio: float = 500


DATE_FORMATS = {*range(14, 23), 27, 30, 36, 45, 46, 47, 50, 57}


class BadPackage(ValueError):
    pass


def read_part(zf: zipfile.ZipFile, name: str) -> bytes:
    info, limits = zf.getinfo(name), getattr(zf, "limits", Limits())
    if info.file_size > limits.part or info.file_size > 1 << 20 and info.file_size > limits.ratio * max(info.compress_size, 1):
        raise BadPackage(f"part too large: {name}")
    return zf.read(info)


def parse_xml(data: bytes) -> ET.Element:
    """XML without a document type: what packages hold has none, and entities could grow without bound."""
    if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data:
        raise BadPackage("document type in a part")
    return ET.fromstring(data)


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def children(node: ET.Element | None, name: str) -> list[ET.Element]:
    return [] if node is None else [x for x in node if local(x.tag) == name]


def child(node: ET.Element | None, name: str) -> ET.Element | None:
    return next(iter(children(node, name)), None)


def attribute(node: ET.Element | None, name: str, default: str = "") -> str:
    """An attribute by its name without prefix."""
    return default if node is None else next((v for k, v in node.attrib.items() if local(k) == name), default)


@dataclass
class Sheet:
    name: str
    cells: dict[tuple[int, int], str] = field(default_factory=dict)
    merges: list[tuple[int, int, int, int, str]] = field(default_factory=list)


def number_text(x: float) -> str:
    return str(int(x)) if x.is_integer() else repr(x)


def moment_text(serial: float, is_1904: bool) -> str:
    """A date's serial number as text: to the second, a whole day as a date, under a day as a time."""
    if 0 <= serial < 1 and serial:
        return (dt.datetime(2000, 1, 1) + dt.timedelta(seconds=int(serial * 86400 + 1e-4))).strftime("%H:%M:%S")
    day = dt.datetime(1904, 1, 1) if is_1904 else dt.datetime(1899, 12, 30 if serial >= 60 else 31)
    t = day + dt.timedelta(milliseconds=round(serial * 86_400_000))
    return t.strftime("%Y-%m-%d" if not (t.hour or t.minute or t.second or t.microsecond) else "%Y-%m-%d %H:%M:%S")


def _place(ref: str) -> tuple[int, int]:
    letters, row = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    col = 0
    for c in letters:
        col = 26 * col + ord(c) - 64
    return int(row), col


def _text(node: ET.Element) -> str:
    """A string item: its own text or its runs', without phonetic hints."""
    return "".join(t.text or "" for x in node for t in ([x] if local(x.tag) == "t" else children(x, "t") if local(x.tag) == "r" else []))


def _date_styles(zf: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in zf.namelist():
        return set()
    root = parse_xml(read_part(zf, "xl/styles.xml"))
    own = {int(attribute(f, "numFmtId", "0")): attribute(f, "formatCode") for f in children(child(root, "numFmts"), "numFmt")}
    dates = {k for k, code in own.items() if re.search("[dmhysDMHYS]", re.sub(r'\[(?!h|m|s)[^\]]*\]|"[^"]*"|\\.|_.|General', "", code))} | DATE_FORMATS - own.keys()
    return {i for i, xf in enumerate(children(child(root, "cellXfs"), "xf")) if int(attribute(xf, "numFmtId", "0")) in dates}


def read_workbook(data: bytes, limits: Limits = Limits()) -> list[Sheet]:
    """All worksheets, in order. Declared dimensions and formulas are ignored."""
    with zipfile.ZipFile(io.BytesIO(data)) as zf:
        zf.limits = limits
        names = set(zf.namelist())
        book = parse_xml(read_part(zf, "xl/workbook.xml"))
        rels = {attribute(r, "Id"): (attribute(r, "Type"), attribute(r, "Target")) for r in parse_xml(read_part(zf, "xl/_rels/workbook.xml.rels"))}
        shared = [_text(si) for si in parse_xml(read_part(zf, "xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        dates, is_1904 = _date_styles(zf), attribute(child(book, "workbookPr"), "date1904") in ("1", "true")
        out = []
        for s in children(child(book, "sheets"), "sheet"):
            kind, target = rels[attribute(s, "id")]
            if not kind.endswith("/worksheet"):
                continue
            path = posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target))
            sheet, root = Sheet(attribute(s, "name")), parse_xml(read_part(zf, path))
            r = 0
            for row in children(child(root, "sheetData"), "row"):
                r, c = int(attribute(row, "r") or r + 1), 0
                for cell in children(row, "c"):
                    r, c = _place(attribute(cell, "r")) if attribute(cell, "r") else (r, c + 1)
                    if (v := _value(cell, shared, dates, is_1904)) is not None:
                        sheet.cells[r, c] = v
            for m in children(child(root, "mergeCells"), "mergeCell"):
                ref = attribute(m, "ref")
                (r0, c0), (r1, c1) = (_place(x) for x in (*ref.split(":"), ref)[:2])
                sheet.merges.append((r0, r1, c0, c1, ref))
            out.append(sheet)
    return out


def _value(cell: ET.Element, shared: list[str], dates: set[int], is_1904: bool) -> str | None:
    kind, v = attribute(cell, "t", "n"), child(cell, "v")
    if kind == "inlineStr":
        return _text(child(cell, "is")) if child(cell, "is") is not None else None
    raw = None if v is None else v.text
    if raw is None:
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return "True" if raw == "1" else "False"
    if kind in ("str", "e"):
        return raw
    if kind == "d":
        t = dt.datetime.fromisoformat(raw.rstrip("Z"))
        return t.strftime("%Y-%m-%d" if t.time() == dt.time() else "%Y-%m-%d %H:%M:%S")
    if int(attribute(cell, "s", "0")) in dates:
        return moment_text(float(raw), is_1904)
    return number_text(float(raw))


def _grid(sheet: Sheet, values: dict[tuple[int, int], str]) -> list[list[str]]:
    rows = sorted({r for (r, _), v in values.items() if v.strip()})
    cols = sorted({c for (_, c), v in values.items() if v.strip()})
    return [[values.get((r, c), "") for c in cols] for r in rows]


def workbook_markdown(data: bytes, limits: Limits = Limits()) -> str | None:
    """The fullest sheet as a pipe table with its merged ranges expanded; None if the workbook is empty. Raises if it can't be read."""
    best, most, kept = None, 0, {}
    for sheet in read_workbook(data, limits):
        values = {k: M.cell_text(v) for k, v in sheet.cells.items()}
        score = sum(bool(v.strip()) for v in values.values())
        if score > most:
            best, most, kept = sheet, score, values
    if best is None:
        return None
    last = max(r for r, _ in best.cells)
    for r0, r1, c0, c1, _ in sorted(best.merges):
        if anchor := kept.get((r0, c0)):
            kept |= {(r, c): anchor for r in range(r0, min(r1, last) + 1) for c in range(c0, c1 + 1)}
    grid = _grid(best, kept)
    note = ", ".join(m[4] for m in sorted(best.merges, key=lambda m: (m[0], m[2])))
    return (f"> merge_ranges: {note}\n\n" if note else "") + M.pipe_table(grid) + ("\n" if len(grid) == 1 else "")
