"""Page blocks as PDF pages (A4), with the standard library: one of the fonts that every viewer has, lines broken to fit, no embedded data.

Texts within Windows-1252 are set in Helvetica; others in STSong-Light, a font of viewers for Chinese text, by UCS-2 (characters beyond it become a question mark).
A document is one row and needs no other.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.blocks import STYLES, blocks

CM = 72 / 2.54
WIDTH, HEIGHT, MARGIN = 595.28, 841.89, 2 * CM
# Size and leading, space before and after, indentation (points), colour, and whether lines are centred.
FORMS = {
    "title": (18, 24, 0, 20, 0, "1a5490", True),
    "heading1": (14, 20, 20, 12, 0, "1a5490", False),
    "heading2": (12, 18, 15, 10, 0, "2c3e50", False),
    "heading3": (11, 16, 12, 8, 0, "34495e", False),
    "heading4": (10, 15, 10, 6, 0, "34495e", False),
    "normal": (10, 16, 0, 8, 0, "000000", False),
    "bullet": (10, 16, 0, 6, 20, "000000", False),
    "code": (9, 12, 0, 8, 10, "000000", False),
}
# Widths of Helvetica's characters from space to tilde, in thousandths of the size.
HELVETICA = [
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
]


class Latin:
    name = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"
    more: tuple[bytes, ...] = ()

    @staticmethod
    def width(c: str) -> int:
        return HELVETICA[ord(c) - 32] if " " <= c <= "~" else 556

    @staticmethod
    def string(text: str) -> bytes:
        return b"(" + re.sub(rb"([\\()])", rb"\\\1", text.encode("cp1252")) + b")"


class Chinese:
    name = b"<< /Type /Font /Subtype /Type0 /BaseFont /STSong-Light /Encoding /UniGB-UCS2-H /DescendantFonts [4 0 R] >>"
    more = (
        b"<< /Type /Font /Subtype /CIDFontType0 /BaseFont /STSong-Light /CIDSystemInfo << /Registry (Adobe) /Ordering (GB1) /Supplement 2 >> /FontDescriptor 5 0 R /DW 1000 /W [1 95 500] >>",
        b"<< /Type /FontDescriptor /FontName /STSong-Light /Flags 4 /FontBBox [-25 -254 1000 880] /ItalicAngle 0 /Ascent 880 /Descent -120 /CapHeight 880 /StemV 93 >>",
    )

    @staticmethod
    def width(c: str) -> int:
        return 500 if " " <= c <= "~" else 1000

    @staticmethod
    def string(text: str) -> bytes:
        return b"<" + "".join(c if c <= "￿" else "?" for c in text).encode("utf-16-be", "replace").hex().encode() + b">"


def broken(text: str, room: float, width) -> list[str]:
    """Lines no wider than ``room``: broken between words, inside words of other scripts and inside words that are too long."""
    lines, line, used = [], "", 0.0
    for piece in re.findall(r" +|[!-~¡-῿]+|[^ ]", " ".join(text.split())):
        size = sum(map(width, piece))
        if used + size > room and line and piece.strip():
            lines.append(line.rstrip())
            line, used = "", 0.0
        while size > room and len(piece) > 1:
            n, size_n = 0, 0.0
            while n < len(piece) and (not n or size_n + width(piece[n]) <= room):
                size_n += width(piece[n])
                n += 1
            lines.append(piece[:n])
            piece, size = piece[n:], size - size_n
        if line or piece.strip():
            line, used = line + piece, used + size
    return [*lines, line.rstrip()] if line.strip() else lines


def pages_of(found: list[tuple[str, str]], font) -> list[bytes]:
    """The content of each page: of blocks (kind, text)."""
    pages: list[list[bytes]] = [[]]
    y, gap = HEIGHT - MARGIN, 0.0
    for kind, text in found:
        style, space, sign = STYLES[kind]
        size, leading, before, after, indent, colour, centred = FORMS[style]
        room = WIDTH - 2 * MARGIN - indent
        lines = text.expandtabs(4).split("\n") if kind == "code" else broken(sign + text, room / size * 1000, font.width)
        y -= max(gap, before) if pages[-1] else 0
        ink = " ".join(f"{int(colour[k : k + 2], 16) / 255:.3f}" for k in (0, 2, 4))
        for line in lines:
            if y - leading < MARGIN:
                pages.append([])
                y = HEIGHT - MARGIN
            y -= leading
            if kind == "code":
                pages[-1].append(f"0.961 g {MARGIN + indent - 4:.2f} {y - 3:.2f} {room - 6:.2f} {leading} re f".encode())
            x = MARGIN + indent
            if centred:
                x += max(0.0, room - sum(map(font.width, line)) * size / 1000) / 2
            if line:
                pages[-1].append(f"BT {ink} rg /F1 {size} Tf {x:.2f} {y:.2f} Td ".encode() + font.string(line) + b" Tj ET")
        gap = after + space * CM
    return [b"\n".join(p) for p in pages]


def pdf(markdown: str | None) -> tuple[int, bytes]:
    """(pages, the file) of a Markdown text; one empty page if it has no blocks. The same text gives the same bytes."""
    found = [(kind, re.sub(r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", " ", text)) for kind, text in blocks(markdown)]
    try:
        "".join(text for _, text in found).encode("cp1252")
        font = Latin
    except UnicodeEncodeError:
        font = Chinese
    contents = pages_of(found, font)
    first = 4 + len(font.more)
    kids = " ".join(f"{first + 2 * n} 0 R" for n in range(len(contents)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(contents)} >>".encode(), font.name, *font.more]
    for n, body in enumerate(contents):
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {WIDTH} {HEIGHT}] /Resources << /Font << /F1 3 0 R >> >> /Contents {first + 2 * n + 1} 0 R >>".encode())
        objects.append(f"<< /Length {len(body)} >>\nstream\n".encode() + body + b"\nendstream")
    out, places = b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n", []
    parts = [out]
    at = len(out)
    for n, body in enumerate(objects, 1):
        parts.append(f"{n} 0 obj\n".encode() + body + b"\nendobj\n")
        places.append(at)
        at += len(parts[-1])
    table = f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n" + "".join(f"{p:010} 00000 n \n" for p in places)
    parts.append(f"{table}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{at}\n%%EOF\n".encode())
    return len(contents), b"".join(parts)


def pdfs(docs: DataFrame, id: str, markdown: str) -> DataFrame:
    """(id, pages, content) of each text; a null text is one empty page."""

    @F.pandas_udf("pages int, content binary")
    def made(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([pdf(x) for x in s], columns=["pages", "content"])

    return docs.select(id, made(F.col(markdown)).alias("p")).select(id, "p.*")


def shown(content: Column) -> Column:
    """The lines of text in a file that ``pdf`` made of Latin text, in order."""
    special = "".join(map(chr, range(128, 160)))  # where Windows-1252 isn't Latin-1
    text = F.translate(F.decode(content, "iso-8859-1"), special, special.encode("latin-1").decode("cp1252", "replace"))
    found = F.regexp_extract_all(text, F.lit(r"\(((?:[^\\()]|\\.)*)\) Tj"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, r"\\(.)", "$1"))
