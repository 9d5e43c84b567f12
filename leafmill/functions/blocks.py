"""Markdown as typed blocks (kind, text), as a renderer to pages takes them: h1..h6, bullet, paragraph, code.

Blocks are what blank lines part, after fenced code is taken out. What a block is, its first line tells: a table, a list, indented code; headings, rules and
quotes also begin inside one. As such renderers have it, an item loses its own text to a list nested in it, and items that a blank line parts from
others of their list are paragraphs.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The style of each kind of block on a page, the centimetres after it, and what stands before its text.
STYLES = {
    "h1": ("title", 0.3, ""),
    "h2": ("heading1", 0.2, ""),
    "h3": ("heading2", 0.2, ""),
    "h4": ("heading3", 0.2, ""),
    "h5": ("heading4", 0.2, ""),
    "h6": ("heading4", 0.2, ""),
    "bullet": ("bullet", 0.0, "• "),
    "paragraph": ("normal", 0.2, ""),
    "code": ("code", 0.2, ""),
}

ATX = re.compile(r"(#{1,6})\s*(.*?)\s*#*\s*\Z")
ITEM = re.compile(r"(\s*)(?:[*+-]|\d+\.)\s+(.*)\Z", re.S)
FENCE = re.compile(r"(`{3,}|~{3,})")
RULE = re.compile(r"\s{0,3}(?:(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,})\Z")
UNDERLINE = re.compile(r"(=+|-+)\s*\Z")
DIVIDER = re.compile(r"\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*\Z")


# How Markdown readers pair marks of emphasis, in the order tried: what is between the marks stays.
STARS = [
    re.compile(p, re.S)
    for p in (r"(\*)\1{2}(.+?)\1(.*?)\1{2}", r"(\*)\1{2}(.+?)\1{2}(.*?)\1", r"(\*)\1(?!\1)([^*]+?)\1(?!\1)(.+?)\1{3}", r"(\*{2})(.+?)\1()", r"(\*)([^*]+)\1()")
]
LINES = [re.compile(p, re.S) for p in (r"(?<!\w)(_)\1{2}(.+?)\1{3}(?!\w)()", r"(?<!\w)(_{2})(?!_)(.+?)(?<!_)\1(?!\w)()", r"(?<!\w)(_)(?!_)(.+?)(?<!_)\1(?!\w)()")]
ALONE = re.compile(r"(?:(?<=\s)|(?<![\s\S]))(?:\*{1,3}|_{1,3})(?=\s|\Z)")


def plain(text: str, mark: str, patterns: list[re.Pattern]) -> str:
    """``text`` without pairs of a mark, from the left; a mark between blanks, or without a partner, stays."""
    out, at = [], 0
    while (n := text.find(mark, at)) >= 0:
        out.append(text[at:n])
        if m := ALONE.match(text, n):
            out.append(m[0])
            at = m.end()
        elif m := next((m for p in patterns if (m := p.match(text, n))), None):
            out.append(plain(m[2], mark, patterns) + plain(m[3], mark, patterns))
            at = m.end()
        else:
            out.append(mark)
            at = n + 1
    return "".join(out) + text[at:]


def flat(text: str) -> str:
    """A block's text without inline marks: pictures go, links, code and emphasis leave their text."""
    text = re.sub(r"!\[[^\]\n]*\]\([^)\n]*\)", "", text)
    text = re.sub(r"\[([^\]\n]*)\]\([^)\n]*\)", r"\1", text)
    text = "".join(x if n % 2 else plain(plain(x, "*", STARS), "_", LINES) for n, x in enumerate(re.split(r"`([^`\n]+)`", text)))
    return text.strip()


def cells(row: str) -> list[str]:
    return [flat(c.replace("\0", "|")) for c in row.strip().replace("\\|", "\0").strip("|").split("|")]


def table(rows: list[str]) -> str:
    """Rows behind the divider are as wide as the first."""
    head, body = cells(rows[0]), map(cells, rows[2:])
    grid = [head, *((row + [""] * len(head))[: len(head)] for row in body)]
    return "\n".join("| " + " | ".join(row) + " |" for row in grid)


def indent_of(line: str) -> int:
    return len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip())


class _Blocks:
    def __init__(self) -> None:
        self.out: list[list[str]] = []
        self.items: list[tuple[int, int]] = []  # (level, number in out) of the list that goes on

    def put(self, kind: str, text: str) -> None:
        self.out.append([kind, text])

    def block(self, rows: list[str]) -> None:
        """One block's lines, none of them blank."""
        if not rows:
            return
        if self.items and indent_of(rows[0]) >= 4:
            self._loosen()
            inner = [x.expandtabs(4)[min(4, indent_of(x)) :] for x in rows]
            if ITEM.match(inner[0]):
                self._list(inner, 1)
            else:
                self.put("paragraph", flat("\n".join(inner)))
            return
        if ITEM.match(rows[0]) and indent_of(rows[0]) < 4 and not RULE.match(rows[0]):
            after = len(self.items) > 0
            if after:
                self._loosen()
            first = len(self.out)
            self._list(rows, 0)
            if after and self.out[first][0] == "bullet":
                self.out[first][0] = "paragraph"
            return
        self.items = []
        if indent_of(rows[0]) >= 4:
            n = next((i for i, x in enumerate(rows) if indent_of(x) < 4), len(rows))
            self.put("code", "\n".join(x.expandtabs(4)[4:] for x in rows[:n]).rstrip())
            self.block(rows[n:])
        elif len(rows) > 1 and "|" in rows[0] and "|" in rows[1] and DIVIDER.match(rows[1]):
            self.put("code", table(rows))
        elif (n := next((i for i, x in enumerate(rows) if ATX.match(x)), None)) is not None:
            self.block(rows[:n])
            level, title = ATX.match(rows[n]).groups()
            self.put(f"h{len(level)}", flat(title))
            self.block(rows[n + 1 :])
        elif len(rows) > 1 and UNDERLINE.match(rows[1]):
            self.put("h1" if rows[1][0] == "=" else "h2", flat(rows[0]))
            self.block(rows[2:])
        elif (n := next((i for i, x in enumerate(rows) if RULE.match(x)), None)) is not None:
            self.block(rows[:n])
            self.block(rows[n + 1 :])
        elif (n := next((i for i, x in enumerate(rows) if re.match(r"\s{0,3}>", x)), None)) is not None:
            self.block(rows[:n])
            self.block([y for x in rows[n:] if (y := re.sub(r"\A\s{0,3}>\s?", "", x)).strip()])
            self.items = []
        else:
            self.put("paragraph", flat("\n".join(rows)))

    def _list(self, rows: list[str], level: int) -> None:
        """Items at once one after the other: an item that is followed by a deeper one loses its text."""
        found: list[tuple[int, list[str]]] = []
        for x in rows:
            if m := ITEM.match(x):
                found.append((level + indent_of(x) // 4, [m[2]]))
            else:
                found[-1][1].append(x.strip())
        for n, (own, lines) in enumerate(found):
            lost = n + 1 < len(found) and found[n + 1][0] > own
            self.items.append((own, len(self.out)))
            self.put("lost" if lost else "bullet", flat("\n".join(lines)))

    def _loosen(self) -> None:
        """A blank line and more of the list follow: its last outer item is a paragraph."""
        self.out[next(n for level, n in reversed(self.items) if level == 0)][0] = "paragraph"


def blocks(markdown: str | None) -> list[tuple[str, str]]:
    """The blocks in order. A table is one block of code, a row for each line without the divider; blocks without text are dropped."""
    rows, found, held, at = (markdown or "").splitlines(), _Blocks(), [], 0
    while at < len(rows):
        line = rows[at]
        fence = FENCE.match(line)
        end = next((i for i in range(at + 1, len(rows)) if rows[i].startswith(fence[1])), None) if fence else None
        if end is not None:
            found.block(held)
            held, found.items = [], []
            found.put("code", "\n".join(rows[at + 1 : end]).rstrip())
            at = end
        elif line.strip():
            held.append(line)
        else:
            found.block(held)
            held = []
        at += 1
    found.block(held)
    return [(kind, text) for kind, text in found.out if text and kind != "lost"]


def md_blocks(docs: DataFrame, id: str, markdown: str) -> DataFrame:
    """(id, block_no, kind, text) of each text's blocks; null and empty texts have none."""

    @F.pandas_udf("array<struct<kind: string, text: string>>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [{"kind": k, "text": t} for k, t in blocks(x)])

    return docs.select(id, F.posexplode(cut(F.col(markdown))).alias("block_no", "b")).select(id, "block_no", "b.kind", "b.text")


def styled(rows: DataFrame) -> DataFrame:
    """Blocks with their style, the space after them in centimetres, and their text as it is shown, with markup escaped (code stays as it is)."""
    from leafmill.functions.scalars import escape_markup

    style, space, sign = (F.element_at(F.create_map(*(F.lit(x) for kind, own in STYLES.items() for x in (kind, own[n]))), F.col("kind")) for n in range(3))
    shown = F.when(F.col("kind") == "code", F.col("text")).otherwise(F.concat(sign, escape_markup(F.col("text"))))
    return rows.withColumns({"style": style, "space_after": space, "text": shown})
