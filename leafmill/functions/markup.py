"""Markup as a flat list of tokens, and which elements a token stands in. Tables, lists and notes are all read from it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple


class Token(NamedTuple):
    """A piece of markup: ``kind`` is open, close, void or text; ``text`` is decoded text, or the tag as it is written out again."""

    kind: str
    name: str
    text: str
    attributes: dict[str, str | None] = {}


class _Reader(HTMLParser):
    def __init__(self, voids: bool) -> None:
        super().__init__()
        self.voids, self.tokens = voids, []

    def _tag(self, kind, name, attrs, end):
        written = "".join(f" {k}" if v is None else ' {}="{}"'.format(k, v.replace('"', "&quot;")) for k, v in attrs)
        self.tokens.append(Token(kind, name, f"<{name}{written}{end}", dict(attrs)))

    def handle_starttag(self, tag, attrs):
        self._tag("open", tag, attrs, ">")

    def handle_startendtag(self, tag, attrs):
        if self.voids:
            self._tag("void", tag, attrs, "/>")
        else:
            super().handle_startendtag(tag, attrs)

    def handle_endtag(self, tag):
        self.tokens.append(Token("close", tag, f"</{tag}>"))

    def handle_data(self, data):
        self.tokens.append(Token("text", "", data))


def read(html: str, voids: bool = True) -> list[Token]:
    """The tokens of ``html``; comments go. Without ``voids``, a tag that closes itself is an opening and a closing one."""
    reader = _Reader(voids)
    reader.feed(html)
    reader.close()
    return reader.tokens


def innermost(tokens: list[Token], names: set[str], counts: Callable[[int], bool] = lambda n: True) -> list[tuple[int, int]]:
    """For each token: the number of the innermost open tag of ``names`` that counts (-1: none), and how many are open.

    An opening tag stands in itself, and a closing one in what it closes.
    """
    stack, out = [-1], []
    for n, t in enumerate(tokens):
        own = t.name in names
        if own and t.kind == "open" and counts(n):
            stack.append(n)
        out.append((stack[-1], len(stack) - 1))
        if own and t.kind == "close" and len(stack) > 1:
            stack.pop()
    return out


def runs(tokens: list[Token], names: set[str], counts: Callable[[int], bool] = lambda n: True) -> Iterator[tuple[int, int]]:
    """(opening, closing) of elements that don't nest: a closing tag belongs to the last opening one, if that is still open."""
    begin = None
    for n, t in enumerate(tokens):
        if t.name not in names:
            continue
        if t.kind == "open" and counts(n):
            begin = n
        elif t.kind == "close" and begin is not None:
            yield begin, n
            begin = None


def attribute(tag: str, name: str) -> str:
    """An attribute's value in the text of a tag: in double quotes, single quotes or none."""
    m = re.search(rf"(?i)\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+))", tag)
    return next((x for x in m.groups() if x is not None), "") if m else ""
