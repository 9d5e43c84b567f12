"""Functions of one value, as columns; a UDF only where Spark has no such function."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from html import unescape as decode
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What Python's str.strip() removes, for Java's regular expressions.
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"
#: The separators at which Python's str.splitlines() breaks a text.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
QUOTES = '"“”‘’‚‛„‟«»‹›'
MIME = {"bmp": ".bmp", "gif": ".gif", "jpeg": ".jpeg", "jpg": ".jpeg", "png": ".png", "tiff": ".tiff", "webp": ".webp", "x-emf": ".emf", "x-wmf": ".wmf"}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{BLANK}+|{BLANK}+\z", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, rf"{BLANK}+", " "))


def lines(c: Column) -> Column:
    """The lines of a text; an end of line at its end makes none."""
    found = F.split(c, LINE_END)
    return F.when(F.element_at(found, -1) == "", F.slice(found, 1, F.size(found) - 1)).otherwise(found)


_CLOSED = r"(?:#(?:[0-9]+|[xX][0-9a-fA-F]+)|[A-Za-z][A-Za-z0-9]*);"
_REFERENCE, _AMPERSAND = re.compile(f"&({_CLOSED})"), re.compile(f"&(?:amp;)?({_CLOSED})?")


def _known(name: str | None) -> bool:
    return bool(name) and (name[0] == "#" or name in html5)


def decode_closed(text: str) -> str:
    """Entities decoded, once; only those that end in a semicolon are entities."""
    return _REFERENCE.sub(lambda m: decode(m[0]) if _known(m[1]) else m[0], text)


def closed_only(step, text: str) -> str:
    """``step`` on a text of which it decodes only entities that end in a semicolon: ampersands that begin no such entity, now or once decoded,
    stand under a sign that the text doesn't have."""
    if "&" not in text:
        return step(text)
    sign = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in text)
    return step(_AMPERSAND.sub(lambda m: m[0] if _known(m[1]) else sign + (m[1] or ""), text)).replace(sign, "&")


def unescape(c: Column, closed: bool = False) -> Column:
    """HTML5 entities decoded, with the standard's rules for missing semicolons and Windows-1252 numbers; with ``closed`` only those that end in a semicolon."""
    one = decode_closed if closed else decode

    @F.pandas_udf("string")
    def decoded(s: pd.Series) -> pd.Series:
        return s.map(lambda x: one(x) if x is not None and "&" in x else x)

    return decoded(c)


def cell_text(c: Column, entities: bool = True) -> Column:
    """A cell of a pipe table: lines squeezed, blank ones dropped, joined by <br>, pipes escaped. Null is empty."""
    c = F.coalesce(c, F.lit(""))
    if entities:
        c = unescape(c)
    c = F.regexp_replace(F.replace(c, F.lit("\xa0"), F.lit(" ")), "\r\n?", "\n")
    kept = F.filter(F.transform(F.split(c, "\n"), squeeze), lambda x: x != "")
    return F.replace(F.array_join(kept, "<br>"), F.lit("|"), F.lit("\\|"))


def list_item_text(c: Column) -> Column:
    """A list item: blank lines dropped, nested items keep their indentation, other lines are squeezed. Null is empty."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n")
    nested = r"(?U)\A\s+(?:-|\d+\.)\s+"

    def line(x: Column) -> Column:
        return F.when(x.rlike(nested), F.regexp_replace(x, rf"{BLANK}+\z", "")).otherwise(squeeze(x))

    return F.array_join(F.transform(F.filter(F.split(c, "\n"), lambda x: strip(x) != ""), line), "\n")


def style_level(c: Column) -> Column:
    """The number at the end of a style's name, 6 at most; null if there is none or zero."""
    digits = F.regexp_extract(strip(F.coalesce(c, F.lit(""))), r"([0-9]+)\z", 1)
    value = F.coalesce(digits.try_cast("bigint"), F.when(digits != "", F.lit(6)))
    return F.when(value > 0, F.least(value, F.lit(6)).cast("int"))


def text_level(c: Column) -> Column:
    """The depth of a number such as 1.2.3 at a text's start, 6 at most; null without."""
    number = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?U)\A\s*(\d+(?:\.\d+)*)\s*\.?\s+", 1)
    return F.when(number != "", F.least(F.size(F.split(number, r"\.")), F.lit(6)))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x or ""))


def sanitize_stem(c: Column, normalize: bool = True) -> Column:
    """A file name's stem: no quotes, forbidden characters as _, no dots or blanks at the ends, 120 characters at most."""
    out = nfkc(c) if normalize else F.coalesce(c, F.lit(""))
    out = squeeze(F.translate(F.translate(out, QUOTES, ""), '\\/:*?"<>|', "_" * 9))
    out = strip(F.regexp_replace(out, r"\A[. ]+|[. ]+\z", ""))
    short = F.concat(F.left(out, F.lit(111)), F.lit("_"), F.left(F.sha2(c.cast("binary"), 256), F.lit(8)))
    return F.when(out == "", "document").when(F.length(out) <= 120, out).otherwise(short)


def resolve_path(c: Column) -> Column:
    """A relationship's target as a part's name in the package: under word/, with . and .. resolved."""
    c = strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("/")))
    inner = F.regexp_replace(c, r"\A/", "")
    # a second slash makes the rest absolute; two leading slashes stay two, as POSIX names do
    whole = F.when(inner.startswith("word/") | inner.startswith("/"), inner).otherwise(F.concat(F.lit("word/"), inner))
    lead = F.when(whole.rlike(r"\A//(?!/)"), "//").when(whole.startswith("/"), "/").otherwise("")

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        root = (part == "..") & (F.size(done) == 0) & (lead != "")
        return F.when((part == "") | (part == ".") | root, done).when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.split(whole, "/"), F.lit([]).cast("array<string>"), step)
    path = F.concat(lead, F.array_join(parts, "/"))
    return F.when(c == "", "").when(path == "", ".").otherwise(path)


def format_timestamp(c: Column) -> Column:
    """A date alone at midnight, else to the second; null is empty."""
    whole = F.date_format(c, "HH:mm:ss.SSSSSS") == "00:00:00.000000"
    return F.coalesce(F.when(whole, F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss")), F.lit(""))


@F.pandas_udf(StringType())
def float_text(s: pd.Series) -> pd.Series:
    """A number as Python writes it, integral ones without a point; null is empty."""

    def text(x) -> str:
        if x is None or pd.isna(x):
            return ""
        return str(int(x)) if float(x).is_integer() else repr(float(x))

    return s.map(text)


def format_double(c: Column) -> Column:
    """Integral values in the JVM; a fractional one goes through Python's shortest form."""
    small = F.abs(c) < 1e15
    return F.when(c.isNull(), "").when(small & (c == F.floor(c)), c.cast("long").cast("string")).otherwise(float_text(c))


def image_format(c: Column) -> Column:
    """The extension that an image's first bytes tell; null if none."""

    def at(start: int, data: bytes) -> Column:
        return F.substring(c, start, len(data)) == F.lit(bytearray(data))

    return (
        F.when(at(1, b"\x89PNG\r\n\x1a\n"), ".png")
        .when(at(1, b"\xff\xd8"), ".jpeg")
        .when(at(1, b"GIF87a") | at(1, b"GIF89a"), ".gif")
        .when(at(1, b"RIFF") & at(9, b"WEBP"), ".webp")
        .when(at(1, b"BM"), ".bmp")
        .when(at(1, b"II*\x00") | at(1, b"MM\x00*"), ".tiff")
        .when(at(1, b"\xd7\xcd\xc6\x9a"), ".wmf")
        .when(at(41, b" EMF"), ".emf")
    )


def file_extension(name: Column) -> Column:
    """The last extension of a file name, lower case; names that only begin with dots have none."""
    return F.lower(F.regexp_extract(name, r"(?s)[^./][^/]*?(\.[^./]*)\z", 1))


def image_extension(content: Column, name: Column) -> Column:
    """What the bytes tell, else the name's own, else .png."""
    return F.coalesce(image_format(content), F.when(file_extension(name) != "", file_extension(name)), F.lit(".png"))


def mime_extension(c: Column) -> Column:
    subtype = F.lower(F.element_at(F.split(F.coalesce(c, F.lit("")), "/"), -1))
    out = F.lit(None).cast("string")
    for name, ext in MIME.items():
        out = F.when(subtype == name, ext).otherwise(out)
    return F.coalesce(out, F.lit(".bin"))


def escape_markup(c: Column) -> Column:
    """& < > as entities, for a renderer that reads markup."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def without_residue(c: Column) -> Column:
    """Lines that only ask to click on a preview picture to see the whole sheet are dropped with the blank lines before."""
    return F.regexp_replace(c, r"(?U)\n+\*{0,2}点击图片可查看完整电子表格\*{0,2}\s*\n", "\n")


def short_hash(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()[:8]
