"""Queries over lines and single values, and what they return in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import scalars as S
from leafmill.operators import headings
from leafmill.plans.html import query
from leafmill.tables import load

_WS = r"[\s\x1c-\x1f\x0b\x{85}\p{Z}]"


@query(
    "md_lines",
    r"""WITH p AS (SELECT doc_id, string_split(replace(regexp_replace(text, '\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g'), chr(13), chr(10)), chr(10)) AS ls FROM documents),
q AS (SELECT doc_id, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM p)
SELECT doc_id, (i - 1)::INT AS line_no, ls[i] AS line FROM q, unnest(range(1, len(ls) + 1)) AS u(i)""",
)
def md_lines(spark, sf_dir):
    return headings.md_lines(load(spark, sf_dir, "documents"), "doc_id", "text")


def outline(spark, sf_dir):
    """Lines of a document for each customer, from its orders: headings, numbered bold lines of one and two parts, text."""
    orders = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey").cast("string")
    line = (
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.repeat(F.lit("#"), (F.col("o_orderkey") % 6 + 1).cast("int")), F.lit(" h"), k))
        .when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit("1. **t"), k, F.lit("** ")))
        .when(F.col("o_orderkey") % 5 == 2, F.concat(F.lit("1.2 **t"), k, F.lit("**")))
        .when(F.col("o_orderkey") % 5 == 3, F.concat(F.lit("**b"), k, F.lit("**")))
        .otherwise(F.concat(F.lit("text "), k))
    )
    return orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("line_no"), line.alias("line"))


_OUTLINE = """o AS (SELECT o_custkey AS doc_id, o_orderkey AS line_no, o_orderkey % 5 AS k, CASE o_orderkey % 5
  WHEN 0 THEN repeat('#', (o_orderkey % 6 + 1)::INT) || ' h' || o_orderkey WHEN 1 THEN '1. **t' || o_orderkey || '** ' WHEN 2 THEN '1.2 **t' || o_orderkey || '**'
  WHEN 3 THEN '**b' || o_orderkey || '**' ELSE 'text ' || o_orderkey END AS line FROM orders)"""

_NUMBERED = f"""WITH RECURSIVE {_OUTLINE},
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM o),
s AS (SELECT doc_id, line_no, i, CASE k WHEN 0 THEN (line_no % 6 + 1)::INT WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS level, (k = 1) AS lone, k, line FROM n WHERE i = 1
  UNION ALL SELECT n.doc_id, n.line_no, n.i,
    CASE n.k WHEN 0 THEN (n.line_no % 6 + 1)::INT WHEN 2 THEN 2 WHEN 1 THEN CASE WHEN s.level >= 2 THEN CASE WHEN s.lone THEN s.level ELSE least(s.level + 1, 6) END ELSE 1 END ELSE s.level END,
    CASE WHEN n.k = 1 THEN true WHEN n.k IN (0, 2) THEN false ELSE s.lone END, n.k, n.line
  FROM s JOIN n ON n.doc_id = s.doc_id AND n.i = s.i + 1)
SELECT doc_id, line_no, CASE k WHEN 1 THEN repeat('#', level) || ' 1. t' || line_no WHEN 2 THEN '## 1.2 t' || line_no ELSE line END AS line FROM s"""


@query("md_promote_numbered", _NUMBERED)
def md_promote_numbered(spark, sf_dir):
    return headings.promote_numbered(outline(spark, sf_dir), "doc_id")


@query(
    "md_promote_title",
    f"""WITH {_OUTLINE}, f AS (SELECT doc_id, min(line_no) AS first FROM o GROUP BY doc_id)
SELECT o.doc_id, o.line_no, CASE WHEN o.line_no = f.first AND k = 3 AND EXISTS (SELECT 1 FROM o AS x WHERE x.doc_id = o.doc_id AND x.line_no > o.line_no AND x.k = 2) THEN '# b' || o.line_no
  WHEN k = 2 THEN '## 1.2 t' || o.line_no ELSE o.line END AS line FROM o JOIN f ON f.doc_id = o.doc_id""",
)
def md_promote_title(spark, sf_dir):
    """Titles above lines that are numbered headings already."""
    rows = outline(spark, sf_dir).withColumn("line", F.regexp_replace("line", r"\A1\.2 \*\*(t[0-9]+)\*\*\z", "## 1.2 $1"))
    return headings.promote_title(rows, "doc_id")


@query(
    "cell_normalize",
    rf"""SELECT doc_id, replace(array_to_string(list_filter(list_transform(string_split(replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(160), ' '), chr(10)),
  lambda x: regexp_replace(regexp_replace(x, '{_WS}+', ' ', 'g'), '^ | $', '', 'g')), lambda x: x <> ''), '<br>'), '|', '\|') AS out FROM documents""",
)
def cell_normalize(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", S.cell_text(F.col("text")).alias("out"))


@query(
    "list_item_normalize",
    r"""WITH l AS (SELECT doc_id, string_split(regexp_replace(replace(coalesce(text, ''), '. ', '.' || chr(10) || '  - '), '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM documents)
SELECT doc_id, array_to_string(list_transform(list_filter(ls, lambda x: regexp_matches(x, '\S')),
  lambda x: CASE WHEN regexp_matches(x, '^\s+(-|\d+\.)\s+') THEN regexp_replace(x, '\s+$', '') ELSE regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^ | $', '', 'g') END), chr(10)) AS out FROM l""",
)
def list_item_normalize(spark, sf_dir):
    """Documents whose sentences stand as nested items."""
    text = F.replace(F.col("text"), F.lit(". "), F.lit(".\n  - "))
    return load(spark, sf_dir, "documents").select("doc_id", S.list_item_text(text).alias("out"))


@query("style_level", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 11 = 0 THEN NULL ELSE least(o_orderkey % 11, 6)::INT END AS level FROM orders")
def style_level(spark, sf_dir):
    style = F.when(F.col("o_orderkey") % 3 == 0, "Normal").otherwise(F.concat(F.lit("Heading"), (F.col("o_orderkey") % 11).cast("string"), F.lit(" ")))
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), S.style_level(style).alias("level"))


@query("text_level", "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 4 THEN 6 ELSE o_orderkey % 5 END::INT AS level FROM orders")
def text_level(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, "1.2no space").when(k == 1, " 7 . T").when(k == 2, "1.2 T").when(k == 3, "1.2.3. T").otherwise("1.2.3.4.5.6.7 T")
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), S.text_level(text).alias("level"))


_STEM = "(SELECT p_partkey AS id, '\"' || p_name || '\" : ' || p_brand || '/' || repeat(p_type || '  x', (p_size % 9)::INT) || ' ..' AS raw FROM part UNION ALL SELECT page_id + 1000000000, url FROM pages)"


@query(
    "sanitize_stem",
    rf"""WITH s AS (SELECT id, raw, regexp_replace(trim(regexp_replace(regexp_replace(replace(raw, '"', ''), '[\\/:*?<>|]', '_', 'g'), '\s+', ' ', 'g')), '^[. ]+|[. ]+$', '', 'g') AS t FROM {_STEM})
SELECT id, CASE WHEN t = '' THEN 'document' WHEN length(t) <= 120 THEN t ELSE t[:111] || '_' || sha256(raw)[:8] END AS out FROM s""",
)
def sanitize_stem(spark, sf_dir):
    part, pages = load(spark, sf_dir, "part"), load(spark, sf_dir, "pages")
    raw = F.concat(F.lit('"'), "p_name", F.lit('" : '), "p_brand", F.lit("/"), F.repeat(F.concat("p_type", F.lit("  x")), (F.col("p_size") % 9).cast("int")), F.lit(" .."))
    both = part.select(F.col("p_partkey").alias("id"), raw.alias("raw")).unionAll(pages.select(F.col("page_id") + 1000000000, "url"))
    return both.select("id", S.sanitize_stem(F.col("raw")).alias("out"))


@query(
    "resolve_path",
    """SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN 'word/media/i' || p_partkey WHEN 1 THEN 'word/media/i' || p_partkey WHEN 2 THEN 'media/i' || p_partkey WHEN 3 THEN 'word/media/i' || p_partkey
WHEN 4 THEN '../i' || p_partkey WHEN 5 THEN '' ELSE 'word/b/i' || p_partkey END AS out FROM part""",
)
def resolve_path(spark, sf_dir):
    i = F.concat(F.lit("i"), F.col("p_partkey").cast("string"))
    k = F.col("p_partkey") % 7
    raw = (
        F.when(k == 0, F.concat(F.lit("media/"), i)).when(k == 1, F.concat(F.lit("/word/media/"), i)).when(k == 2, F.concat(F.lit("../media/"), i)).when(k == 3, F.concat(F.lit(" \\media\\"), i))
        .when(k == 4, F.concat(F.lit("word/../../"), i)).when(k == 5, F.lit(None)).otherwise(F.concat(F.lit("./a/..//b/"), i))
    )
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.resolve_path(raw).alias("out"))


@query(
    "format_cell",
    """SELECT 'o' AS kind, o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS out FROM orders UNION ALL
SELECT 'e', event_id, CASE WHEN date_trunc('day', ts) = ts THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END FROM events UNION ALL
SELECT 'q', l_orderkey, l_quantity::BIGINT::VARCHAR FROM lineitem UNION ALL SELECT 'd', l_orderkey, CASE WHEN l_discount = 0 THEN '0' ELSE l_discount::VARCHAR END FROM lineitem UNION ALL
SELECT 'b', p_partkey, CASE WHEN p_size > 9 THEN 'True' ELSE 'False' END FROM part""",
)
def format_cell(spark, sf_dir):
    orders, events, items, part = (load(spark, sf_dir, t) for t in ("orders", "events", "lineitem", "part"))
    return (
        orders.select(F.lit("o").alias("kind"), F.col("o_orderkey").alias("id"), S.format_timestamp(F.col("o_orderdate")).alias("out"))
        .unionAll(events.select(F.lit("e"), "event_id", S.format_timestamp(F.col("ts"))))
        .unionAll(items.select(F.lit("q"), "l_orderkey", S.format_double(F.col("l_quantity"))))
        .unionAll(items.select(F.lit("d"), "l_orderkey", S.format_double(F.col("l_discount"))))
        .unionAll(part.select(F.lit("b"), "p_partkey", F.initcap((F.col("p_size") > 9).cast("string"))))
    )


MAGIC = ["89504e470d0a1a0a", "ffd8", "474946383761", "474946383961", "524946460000000057454250", "424d", "49492a00", "4d4d002a", "d7cdc69a", "00" * 40 + "20454d46", "616263"]
KINDS = [".png", ".jpeg", ".gif", ".gif", ".webp", ".bmp", ".tiff", ".tiff", ".wmf", ".emf", None]
_CASE = " ".join(f"WHEN {i} THEN {'NULL' if x is None else repr(x)}" for i, x in enumerate(KINDS))


def _image(k):
    out = F.lit(None).cast("string")
    for i, m in enumerate(MAGIC):
        out = F.when(k == i, m).otherwise(out)
    return F.concat(F.unhex(out), k.cast("string").cast("binary"))


@query("image_format", f"SELECT p_partkey AS id, CASE p_partkey % 11 {_CASE} END AS ext FROM part")
def image_format(spark, sf_dir):
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.image_format(_image(F.col("p_partkey") % 11)).alias("ext"))


@query("image_ext", f"SELECT p_partkey AS id, coalesce(CASE p_partkey % 11 {_CASE} END, CASE p_partkey % 2 WHEN 0 THEN '.wdp' ELSE '.png' END) AS ext FROM part")
def image_ext(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 2 == 0, "a.b.WDP").otherwise("image")
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.image_extension(_image(F.col("p_partkey") % 11), name).alias("ext"))


@query("mime_ext", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '.jpeg' WHEN 1 THEN '.wmf' WHEN 2 THEN '.bin' ELSE '.tiff' END AS ext FROM part")
def mime_ext(spark, sf_dir):
    k = F.col("p_partkey") % 4
    mime = F.when(k == 0, "image/JPG").when(k == 1, "image/x-wmf").when(k == 2, "image/svg+xml").otherwise("tiff")
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.mime_extension(mime).alias("ext"))


@query("strip_residue", "SELECT p_partkey AS id, p_name || chr(10) || p_brand AS out FROM part")
def strip_residue(spark, sf_dir):
    mark = F.when(F.col("p_partkey") % 2 == 0, "**").otherwise("")
    text = F.concat("p_name", F.lit("\n\n"), mark, F.lit("点击图片可查看完整电子表格"), mark, F.lit(" \n\n"), "p_brand")
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.without_residue(text).alias("out"))
