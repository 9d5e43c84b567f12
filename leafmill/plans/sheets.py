"""Queries over sheets, relationships, pictures and batches, and what they return in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import scalars as S
from leafmill.operators import appendix, batch, grid, pairs
from leafmill.plans.html import query
from leafmill.tables import load


def cells(spark, sf_dir, blanks: bool = False):
    """Sheets (book: region, sheet: nation) of six columns, from customers in order; merges of the first cell over 2 rows and 2 columns."""
    customer, nation = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    v = F.when(F.col("c_custkey") % 4 == 0, F.lit(" ")).otherwise(F.col("c_name")) if blanks else F.col("c_name")
    if blanks:  # the second column and every third row are blank
        v = F.when(((F.col("k") % 6) == 1) | (F.floor(F.col("k") / 6) % 3 == 1), F.lit("")).otherwise(v)
    rows = customer.select("c_nationkey", "c_custkey", "c_name", k.alias("k")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("n_regionkey").alias("book"), F.col("c_nationkey").alias("sheet"), (F.floor(F.col("k") / 6) + 1).cast("int").alias("r"), (F.col("k") % 6 + 1).cast("int").alias("c"), v.alias("v"))


def merges(spark, sf_dir):
    nation = load(spark, sf_dir, "nation").where("n_nationkey % 2 = 0")
    one, two = F.lit(1), F.lit(2)
    return nation.select(F.col("n_regionkey").alias("book"), F.col("n_nationkey").alias("sheet"), one.alias("r0"), two.alias("r1"), one.alias("c0"), two.alias("c1"), F.lit("A1:B2").alias("ref"))


def _cells_sql(blanks: bool = False) -> str:
    v = "c_name"
    if blanks:
        v = "CASE WHEN k % 6 = 1 OR (k // 6) % 3 = 1 THEN '' WHEN c_custkey % 4 = 0 THEN ' ' ELSE c_name END"
    return f"""ce AS (SELECT n_regionkey AS book, c_nationkey AS sheet, (k // 6 + 1)::INT AS r, (k % 6 + 1)::INT AS c, {v} AS v FROM
  (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k FROM customer) JOIN nation ON c_nationkey = n_nationkey)"""


@query(
    "merge_expand",
    f"""WITH {_cells_sql()}, a AS (SELECT * FROM ce WHERE r = 1 AND c = 1 AND sheet % 2 = 0),
g AS (SELECT book, sheet, r, c FROM ce UNION SELECT a.book, a.sheet, i.r::INT, j.c::INT FROM a, unnest([1, 2]) AS i(r), unnest([1, 2]) AS j(c) WHERE i.r <= (SELECT max(r) FROM ce WHERE ce.sheet = a.sheet))
SELECT g.sheet, g.r, g.c, coalesce(CASE WHEN g.r <= 2 AND g.c <= 2 THEN a.v END, ce.v) AS v FROM g LEFT JOIN ce USING (book, sheet, r, c) LEFT JOIN a ON a.sheet = g.sheet""",
)
def merge_expand(spark, sf_dir):
    return grid.expand_merges(cells(spark, sf_dir), merges(spark, sf_dir), ["book", "sheet"]).select("sheet", "r", "c", "v")


_TRIM = """t AS (SELECT book, sheet, r2, dense_rank() OVER (PARTITION BY sheet ORDER BY c) AS c2, v FROM
  (SELECT *, dense_rank() OVER (PARTITION BY sheet ORDER BY r) AS r2 FROM ce
   WHERE EXISTS (SELECT 1 FROM ce x WHERE x.sheet = ce.sheet AND x.r = ce.r AND trim(x.v) <> '') AND EXISTS (SELECT 1 FROM ce x WHERE x.sheet = ce.sheet AND x.c = ce.c AND trim(x.v) <> '')))"""


@query("sheet_trim", f"WITH {_cells_sql(True)}, {_TRIM} SELECT sheet, r2::INT AS r2, c2::INT AS c2, v FROM t")
def sheet_trim(spark, sf_dir):
    return grid.trim(cells(spark, sf_dir, True), ["book", "sheet"]).select("sheet", "r2", "c2", "v")


_BEST = "s AS (SELECT book, sheet, count(*) AS n FROM ce WHERE trim(v) <> '' GROUP BY 1, 2), b AS (SELECT book, sheet FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY n DESC, sheet) AS k FROM s) WHERE k = 1)"


@query("best_sheet", f"WITH {_cells_sql(True)}, {_BEST} SELECT book AS region, sheet FROM b")
def best_sheet(spark, sf_dir):
    return grid.best_sheet(cells(spark, sf_dir, True), ["book"]).select(F.col("book").alias("region"), "sheet")


@query(
    "excel_to_md",
    f"""WITH {_cells_sql()}, {_BEST},
m AS (SELECT ce.book, ce.sheet, r, c, CASE WHEN ce.sheet % 2 = 0 AND r <= 2 AND c <= 2 THEN (SELECT v FROM ce y WHERE y.sheet = ce.sheet AND y.r = 1 AND y.c = 1) ELSE v END AS v FROM ce JOIN b USING (book, sheet)),
w AS (SELECT book, sheet, max(c) AS w FROM m GROUP BY 1, 2),
f AS (SELECT w.book, w.sheet, g.r, h.c::INT AS c, coalesce(m.v, '') AS v FROM w JOIN (SELECT DISTINCT book, sheet, r FROM m) g USING (book, sheet) CROSS JOIN unnest(range(1, 7)) AS h(c) LEFT JOIN m ON m.sheet = w.sheet AND m.r = g.r AND m.c = h.c WHERE h.c <= w.w),
l AS (SELECT book, sheet, r, '| ' || string_agg(v, ' | ' ORDER BY c) || ' |' AS line, count(*) AS n FROM f GROUP BY 1, 2, 3)
SELECT book AS doc, CASE WHEN sheet % 2 = 0 THEN '> merge_ranges: A1:B2' || chr(10) || chr(10) ELSE '' END || string_agg(CASE WHEN r = 1 THEN line || chr(10) || '|' || repeat(' --- |', n::INT) || CASE WHEN (SELECT max(r) FROM l y WHERE y.sheet = l.sheet) = 1 THEN chr(10) ELSE '' END ELSE line END, chr(10) ORDER BY r) AS markdown
FROM l GROUP BY book, sheet""",
)
def excel_to_md(spark, sf_dir):
    return grid.workbook_markdown(cells(spark, sf_dir), merges(spark, sf_dir), ["book"]).select(F.col("book").alias("doc"), "markdown")


def relationships(spark, sf_dir):
    """Packages from parts (doc: p_size): workbooks and images by p_partkey % 3."""
    part = load(spark, sf_dir, "part")
    i, k = F.col("p_partkey").cast("string"), F.col("p_partkey") % 3
    kind = F.when(k == 0, "package").when(k == 1, "image").otherwise("styles")
    target = F.when(k == 0, F.concat(F.lit("embeddings/b"), i, F.lit(".xlsx"))).when(k == 1, F.concat(F.lit("media/m"), i, F.lit(".png"))).otherwise("styles.xml")
    return part.select(F.col("p_size").alias("doc_id"), F.col("p_partkey").alias("rel_no"), F.concat(F.lit("rId"), i).alias("rid"), kind.alias("type"), target.alias("target"))


def objects(spark, sf_dir):
    """An object for every second workbook, with the workbook itself as its picture."""
    part = load(spark, sf_dir, "part").where("p_partkey % 6 = 0")
    i = F.col("p_partkey")
    return part.select(F.col("p_size").alias("doc_id"), i.alias("obj_no"), F.concat(F.lit("rId"), i.cast("string")).alias("ole_rid"), F.concat(F.lit("rId"), i.cast("string")).alias("img_rid"))


_RELS = """r AS (SELECT p_size AS doc_id, p_partkey AS k, p_partkey % 3 AS kind, CASE p_partkey % 3 WHEN 0 THEN 'word/embeddings/b' || p_partkey || '.xlsx' WHEN 1 THEN 'word/media/m' || p_partkey || '.png' ELSE 'word/styles.xml' END AS path FROM part),
o AS (SELECT doc_id, path AS xlsx_path, path AS img_path, 1 AS method, k FROM r WHERE k % 6 = 0),
a AS (SELECT x.doc_id, x.path AS xlsx_path, y.path AS img_path, 2 AS method, x.k FROM r x JOIN r y ON y.doc_id = x.doc_id AND y.k = (SELECT min(k) FROM r z WHERE z.doc_id = x.doc_id AND z.k > x.k) WHERE x.kind = 0 AND y.kind = 1 AND x.k % 6 <> 0)"""


@query("rels", "SELECT p_size AS doc_id, p_partkey AS rel_no, CASE p_partkey % 3 WHEN 0 THEN 'word/embeddings/b' || p_partkey || '.xlsx' WHEN 1 THEN 'word/media/m' || p_partkey || '.png' ELSE 'word/styles.xml' END AS path FROM part")
def rels(spark, sf_dir):
    return relationships(spark, sf_dir).select("doc_id", "rel_no", S.resolve_path(F.col("target")).alias("path"))


@query("ole_pairs", f"WITH {_RELS} SELECT doc_id, xlsx_path, img_path, method FROM o")
def ole_pairs(spark, sf_dir):
    return pairs.ole_pairs(objects(spark, sf_dir), relationships(spark, sf_dir)).drop("ord")


@query("adjacent_pairs", f"WITH {_RELS} SELECT doc_id, xlsx_path, img_path, method FROM a")
def adjacent_pairs(spark, sf_dir):
    rel = relationships(spark, sf_dir)
    return pairs.adjacent_pairs(rel, pairs.ole_pairs(objects(spark, sf_dir), rel)).drop("ord")


@query("all_pairs", f"WITH {_RELS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY method, k)::INT AS pair_no, xlsx_path, img_path, method FROM (SELECT * FROM o UNION ALL SELECT * FROM a)")
def all_pairs(spark, sf_dir):
    return pairs.all_pairs(objects(spark, sf_dir), relationships(spark, sf_dir))


def _package(spark, sf_dir):
    rel = relationships(spark, sf_dir)
    path = S.resolve_path(F.col("target"))
    # packages lack every fifth picture, and every seventh workbook isn't convertible
    parts = rel.where("type = 'image' and rel_no % 5 <> 0").select("doc_id", path.alias("part_path"), F.sha2(path, 256).alias("sha256"))
    tables = rel.where("type = 'package' and rel_no % 7 <> 0").select("doc_id", path.alias("xlsx_path"), F.concat(F.lit("| t |"), "rid").alias("markdown"))
    return pairs.all_pairs(objects(spark, sf_dir), rel), tables, parts


_PREVIEWS = f"""WITH {_RELS}, p AS (SELECT * FROM o UNION ALL SELECT * FROM a), m AS (SELECT doc_id, path AS part_path FROM r WHERE kind = 1 AND k % 5 <> 0),
v AS (SELECT doc_id, img_path AS part_path FROM p WHERE k % 7 <> 0 AND (doc_id, img_path) IN (SELECT (doc_id, part_path) FROM m))"""


@query("table_previews", f"{_PREVIEWS} SELECT * FROM v")
def table_previews(spark, sf_dir):
    return pairs.table_previews(*_package(spark, sf_dir)).select("doc_id", F.col("img_path").alias("part_path"))


@query("plain_images", f"{_PREVIEWS} SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.doc_id = m.doc_id AND v.part_path = m.part_path)")
def plain_images(spark, sf_dir):
    paired, tables, parts = _package(spark, sf_dir)
    return pairs.plain_images(parts, pairs.table_previews(paired, tables, parts)).select("doc_id", "part_path")


_FIFO = """q AS (SELECT s_nationkey AS q, list(s_name ORDER BY s_suppkey) AS names FROM supplier GROUP BY 1),
i AS (SELECT l_partkey AS key, l_partkey % 25 AS q, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS k FROM lineitem)"""


@query("fifo_tables", f"WITH {_FIFO} SELECT key, k::INT AS k, names[least(k, len(names))] AS \"table\" FROM i JOIN q USING (q)")
def fifo_tables(spark, sf_dir):
    queued = pairs.queues(load(spark, sf_dir, "supplier"), ["s_nationkey"], "s_suppkey", "s_name").withColumnRenamed("s_nationkey", "q")
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]
    items = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), (F.col("l_partkey") % 25).alias("q"), *order)
    return pairs.fifo(items, queued, ["key", "q"], order, ["q"]).select("key", "k", F.col("value").alias("table"))


_IMAGES = """i AS (SELECT p_size AS doc_id, p_partkey AS part_no, sha256(p_brand) AS sha256, 'image' || (p_partkey % 4) AS base FROM part),
f AS (SELECT doc_id, base, min(part_no) AS first FROM i GROUP BY 1, 2), w AS (SELECT i.doc_id, i.base, i.sha256 FROM i JOIN f ON f.doc_id = i.doc_id AND f.base = i.base AND f.first = i.part_no),
a AS (SELECT i.doc_id, i.part_no, i.sha256, i.base || CASE WHEN i.sha256 = w.sha256 THEN '' ELSE '_' || i.sha256[:8] END || '.png' AS name FROM i JOIN w ON w.doc_id = i.doc_id AND w.base = i.base)"""


def _named(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    images = part.select(F.col("p_size").alias("doc_id"), F.col("p_partkey").alias("part_no"), F.sha2("p_brand", 256).alias("sha256"), F.concat(F.lit("image"), (F.col("p_partkey") % 4).cast("string")).alias("base"), F.lit(".png").alias("ext"))
    return pairs.asset_names(images)


@query("first_assets", f"WITH {_IMAGES} SELECT doc_id, sha256, arg_min(name, part_no) AS asset FROM a GROUP BY 1, 2")
def first_assets(spark, sf_dir):
    """Of equal images of a document, the first one's name stands for all."""
    return pairs.first_asset(_named(spark, sf_dir))


@query("stem_collisions", "SELECT p_type AS stem, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1 HAVING count(*) > 1")
def stem_collisions(spark, sf_dir):
    from leafmill.operators import batch

    return batch.collisions(load(spark, sf_dir, "part").select(F.col("p_type").alias("stem"), "p_partkey"), "stem", "p_partkey")


@query("asset_names", f"WITH {_IMAGES} SELECT doc_id, part_no, name FROM a")
def asset_names(spark, sf_dir):
    return _named(spark, sf_dir).drop("sha256")


def _placed(spark, sf_dir):
    key = F.concat(F.lit("__TABLE_PLACEHOLDER_"), F.sha2("p_name", 256), F.lit("_0__"))
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit(" ![]("), key, F.lit(") $1 end")).alias("md"), key.alias("key"), F.concat(F.lit("| $0 |\\n"), "p_type").alias("t"))


@query("splice_tables", "SELECT p_partkey AS id, p_brand || ' ' || chr(10) || chr(10) || '| $0 |\\n' || p_type || chr(10) || chr(10) || ' $1 end' AS out FROM part")
def splice_tables(spark, sf_dir):
    return _placed(spark, sf_dir).select("id", pairs.splice(F.col("md"), F.col("key"), F.col("t")).alias("out"))


@query("leftover_check", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1 END::INT AS out FROM part")
def leftover_check(spark, sf_dir):
    md = F.when(F.col("id") % 2 == 0, pairs.splice(F.col("md"), F.col("key"), F.col("t"))).otherwise(F.col("md"))
    return _placed(spark, sf_dir).select("id", pairs.leftovers(md).cast("int").alias("out"))


_DONE, _FAILED = "SELECT DISTINCT doc_id FROM labels", "SELECT doc_id FROM labels WHERE toxic = 1"


def _batch(spark, sf_dir, force):
    docs, labels = load(spark, sf_dir, "documents").select("doc_id"), load(spark, sf_dir, "labels")
    return batch.outcome(batch.plan(docs, labels, "doc_id", force), labels.where("toxic = 1"), "doc_id")


@query("batch_skip", f"SELECT doc_id, CASE WHEN doc_id IN ({_DONE}) THEN 'skipped' ELSE 'ok' END AS status FROM documents")
def batch_skip(spark, sf_dir):
    return _batch(spark, sf_dir, False)


@query("batch_force", f"SELECT doc_id, CASE WHEN doc_id IN ({_FAILED}) THEN 'failed' ELSE 'ok' END AS status FROM documents")
def batch_force(spark, sf_dir):
    return _batch(spark, sf_dir, True)


@query("batch_summary", f"SELECT CASE WHEN doc_id IN ({_DONE}) THEN 'skipped' ELSE 'ok' END AS status, count(*) AS n FROM documents GROUP BY 1")
def batch_summary(spark, sf_dir):
    return batch.summary(_batch(spark, sf_dir, False))


def _added(spark, sf_dir):
    """Documents with two pieces each: a line of their own (every second with its case changed), and one that can't be there."""
    docs = load(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    first = F.get(F.split("text", "\n"), F.lit(0))
    own = F.when(F.col("doc_id") % 2 == 0, first).otherwise(F.concat(F.lit("~"), first))
    return docs.select("doc_id", "text", F.array(F.concat(own, F.lit("\nsecond")), F.lit("~~x\ny")).alias("boxes"), F.array(own, F.lit("~~x^2")).alias("formulas"))


_OWN = "(SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN '' ELSE '~' END || split_part(text, chr(10), 1) AS own FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))"


@query("missing_textbox", f"SELECT doc_id, CASE WHEN contains(text, own) THEN 1 ELSE 2 END::INT AS out FROM {_OWN}")
def missing_textbox(spark, sf_dir):
    return _added(spark, sf_dir).select("doc_id", F.size(appendix.missing_boxes(F.col("text"), F.col("boxes"))).alias("out"))


@query("missing_formula", f"SELECT doc_id, CASE WHEN contains(text, own) THEN 1 ELSE 2 END::INT AS out FROM {_OWN}")
def missing_formula(spark, sf_dir):
    return _added(spark, sf_dir).select("doc_id", F.size(appendix.missing_formulas(F.col("text"), F.col("formulas"))).alias("out"))


def _append_sql(head: str, one: str, two: str) -> str:
    n = "chr(10)"
    return f"SELECT doc_id, text || {n} || {n} || '---' || {n} || {n} || '> **\\[{head}\\]**' || {n} || {n} || CASE WHEN contains(text, own) THEN '' ELSE {one} || {n} || '>' || {n} END || {two} || {n} || '>' || {n} AS out FROM {_OWN}"


@query("append_textbox", _append_sql("文本框内容", "'> ' || own || chr(10) || 'second'", "'> ~~x' || chr(10) || 'y'"))
def append_textbox(spark, sf_dir):
    return _added(spark, sf_dir).select("doc_id", appendix.append_boxes(F.col("text"), F.col("boxes")).alias("out"))


@query("append_formula", _append_sql("数学公式", "'> $$ ' || own || ' $$'", "'> $$ ~~x^2 $$'"))
def append_formula(spark, sf_dir):
    return _added(spark, sf_dir).select("doc_id", appendix.append_formulas(F.col("text"), F.col("formulas")).alias("out"))
