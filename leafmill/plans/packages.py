"""Queries over Word packages: each supplier has one, made on the way. Their contents follow from the table, and so does the SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from leafmill.functions import blocks as B
from leafmill.operators import convert, documents, headings, pairs
from leafmill.plans.html import html_to_md, query, texts
from leafmill.sinks import pdf
from leafmill.sinks.files import write_folders
from leafmill.sources import docx
from leafmill.sources.samples import key_of, supplier_files
from leafmill.streaming import incremental
from leafmill.tables import few_listings, load, shared_folder

N = "chr(10)"


def files(spark, sf_dir, broken=False):
    return supplier_files(load(spark, sf_dir, "supplier"), broken)


def folder(spark, sf_dir, broken=False) -> str:
    """The packages as files in a new folder: in the shared one of the session, or a temporary one where it has none."""
    top = shared_folder(spark).removeprefix("file://")
    if "://" in top:
        raise ValueError("sample packages are written by the tasks themselves, to a folder that all machines mount")
    path = f"{top}/packages-{uuid.uuid4().hex}"
    os.makedirs(path, exist_ok=True)

    def write(frames):
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                part = f"{path}/.{os.path.basename(name)}.{os.getpid()}"
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, f"{path}/{os.path.basename(name)}")
            yield pdf[["path"]]

    files(spark, sf_dir, broken).mapInPandas(write, "path string").count()
    return path


def related(spark, sf_dir, kind):
    return docx.relations(files(spark, sf_dir)).where(F.col("kind") == kind).withColumn("doc_id", key_of())


@query("scan_docx", "SELECT 's' || s_suppkey || '.docx' AS name, 's' || s_suppkey AS stem FROM supplier")
def scan_docx(spark, sf_dir):
    found = convert.with_stem(docx.scan(spark, folder(spark, sf_dir)))
    return found.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "stem")


@query("scan_order", "SELECT 's' || s_suppkey || '.docx' AS name, row_number() OVER (ORDER BY 's' || s_suppkey || '.docx')::INT AS place FROM supplier")
def scan_order(spark, sf_dir):
    """The place of each file in the sorted listing; here, of names alone, one task numbers them."""
    from pyspark.sql import Window

    found = docx.listing(spark, folder(spark, sf_dir)).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"))
    return found.select("name", F.row_number().over(Window.orderBy("name")).alias("place"))


@query(
    "validate_docx",
    "SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 5 = 0 THEN 'BadPackage: not a ZIP file' WHEN s_suppkey % 7 = 0 THEN 'BadPackage: no word/document.xml' END AS error FROM supplier",
)
def validate_docx(spark, sf_dir):
    return docx.converted(files(spark, sf_dir, True)).select(key_of().alias("doc_id"), "error")


@query("docx_parts", "SELECT s_suppkey AS doc_id, p[1]::INT AS part_no, p[2] AS part_path FROM supplier, unnest([['4', 'word/embeddings/book.xlsx'], ['5', 'word/media/preview.emf'], ['6', 'word/media/photo.png']]) AS u(p)")
def docx_parts(spark, sf_dir):
    return docx.parts(files(spark, sf_dir)).select(key_of().alias("doc_id"), "part_no", "part_path")


@query(
    "docx_rels",
    "SELECT s_suppkey AS doc_id, p[1] AS rid, p[2] AS type, CASE p[1] WHEN 'rId3' THEN 'https://example.com/' || s_suppkey ELSE p[3] END AS target FROM supplier, unnest([['rId1', 'package', 'embeddings/book.xlsx'], ['rId2', 'image', 'media/preview.emf'], ['rId3', 'hyperlink', ''], ['rId4', 'image', 'media/photo.png']]) AS u(p)",
)
def docx_rels(spark, sf_dir):
    return related(spark, sf_dir, "rel").select("doc_id", F.col("a").alias("rid"), F.col("b").alias("type"), F.col("c").alias("target"))


@query("ole_objects", "SELECT s_suppkey AS doc_id, 'rId1' AS ole_rid, 'rId2' AS img_rid FROM supplier")
def ole_objects(spark, sf_dir):
    return related(spark, sf_dir, "object").select("doc_id", F.col("b").alias("ole_rid"), F.col("c").alias("img_rid"))


@query("docx_pairs", "SELECT s_suppkey AS doc_id, 1::INT AS pair_no, 'word/embeddings/book.xlsx' AS xlsx_path, 'word/media/preview.emf' AS img_path, 1::INT AS method FROM supplier")
def docx_pairs(spark, sf_dir):
    """The relational pairing over what the packages say."""
    all_rows = docx.relations(files(spark, sf_dir)).where("kind in ('rel', 'object')").withColumn("doc_id", key_of()).persist()  # one parse for all that is joined
    rels = all_rows.where("kind = 'rel'").select("doc_id", F.col("n").alias("rel_no"), F.col("a").alias("rid"), F.col("b").alias("type"), F.col("c").alias("target"))
    objects = all_rows.where("kind = 'object'").select("doc_id", F.col("n").alias("obj_no"), F.col("b").alias("ole_rid"), F.col("c").alias("img_rid"))
    return pairs.all_pairs(objects, rels)


@query("heading_bookmarks", "SELECT s_suppkey AS doc_id, 'heading_1' AS bookmark, 1::INT AS level FROM supplier UNION ALL SELECT s_suppkey, 'heading_2', 2::INT FROM supplier")
def heading_bookmarks(spark, sf_dir):
    rows = related(spark, sf_dir, "bookmark").select("doc_id", F.col("n").alias("p_no"), F.col("a").alias("bookmark"), F.col("b").alias("style_val"), F.col("c").alias("text"))
    return headings.heading_levels(rows)


@query("textboxes", f"SELECT s_suppkey AS doc_id, 'box ' || s_suppkey || {N} || 'more' AS text FROM supplier")
def textboxes(spark, sf_dir):
    return related(spark, sf_dir, "box").select("doc_id", F.col("a").alias("text"))


@query("formulas", "SELECT s_suppkey AS doc_id, 'x=' || s_suppkey AS text FROM supplier")
def formulas(spark, sf_dir):
    return related(spark, sf_dir, "formula").select("doc_id", F.col("a").alias("text"))


@query(
    "xlsx_cells",
    """SELECT s_suppkey AS doc_id, p.sheet AS sheet_no, p.r, p.c, CASE p.v WHEN 'KEY' THEN s_suppkey::VARCHAR WHEN 'BAL' THEN regexp_replace(s_acctbal::VARCHAR, '[.]0$', '') ELSE p.v END AS v FROM supplier,
unnest([{'sheet': 0, 'r': 1, 'c': 1, 'v': 'x'}, {'sheet': 1, 'r': 1, 'c': 1, 'v': 'key'}, {'sheet': 1, 'r': 1, 'c': 2, 'v': 'balance'}, {'sheet': 1, 'r': 1, 'c': 3, 'v': 'memo'}, {'sheet': 1, 'r': 2, 'c': 1, 'v': 'KEY'}, {'sheet': 1, 'r': 2, 'c': 2, 'v': 'BAL'}, {'sheet': 1, 'r': 3, 'c': 1, 'v': 'total'}]) AS u(p)""",
)
def xlsx_cells(spark, sf_dir):
    books = docx.parts(files(spark, sf_dir), ("word/embeddings/",)).where("error is null")
    return docx.xlsx_cells(books).where("ref is null").select(key_of().alias("doc_id"), "sheet_no", "r", "c", "v")


@query(
    "docx_html",
    """SELECT s_suppkey AS doc_id, '<h1><a id="heading_1"></a>' || s_name || '</h1><p><a id="heading_2"></a>Balance &amp; more</p><p><strong>Nation</strong> ' || s_nationkey || ' <a href="https://example.com/' || s_suppkey ||
'">site</a><sup><a href="#footnote-2" id="footnote-ref-2">[1]</a></sup></p><ol><li>first</li><li>k' || s_suppkey || '</li></ol><table><tr><td rowspan="2"><p>n' || s_nationkey || '</p></td><td><p>a|b</p></td></tr><tr><td><p>c</p><p>d</p></td></tr></table>' ||
'<p><img src="__PICTURE_0__" /></p><p><img src="__PICTURE_1__" /></p><ol><li id="footnote-2"><p>Note ' || s_suppkey || '. <a href="#footnote-ref-2">↑</a></p></li></ol>' AS html FROM supplier""",
)
def docx_html(spark, sf_dir):
    return related(spark, sf_dir, "html").select("doc_id", F.col("a").alias("html"))


_MARKDOWN = f"""'# ' || s_name || {N} || {N} || '## Balance & more' || {N} || {N} || '**Nation** ' || s_nationkey || ' [site](https://example.com/' || s_suppkey || ')[^2]' || {N} || {N} || '1. first' || {N} || '2. k' || s_suppkey || {N} || {N} ||
'| n' || s_nationkey || ' | a\\|b |' || {N} || '| --- | --- |' || {N} || '| n' || s_nationkey || ' | c<br>d |' || {N} || {N} || {N} || {N} || '> merge_ranges: A3:B3' || {N} || {N} || '| key | balance | memo |' || {N} || '| --- | --- | --- |' || {N} ||
'| ' || s_suppkey || ' | ' || regexp_replace(s_acctbal::VARCHAR, '[.]0$', '') || ' |  |' || {N} || '| total | total |  |' || {N} || {N} || {N} || {N} || '![](assets/photo.png)' || {N} || {N} || '---' || {N} || {N} || '[^2]: Note ' || s_suppkey || '.' ||
{N} || {N} || '---' || {N} || {N} || '> **\\[文本框内容\\]**' || {N} || {N} || '> box ' || s_suppkey || {N} || 'more' || {N} || '>' || {N} || {N} || {N} || '---' || {N} || {N} || '> **\\[数学公式\\]**' || {N} || {N} || '> $$ x=' || s_suppkey || ' $$' || {N} || '>' || {N}"""


@query("docx_to_md", f"SELECT s_suppkey AS doc_id, 's' || s_suppkey AS stem, {_MARKDOWN} AS markdown FROM supplier")
def docx_to_md(spark, sf_dir):
    return docx.converted(files(spark, sf_dir)).select(key_of().alias("doc_id"), "stem", "markdown")


@query("docx_relational", f"SELECT s_suppkey AS doc_id, {_MARKDOWN} AS markdown FROM supplier")
def docx_relational(spark, sf_dir):
    """The same documents by relational operators alone."""
    return documents.markdown(files(spark, sf_dir)).select(key_of("doc_id").alias("doc_id"), "markdown")


@query("docx_assets", "SELECT s_suppkey AS doc_id, 'photo.png' AS name, (8 + length(s_suppkey::VARCHAR))::INT AS size FROM supplier")
def docx_assets(spark, sf_dir):
    rows = docx.converted(files(spark, sf_dir)).select(key_of().alias("doc_id"), F.explode("assets").alias("a"))
    return rows.select("doc_id", "a.name", F.octet_length("a.content").alias("size"))


_PNG = "unhex('89504E470D0A1A0A')"


@query(
    "picture_assets",
    f"""WITH k AS (SELECT s_suppkey AS doc_id, 'image_' || sha256({_PNG} || ('far' || s_suppkey)::BLOB)[:16] || '.png' AS far, 'a_' || sha256({_PNG} || ('other' || s_suppkey)::BLOB)[:8] || '.png' AS other FROM supplier)
SELECT doc_id, '![](assets/' || far || ')' || {N} || {N} || '![](assets/a.png)' || {N} || {N} || '![](assets/' || other || ')' AS markdown, list_sort(['a.png', 'b.png', far, other]) AS names FROM k""",
)
def picture_assets(spark, sf_dir):
    """A picture outside the media folder takes a name from its digest; of equal ones the first's name counts; a taken name gets a digest."""
    made = docx.converted(supplier_files(load(spark, sf_dir, "supplier"), assets=True))
    return made.select(key_of().alias("doc_id"), "markdown", F.array_sort(F.col("assets.name")).alias("names"))


@query(
    "batch_convert",
    """WITH k AS (SELECT CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 THEN 'failed' ELSE 'ok' END AS s FROM supplier)
SELECT 1::INT AS run, s AS status, count(*) AS n FROM k GROUP BY s UNION ALL SELECT 2, CASE s WHEN 'ok' THEN 'skipped' ELSE s END, count(*) FROM k GROUP BY s UNION ALL SELECT 3, s, count(*) FROM k GROUP BY s""",
)
def batch_convert(spark, sf_dir):
    """A first run, one that skips what is done, and a forced one."""
    path = folder(spark, sf_dir, True)
    out = [convert.run(spark, path, f"{path}-out", force).select(F.lit(n).alias("run"), "*") for n, force in ((1, False), (2, False), (3, True))]
    return out[0].unionAll(out[1]).unionAll(out[2])


@query("incremental_convert", "SELECT 1::INT AS run, count(*) AS n FROM supplier UNION ALL SELECT 2, 0")
def incremental_convert(spark, sf_dir):
    """Two runs of the stream over one folder: the second finds nothing new."""
    path = folder(spark, sf_dir)
    counts = []
    for _ in range(2):
        incremental.convert_new(spark, path, f"{path}-out", f"{path}-marks")
        counts.append(spark.read.parquet(f"{path}-out/*/documents").count() - sum(counts))
    return spark.createDataFrame(list(enumerate(counts, 1)), "run int, n long")


def part_markdown(spark, sf_dir):
    """A Markdown text for each part with every kind of block."""
    line = F.concat(
        F.lit("# "), "p_name", F.lit("\n\n- "), "p_brand", F.lit("\n- **"), "p_type", F.lit("**\n\nsize *"), F.col("p_size").cast("string"), F.lit("* [x](y)\nand < more\n\n| a | b |\n| --- | --- |\n| "),
        "p_brand", F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |\n\n```\ncode "), "p_name", F.lit("\n```\n"),
    )
    return texts(spark, sf_dir).select("p_partkey", line.alias("markdown"))


_BLOCKS = f"""b AS (SELECT p_partkey, u.n AS block_no, CASE u.n WHEN 0 THEN 'h1' WHEN 1 THEN 'bullet' WHEN 2 THEN 'bullet' WHEN 3 THEN 'paragraph' ELSE 'code' END AS kind,
CASE u.n WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN p_type WHEN 3 THEN 'size ' || p_size || ' x' || {N} || 'and < more' WHEN 4 THEN '| a | b |' || {N} || '| ' || p_brand || ' | ' || p_size || ' |' ELSE 'code ' || p_name END AS text FROM part, unnest([0, 1, 2, 3, 4, 5]) AS u(n))"""


@query("md_blocks", f"WITH {_BLOCKS} SELECT p_partkey AS id, block_no, kind, text FROM b")
def md_blocks(spark, sf_dir):
    return B.md_blocks(part_markdown(spark, sf_dir), "p_partkey", "markdown").withColumnRenamed("p_partkey", "id")


@query(
    "md_block_styles",
    f"""WITH {_BLOCKS} SELECT p_partkey AS id, block_no, CASE kind WHEN 'h1' THEN 'title' WHEN 'paragraph' THEN 'normal' ELSE kind END AS style, CASE kind WHEN 'h1' THEN 0.3 WHEN 'bullet' THEN 0.0 ELSE 0.2 END::DOUBLE AS space_after,
CASE kind WHEN 'paragraph' THEN replace(text, '<', '&lt;') WHEN 'bullet' THEN '• ' || text ELSE text END AS text FROM b""",
)
def md_block_styles(spark, sf_dir):
    rows = B.styled(B.md_blocks(part_markdown(spark, sf_dir), "p_partkey", "markdown"))
    return rows.select(F.col("p_partkey").alias("id"), "block_no", "style", "space_after", "text")


@query("md_block_stats", "SELECT k AS kind, n * (SELECT count(*) FROM part) AS n FROM (VALUES ('h1', 1), ('bullet', 2), ('paragraph', 1), ('code', 2)) AS v(k, n)")
def md_block_stats(spark, sf_dir):
    return md_blocks(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "md_pdf",
    f"""SELECT p_partkey AS id, 1::INT AS pages, array_to_string([p_name, '• ' || p_brand, '• ' || p_type, 'size ' || p_size || ' x and < more', '| a | b |', '| ' || p_brand || ' | ' || p_size || ' |', 'code ' || p_name], {N}) AS lines FROM part""",
)
def md_pdf(spark, sf_dir):
    """The pages of each text, and the lines set on them."""
    made = pdf.pdfs(part_markdown(spark, sf_dir), "p_partkey", "markdown")
    return made.select(F.col("p_partkey").alias("id"), "pages", F.array_join(pdf.shown(F.col("content")), "\n").alias("lines"))


@query("md_files", f"SELECT 's' || s_suppkey || '/s' || s_suppkey || '.md' AS file, {_MARKDOWN} AS markdown FROM supplier")
def md_files(spark, sf_dir):
    """Folders written by the tasks, and read again."""
    top = folder_for(spark).removeprefix("file://")
    write_folders(docx.converted(files(spark, sf_dir)), top).count()
    with few_listings(spark):
        texts = spark.read.text(top, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return texts.select(F.regexp_extract(F.input_file_name(), "([^/]+/[^/]+)$", 1).alias("file"), F.col("value").alias("markdown"))


@query("asset_files", "SELECT 's' || s_suppkey || '/assets/photo.png' AS file, (8 + length(s_suppkey::VARCHAR))::BIGINT AS size FROM supplier")
def asset_files(spark, sf_dir):
    top = folder_for(spark).removeprefix("file://")
    write_folders(docx.converted(files(spark, sf_dir)), top).count()
    with few_listings(spark):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(top).select("path", "length")
    return found.where(F.col("path").rlike("/assets/[^/]+$")).select(F.regexp_extract("path", "([^/]+/assets/[^/]+)$", 1).alias("file"), F.col("length").alias("size"))


@query("page_blocks")
def page_blocks(spark, sf_dir):
    """The blocks of the pages' Markdown."""
    return B.md_blocks(html_to_md(spark, sf_dir), "page_id", "markdown")


@query("read_md", f"SELECT p_size AS id, count(*) AS n, sum(length(p_name) + 2)::BIGINT AS chars FROM part GROUP BY 1")
def read_md(spark, sf_dir):
    """Markdown files, one for each size of part, written and read whole."""
    top = folder_for(spark)
    rows = load(spark, sf_dir, "part").select("p_size", F.concat(F.lit("\n\n"), "p_name").alias("value"))
    rows.repartition("p_size").write.partitionBy("p_size").text(top)
    texts = spark.read.text(top, wholetext=True).groupBy(F.col("p_size").cast("int").alias("id"))
    body = F.regexp_replace("value", "\n", "")
    return texts.agg(F.sum(F.size(F.split("value", "\n\n")) - 1).cast("long").alias("n"), F.sum(F.length(body) + 2 * (F.size(F.split("value", "\n\n")) - 1)).cast("long").alias("chars"))


def folder_for(spark) -> str:
    return f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
