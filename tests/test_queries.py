"""Every query of the document operators against its SQL, on the smallest tables."""

import duckdb
import pytest

from leafmill.plans import registry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def rows(found):
    return sorted(map(repr, map(tuple, found)))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_and_sql(spark, sql, name):
    df = registry.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    want = sql.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert rows(df.select(*columns).collect()) == rows(want) and want


def test_queries_without_sql(spark):
    for name in registry.QUERIES.keys() - registry.ORACLES.keys():
        assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 50 and set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_the_entry_imports_without_a_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=root, timeout=120).returncode == 0


#: Queries whose work is done for each of the given rows of a table in as many tasks as these need, not as their bytes do.
DEALT = ["docx_rels", "heading_bookmarks", "formulas", "md_pdf", "md_blocks", "md_block_styles", "docx_assets", "docx_to_md", "picture_assets", "docx_html", "validate_docx", "nested_lists", "html_footnotes", "anchored_headings", "ole_objects", "xlsx_cells", "docx_parts", "textboxes", "table_edges"]


@pytest.mark.parametrize("name", DEALT)
def test_work_is_dealt_by_the_number_of_rows(spark, monkeypatch, name):
    from leafmill.plans import html
    from leafmill.sources import samples

    monkeypatch.setattr(samples, "DOCUMENTS_A_TASK", 4)  # of 10 suppliers
    monkeypatch.setattr(html, "TEXTS_A_TASK", 70)  # of 200 parts
    assert "RoundRobinPartitioning(3)" in registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_written_folders_are_listed_from_their_root(spark):
    """Not folder by folder on the driver, as a pattern of paths is."""
    for name in ("asset_files", "md_files"):
        df = registry.QUERIES[name](spark, SMALL)
        roots = df._jdf.queryExecution().optimizedPlan().collectLeaves().head().relation().location().rootPaths()
        assert roots.size() == 1 and df.count() == 10


@pytest.mark.parametrize("name", ["docx_pairs", "docx_relational"])
def test_packages_are_read_once_for_all_joins(spark, name):
    leaves = registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert {leaves.apply(n).nodeName().split()[0] for n in range(leaves.size())} == {"InMemoryRelation"}
