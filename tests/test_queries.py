"""Every registered query of the library's own operators against its SQL, and the driver contract."""

import pytest

import __spark_entry__ as entry
from bookspark.plans import codecs, native, oracle, planted

NAMES = [*native.queries(), *codecs.queries(), *planted.queries()]
SQL = oracle.SQL | codecs.oracle_sql() | planted.oracle_sql()


@pytest.mark.parametrize("name", [n for n in NAMES if n in SQL])
def test_same_as_sql(spark, tiny, same_as_sql, name):
    same_as_sql(spark, tiny, entry.queries()[name], SQL[name])


@pytest.mark.parametrize("name", [n for n in NAMES if n not in SQL])
def test_runs(spark, tiny, name):
    assert entry.queries()[name](spark, tiny).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "title" in df.columns


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_page_markdown_of_cut_references(spark, same_as_sql, tmp_path):
    """Headings cut off within a reference, or after one without its semicolon."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    titles = ["a &amp;&amp", "a &copy", "&am", "&amp b", "x &quo", "R&D &amp; B", "5 & 6", "&quot;q&quot", "whole &middot; one"]
    html = [f'<html><body><nav><ul><li><a href="/a?b=1&amp;c=2">n &amp</a></li></ul></nav><h1>{t}</h1><p>{t}</p></body></html>' for t in titles]
    pq.write_table(pa.table({"page_id": pa.array(range(len(html)), pa.int64()), "url": ["http://h/"] * len(html), "html": html}), tmp_path / "pages.parquet")
    same_as_sql(spark, str(tmp_path), entry.queries()["page_markdown"], SQL["page_markdown"])
