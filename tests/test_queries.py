import pytest

import __spark_entry__ as entry
from docloom.operators import validation
from docloom.plans import catalog
from docloom.sources.tables import table

from . import oracle

pytestmark = pytest.mark.skipif(not oracle.DATA.exists(), reason="the tables are not on this machine")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(oracle.DATA)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, con, name):
    oracle.compare(spark, con, catalog.QUERIES[name], catalog.SQL[name])


def test_every_query_without_sql_has_a_test_here():
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"chunk_blocks", "chunk_markdown", "chunk_markdown_packed"}


def test_blocks_follow_each_other(spark):
    rows = sorted(catalog.QUERIES["chunk_blocks"](spark, str(oracle.DATA)).collect(), key=lambda r: (r.page_id, r.block))
    assert rows and {r.kind for r in rows} >= {"text", "heading", "code", "table"}
    for a, b in zip(rows, rows[1:]):
        assert (b.block, b.start) == ((a.block + 1, a.end) if a.page_id == b.page_id else (0, 0)) and b.start < b.end


@pytest.mark.parametrize("name", ["chunk_markdown", "chunk_markdown_packed"])
def test_chunks_violate_nothing(spark, name):
    made = catalog.QUERIES[name](spark, str(oracle.DATA)).where("error is null")
    tables = [table(spark, str(oracle.DATA), t) for t in ("wiki_documents", "chunk_settings")]
    assert made.count() > 100 and validation.chunk_violations(made, *tables).collect() == []


def test_entry_has_rows_and_every_sql_a_query(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_nothing_outside_imports_the_subpackage():
    from pathlib import Path

    root = Path(catalog.__file__).resolve().parents[1]
    for file in root.rglob("*.py"):
        assert "llm" in file.relative_to(root).parts or "docloom.llm" not in file.read_text()
