"""Every core query runs; those with SQL give the same rows in DuckDB."""

import pytest
from polyquill.plans import CATALOGS

from tests.oracle import connect, rows, sql_rows

QUERIES = {n: q for c in CATALOGS for n, q in c.QUERIES.items()}
SQL = {n: q for c in CATALOGS for n, q in c.SQL.items()}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, data, con):
    assert rows(QUERIES[name](spark, data)) == sql_rows(con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, data):
    assert QUERIES[name](spark, data).count() >= 0


def test_no_sql_without_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


def test_nothing_outside_imports_llm():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "polyquill"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "polyquill.llm" not in f.read_text(), f
