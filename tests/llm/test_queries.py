import pytest
from polyquill.llm.queries import QUERIES, SQL

from tests.oracle import connect, rows, sql_rows


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, data):
    assert rows(QUERIES[name](spark, data)) == sql_rows(connect(data), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, data):
    assert QUERIES[name](spark, data).count() > 0


def test_columns(spark, data):
    want = {"p1_found": ["term", "mark"], "p2_found": ["origin", "rec_id", "grp", "item"], "p3_found": ["resp_id", "defect"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "pii_kind", "start_pos"]}
    for name, cols in want.items():
        assert QUERIES[name](spark, data).columns == cols
