"""Every registered query against its SQL, over the whole small tables."""

import oracle
import pytest

import __spark_entry__ as entry
from lorekeep.plans.oracle import ORACLE
from lorekeep.plans.registry import QUERIES

WITHOUT_SQL = {"embed_chunks", "chunk_recursive", "chunk_recursive_500", "retrieve_text", "knn_lsh", "knn_cells"}


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


def test_all_have_sql():
    assert set(QUERIES) - set(ORACLE) == WITHOUT_SQL
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    df = QUERIES[name](spark, small)
    rows = [tuple(r) for r in df.collect()]
    if name in WITHOUT_SQL:
        assert rows
        return
    assert oracle.difference(rows, df.columns, con, ORACLE[name]) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "system_text", "human_text"]
    assert entry.entry(spark).count() > 0
