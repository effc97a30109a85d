import duckdb
import pytest

from lorekeep.llm.oracle import ORACLE
from lorekeep.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = QUERIES[name](spark, small).toPandas()
    want = con.execute(ORACLE[name]).fetchdf()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    left, right = (sorted(map(tuple, x[columns].itertuples(index=False)), key=str) for x in (got, want))
    assert left == right
