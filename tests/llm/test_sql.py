"""The corpus queries that have SQL give the rows that DuckDB gives on the same tables."""

import duckdb
import pytest

from corpusflow.llm import queries

SF = "/root/testdata/sf0.01"
TABLES = "documents benchmark conversations"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted(map(str, map(tuple, df.select(*cols).collect()))) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())
