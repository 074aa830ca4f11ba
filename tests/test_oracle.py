"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from corpusflow.plans import oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def level(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(map(level, r)) for r in df.select(*cols).collect())
    if name not in oracle_sql():
        assert rows
        return
    got = con.execute(oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted(tuple(level(r[i]) for i in at) for r in got.fetchall())


def test_registry():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["item_id", "chunk_id", "score", "rank"] and df.count() > 0
