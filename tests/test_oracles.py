"""Every query with SQL against DuckDB, as the driver does."""

import math
import os

import duckdb
import pytest

from marginalia import registry

SF = "/root/testdata/sf0.001"


def plain(x):
    if x is None or isinstance(x, (str, bool)):
        return x
    x = float(x)
    return None if math.isnan(x) else round(x, 6)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, SF)
    want = db.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    at = [want.columns.index(c) for c in cols]
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())
