"""Every corpus query with SQL equals it on the small tables."""

import duckdb
import pytest

from panelwise.llm.catalog import QUERIES, SQL
from tools.compare import NAMES, rows_of

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for n in NAMES:
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{FOLDER}/{n}.parquet'")
    return c


@pytest.mark.parametrize("key", list(SQL))
def test_query_equals_sql(spark, con, key):
    df = QUERIES[key](spark, FOLDER)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(SQL[key])
    assert mine == rows_of([c[0] for c in res.description], res.fetchall())
