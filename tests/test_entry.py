import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from panelwise.catalog import QUERIES
from tools.compare import NAMES, rows_of

FOLDER = "/root/testdata/sf0.001"
KEYS = list(QUERIES)
#: Models of several columns and exact tests of several rows: compared with brute force in test_study_models.
WITHOUT_SQL = {"study_trends", "study_baseline_predictors", "study_one_row_fisher"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for n in NAMES:
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{FOLDER}/{n}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(KEYS) - WITHOUT_SQL <= set(entry.oracle_sql()) and set(KEYS) <= set(entry.queries())


def test_a_missing_package_leaves_the_other_queries():
    code = "import sys, warnings; warnings.simplefilter('ignore'); sys.modules['xxhash'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=entry.__file__.rpartition("/")[0])
    assert int(out.stdout) == len(KEYS)


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["num_positive", "pct", "n", "lower", "upper"] and out.count() == 1


@pytest.mark.parametrize("key", [k for k in KEYS if k not in WITHOUT_SQL])
def test_query_equals_sql(spark, con, key):
    df = entry.queries()[key](spark, FOLDER)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(entry.oracle_sql()[key])
    assert mine == rows_of([c[0] for c in res.description], res.fetchall())
