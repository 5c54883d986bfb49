import os

import duckdb
import pytest

import __spark_entry__ as E
from tools_compare import canon

FOLDER = "/root/testdata/sf0.001"
CORE = {k: q for m in E.CORE for k, q in m.QUERIES.items()}
ORACLE = {k: s for m in E.CORE for k, s in m.SQL.items()}


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        p = f"{FOLDER}/{f}"
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def test_entry(spark, con):
    assert E.entry(spark).count() > 0
    assert set(CORE) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, con, name):
    got, want = CORE[name](spark, FOLDER).toPandas(), con.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)
