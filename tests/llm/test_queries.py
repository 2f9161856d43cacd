"""Every query for training data over the smallest tables, against its SQL where there is one."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from weftline.llm import queries
from weftline.plans.ship import ship

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_registered():
    assert set(queries.queries()) <= set(entry.queries()) and set(queries.oracle_sql()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", [*queries.queries()])
def test_query(spark, duck, name):
    df = queries.queries()[name](ship(spark), DATA)
    if name not in queries.oracle_sql():
        assert df.count() > 0
        return
    names = sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(*names).collect())))
    cursor = duck.execute(f"SELECT {', '.join(names)} FROM ({queries.oracle_sql()[name]})")
    assert sorted(c[0] for c in cursor.description) == names
    assert got == sorted(map(str, cursor.fetchall()))
