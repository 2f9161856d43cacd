"""Every query of the core over the smallest tables against its SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from weftline.plans import catalogue
from weftline.plans.ship import ship

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in catalogue.queries() if n in catalogue.oracle_sql()])
def test_query(spark, duck, name):
    df = catalogue.queries()[name](ship(spark), DATA)
    names = sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(*names).collect())))
    cursor = duck.execute(f"SELECT {', '.join(names)} FROM ({catalogue.oracle_sql()[name]})")
    assert sorted(c[0] for c in cursor.description) == names
    assert got == sorted(map(str, cursor.fetchall()))


@pytest.mark.parametrize("name", [n for n in catalogue.queries() if n not in catalogue.oracle_sql()])
def test_query_runs(spark, name):
    assert catalogue.queries()[name](ship(spark), DATA).count() > 0
