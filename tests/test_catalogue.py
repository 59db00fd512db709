"""Every catalogue query against its SQL on the smallest tables."""
import glob
import os

import pytest

import __spark_entry__ as contract
from feedloom.plans.oracles import ORACLES
from feedloom.plans.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None:
        return "~"
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.items() <= contract.queries().items()
    assert ORACLES.items() <= contract.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, SF_DIR)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    cursor = tables.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    want = sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
    assert got == want


def test_entry(spark):
    assert contract.entry(spark).columns == ["dedup_key", "chunk_no", "also_on"]
