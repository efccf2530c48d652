import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import problems, registry
from verify import canonical

SQL = problems.SQL | registry.SQL
QUERIES = problems.QUERIES | registry.QUERIES


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, db, data, name):
    got, want = canonical(QUERIES[name](spark, data).toPandas()), canonical(db.execute(SQL[name]).df())
    assert got.equals(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["src_ip", "first_us", "last_us", "occurrence_count", "max_confidence", "ports", "hosts"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
