"""Every registered query against the SQL that states its result."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from timberline.plans.catalog import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query(spark, duck, name):
    found = contract.queries()[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted(repr(tuple(r)) for r in found.select(*[f"`{c}`" for c in columns]).collect())
    expected = duck.execute(f'SELECT {", ".join(chr(34) + c + chr(34) for c in columns)} FROM ({contract.oracle_sql()[name]})')
    assert [TYPES[t] for t in dict(sorted(found.dtypes)).values()] == [str(d[1]) for d in expected.description]
    assert rows == sorted(repr(tuple(r)) for r in expected.fetchall())


def test_flagship_entry(spark):
    assert contract.entry(spark).columns == ["start", "group", "count"]
