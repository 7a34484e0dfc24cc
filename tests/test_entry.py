import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from folio.registry import CORE

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"era", "records", "fingerprint"} <= set(rows[0].asDict())


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def shown(value):
    return repr(round(value, 6)) if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name", sorted(CORE.sql))
def test_against_the_oracle(spark, tables, name):
    """Every core query equals its oracle and finds something: equal emptiness would prove nothing."""
    found = tables.execute(CORE.sql[name])
    columns = [c[0] for c in found.description]
    want = sorted(tuple(map(shown, r)) for r in found.fetchall())
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert want and sorted(tuple(map(shown, r)) for r in df.select(*columns).collect()) == want
