"""Every registered query against its SQL on the smallest test tables."""

import os

import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    if name in SQL:
        assert compare(df, con, SQL[name]) == []
    else:  # compared with brute force in its own tests; the smallest tables may hold nothing to find
        assert len(df.collect()) >= 0 and df.columns


def test_every_statement_has_its_query():
    assert set(SQL) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
