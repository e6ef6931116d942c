"""Every registered query runs; those with a SQL twin give the same rows."""

import pytest

import __spark_entry__ as entry
from tests.parity import compare, oracle

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(FOLDER)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_against_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in entry.oracle_sql()])
def test_runs(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    assert len(df.collect()) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
