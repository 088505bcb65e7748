"""Every registered query against its SQL twin."""

import os

import pytest

import oracle
from querysentry.workload import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    _, rows, verdict = oracle.run(spark, con, name, QUERIES, ORACLES, SF_DIR)
    if name in ORACLES:
        assert verdict == "equal"
    else:
        assert rows > 0


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.entry(spark).columns) == 33
