"""Every registered query at the smallest scale, against its SQL twin where it has one."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import differences, duck

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert differences(df, con, sql) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_dispatch(spark):
    from packetloom.plans.registry import dispatch

    assert dispatch("node_set", spark, SF_DIR).count() > 0
    with pytest.raises(KeyError, match="unknown query"):
        dispatch("nothing", spark, SF_DIR)
