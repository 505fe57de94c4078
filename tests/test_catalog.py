"""Every catalog query against its SQL, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from eventmill.catalog.oracle import statements
from eventmill.catalog.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    from check import connect

    return connect(SF_DIR)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(statements())
    assert set(QUERIES) <= set(entry.queries())


@needs_tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    from check import compare

    assert compare(spark, con, name, SF_DIR) == ""
