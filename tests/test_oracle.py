"""Every registered query against its checking SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from veritally.plans import catalog
from tools.check import compare, connect

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    status, _, _, note = compare(spark, con, name, catalog.queries()[name], catalog.oracle_sql().get(name), SF_DIR)
    assert status in ("ok", "rows"), f"{status}: {note}"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_but_the_file_listing_has_sql():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"file_digests"}
