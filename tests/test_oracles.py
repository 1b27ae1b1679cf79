"""Every registered query against its SQL on the smallest sample tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle_check import compare, views

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables are absent")


@pytest.fixture(scope="module")
def connection():
    return views(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, connection, name):
    _, difference = compare(spark, connection, FOLDER, name, queries()[name], oracle_sql().get(name))
    assert difference is None


def test_entry(spark):
    assert entry(spark).columns == ["source", "target", "weight"]
