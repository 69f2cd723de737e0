"""Every named query against its SQL statement in a second engine."""

from __future__ import annotations

import os

import pytest
from compare import differences, duck

from ebbtide.plans import catalog

FOLDER = os.environ.get("EBBTIDE_TEST_TABLES", "/root/testdata/sf0.001")
ENTRIES = catalog.load()


@pytest.fixture(scope="module")
def con():
    connection = duck(FOLDER)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query_equals_its_statement(spark, con, name):
    item = ENTRIES[name]
    assert item.sql, "no statement"
    assert differences(item.run(spark, FOLDER), con, item.sql) == ""


def test_driver_contract(spark):
    import __spark_entry__ as entry

    assert set(ENTRIES) <= set(entry.queries()) and set(ENTRIES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
