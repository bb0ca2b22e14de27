"""Registered queries against their SQL twins at the smallest scale."""

import pytest

from compare import differences, duck

from leafwork.catalog.registry import REGISTRY

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_equals_sql(spark, con, name):
    run, sql = REGISTRY[name]
    assert sql, "every query has a SQL twin"
    assert differences(spark, con, run, sql, SMALL) is None


def test_entry_point():
    import __spark_entry__ as entry

    assert set(REGISTRY) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
