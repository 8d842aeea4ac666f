"""Every registered query beside its SQL on the smallest tables."""

import os

import pytest

from workload.check import compare, connect
from workload.registry import oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_all_queries_have_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, duck, name):
    ok, note = compare(spark, duck, name, queries()[name], oracle_sql().get(name), SF)
    assert ok, note
