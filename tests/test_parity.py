"""Every query against its SQL."""

from __future__ import annotations

import pytest
from retail_rows import retail_queries
from parity import compare, duck

import __spark_entry__ as contract

STATEMENTS = {name: contract.oracle_sql().get(name) for name in retail_queries()}


def test_every_query_has_sql():
    assert all(STATEMENTS.values())


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", list(STATEMENTS))
def test_query_equals_sql(spark, sf_dir, connection, name):
    frame = contract.queries()[name](spark, sf_dir)
    assert compare(frame, connection, STATEMENTS[name]) == []


def test_entry(spark):
    assert contract.entry(spark).count() > 0
