from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from aislewise.session import build_session  # noqa: E402
from aislewise.sources.relations import SCHEMAS, RetailTables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[8]", shuffle_partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def storefront(spark, sf_dir):
    from aislewise.sources.storefront import storefront_tables

    return storefront_tables(spark, sf_dir)


@pytest.fixture
def make_tables(spark):
    """Tables of all-text relations from dictionaries; columns left out are NULL."""

    def build(**relations) -> RetailTables:
        frames = {}
        for name, schema in SCHEMAS.items():
            rows = [
                tuple(row.get(column) for column in schema.names) for row in relations.get(name, [])
            ]
            frames[name] = spark.createDataFrame(rows, T.StructType(schema.fields))
        return RetailTables({name: (lambda f=frame: f) for name, frame in frames.items()})

    return build
