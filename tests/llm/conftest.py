from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers import SCHEMA, awkward_documents  # noqa: E402


@pytest.fixture(scope="session")
def make_docs(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def awkward_rows():
    return awkward_documents()


@pytest.fixture(scope="session")
def awkward(make_docs, awkward_rows):
    return make_docs(awkward_rows).repartition(3).cache()


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return sorted(map(tuple, rows))
