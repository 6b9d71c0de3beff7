"""Documents to packed windows: the stages of a training-data pipeline, each on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislewise.llm import exact_dedup, language_id, near_dedup, packing, quality
from aislewise.llm.queries import BYTE_BPE, documents
from aislewise.llm.work import written


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that some language's model accepts; the models learn from the documents' own languages."""
    return language_id.drop_rejected(docs)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality; the source is the host, and the language the path within it."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.drop_poor(docs, labels, host=F.col("source"), path=F.col("lang"))


def one_of_equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the largest doc_id of each text."""
    return exact_dedup.drop_copies(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group on five-word shingles, at a similarity of 0.8."""
    return near_dedup.drop_near_copies(docs, words=5, percent=80)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 tokens."""
    return packing.pack_documents(docs, BYTE_BPE, capacity=1024, end_id=0)


STAGES = [
    ("language id", languages),
    ("quality", good_documents),
    ("exact dedup", one_of_equal_texts),
    ("near dedup", one_of_near_copies),
    ("packing", windows),
]

#: No SQL expresses the stages; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every other stage is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
