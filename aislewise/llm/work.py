"""The shared folder for intermediate tables, and small helpers around it.

A table written there outlives the executors, so nothing upstream of it runs again when one is lost.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one where that is unset."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    own = "file://" + tempfile.mkdtemp(prefix="llm-work-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Has Spark delete a query's shuffle files when the query ends, not when the driver collects its garbage.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again.

    Once the table is written nobody needs the shuffle files on the way to it, so they go: an operator of
    many steps holds the files of one step and its tables.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the table that ``written`` made, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for parent in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_kept: dict[Hashable, object] = {}


def kept_by_worker(key: Hashable, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept for the later tasks of a Python worker until it asks for something else.

    Workers outlive the steps of a job, so a step would otherwise run beside the tables of those before it.
    """
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def with_text(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, the text with null as empty, and the columns named; all others are left out."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more
    )
