"""A Spark session with the settings the reports rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    app_name: str = "aislewise", master: str | None = None, shuffle_partitions: int | None = None
) -> SparkSession:
    """Session with adaptive execution and splitting of skewed join partitions.

    Settings that the cluster already has for size (executors, memory, partitions) are
    left alone; ``master`` and ``shuffle_partitions`` are for local runs.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Saves the client a stack trace for every column expression it builds.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master is not None:
        builder = builder.master(master).config("spark.ui.enabled", "false")
        builder = builder.config("spark.ui.showConsoleProgress", "false")
        builder = builder.config("spark.driver.memory", "12g")
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
