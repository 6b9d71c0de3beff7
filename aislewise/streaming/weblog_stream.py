"""Log conversion as files arrive.

The parser keeps no state and needs no shuffle, so it runs on a stream as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from aislewise.operators.weblog import parse_access_log


def weblog_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Structured rows of log files that are put into a folder."""
    return parse_access_log(spark.readStream.text(folder))


def append_to_table(weblog: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, exactly once per file, and end; run again for what follows."""
    return (
        weblog.writeStream.format("parquet")
        .outputMode("append")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
