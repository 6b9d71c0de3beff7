"""The log conversion on a stream of files equals the batch one."""

from __future__ import annotations

from retail_rows import rows
from test_weblog import CASES

from aislewise.operators.weblog import parse_access_log
from aislewise.streaming.weblog_stream import append_to_table, weblog_stream


def test_stream_equals_batch(spark, tmp_path):
    lines = [text for text, _ in CASES if text]
    logs, table = tmp_path / "logs", str(tmp_path / "table")
    logs.mkdir()
    for number, part in enumerate((lines[:10], lines[10:])):
        (logs / f"{number}.log").write_text("\n".join(part) + "\n")
        stream = weblog_stream(spark, str(logs))
        append_to_table(stream, table, str(tmp_path / "checkpoint")).awaitTermination(60)
    batch = parse_access_log(spark.createDataFrame([(text,) for text in lines], "value string"))
    assert sorted(rows(spark.read.parquet(table)), key=repr) == sorted(rows(batch), key=repr)
