"""Report files, the structured web log and the console preview."""

from __future__ import annotations

import uuid
from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def write_report(
    report: DataFrame,
    path: str,
    single_file: bool = False,
    quoted_nulls: bool = True,
    two_decimals: Collection[str] = (),
) -> None:
    """CSV with a header, replacing what was there.

    A sorted report is a sequence of part files whose names follow the order.  With
    ``single_file`` the file system joins them to one, so that no task has all rows; one
    that cannot join files gets its file from one task.  NULL is written as ``""`` by default.  Columns in
    ``two_decimals`` always have two places, other doubles as many as they need.
    """
    rows = report_text(report, quoted_nulls, two_decimals)
    if single_file and _joins_files(rows.sparkSession, path):
        _write_joined(rows, path)
    else:
        rows = rows.coalesce(1) if single_file else rows
        rows.write.mode("overwrite").csv(path, header=True)


def _file_system(spark: SparkSession, path: str) -> tuple:
    """A path, and the file system that has it; the local one without its checksums, which cannot be joined."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = found.getFileSystem(spark._jsc.hadoopConfiguration())
    local = files.getUri().getScheme() == "file"
    return found, files, files.getRawFileSystem() if local else files


def _joins_files(spark: SparkSession, path: str) -> bool:
    found, _, raw = _file_system(spark, path)
    return raw.hasPathCapability(found, "fs.capability.paths.concat")


def _write_joined(rows: DataFrame, path: str) -> None:
    """Header-less parts beside ``path``, joined behind a header there, and then put in its place.

    What was at ``path`` stays until the new file is whole.
    """
    spark = rows.sparkSession
    target, files, raw = _file_system(spark, path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{target.getName()}-{uuid.uuid4().hex}")
    try:
        rows.write.csv(folder.toString(), header=False)
        header, one_file = (spark._jvm.org.apache.hadoop.fs.Path(folder, name) for name in ("_header", "part-00000.csv"))
        stream = raw.create(header)
        stream.write(bytearray(_header_line(rows.columns), "utf-8"))
        stream.close()
        found = [part for part in files.listStatus(folder) if part.getPath().getName()[0] != "_"]
        # Beyond 99,999 parts the order of names is not that of their numbers.
        parts = [part.getPath() for part in found if part.getLen()]
        parts.sort(key=lambda part: (int(part.getName().split("-")[1]), part.getName()))
        if raw is files:
            # A name node adds the blocks of the other files to the first one.
            if parts:
                raw.concat(header, _paths(spark, parts))
            raw.rename(header, one_file)
            left = [part.getPath() for part in found if not part.getLen()]
        else:
            raw.concat(one_file, _paths(spark, [header, *parts]))
            left = [header, *[part.getPath() for part in found]]
        for part in left:
            files.delete(part, False)
        files.delete(target, True)
        files.rename(folder, target)
    except BaseException:
        files.delete(folder, True)
        raise


def _paths(spark: SparkSession, paths: list) -> object:
    array = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Path, len(paths))
    for at, path in enumerate(paths):
        array[at] = path
    return array


def _header_line(names: list[str]) -> str:
    """The names as the CSV writer has them: one that needs quotes gets them."""

    def field(name: str) -> str:
        plain = not any(mark in name for mark in ',"\r\n') and name == name.strip() and name != ""
        return name if plain else '"' + name.replace("\\", "\\\\").replace('"', '\\"') + '"'

    return ",".join(map(field, names)) + "\n"


def report_text(
    report: DataFrame, quoted_nulls: bool = True, two_decimals: Collection[str] = ()
) -> DataFrame:
    """The fields of a report's lines, as text."""

    def text(name: str) -> Column:
        column = F.col(name)
        if name in two_decimals:
            column = F.when(column.isNotNull(), F.format_string("%.2f", column))
        # The writer quotes an empty text, and leaves a NULL out.
        column = column.cast("string")
        return (F.coalesce(column, F.lit("")) if quoted_nulls else column).alias(name)

    return report.select(*[text(name) for name in report.columns])


def write_presence_lines(presence: DataFrame, path: str) -> None:
    """Header-less lines of the tagged presence job; a name is quoted if it has a comma."""
    presence.write.mode("overwrite").csv(path, header=False)


def write_weblog_csv(weblog: DataFrame, path: str) -> None:
    """Header-less CSV, every field quoted, one file per task; quotes inside are escaped.

    A line break inside a field, as a decoded URL may have one, is written as a space: the
    readers take a line for a row, so that files can be split.  The columnar form keeps it.
    """
    one_line = [F.translate(name, "\r\n", "  ").alias(name) for name in weblog.columns]
    weblog.select(*one_line).write.mode("overwrite").csv(path, header=False, quoteAll=True)


def write_weblog_table(weblog: DataFrame, path: str) -> None:
    """Columnar form of the web log for the reports."""
    weblog.write.mode("overwrite").parquet(path)


def write_coverage(coverage: DataFrame, path: str) -> None:
    """One header and one row, the percentage always with two decimals."""
    write_report(coverage, path, single_file=True, two_decimals=("catalog_coverage_pct",))


def preview(report: DataFrame, rows: int = 20) -> None:
    """Print the first rows, values in full."""
    report.show(rows, truncate=False)
