"""Jobs from files to files: the log conversion, the two line jobs, all reports."""

from __future__ import annotations

import uuid
from collections.abc import Collection, Iterable

from pyspark.sql import SparkSession

from aislewise.operators.channels import rollup_of
from aislewise.operators.rollups import sales_activity, web_activity
from aislewise.operators.weblog import parse_access_log
from aislewise.plans.categories import category_presence_clean, category_presence_tagged
from aislewise.plans.products import product_coverage
from aislewise.plans.registry import REPORTS
from aislewise.sources.counters import PassCounters
from aislewise.sources.readers import (
    MIN_FIELDS_COVERAGE,
    MIN_FIELDS_PRESENCE,
    read_access_log,
    read_relation,
    read_table,
)
from aislewise.sources.relations import RetailTables
from aislewise.sources.sinks import (
    preview,
    write_coverage,
    write_presence_lines,
    write_report,
    write_weblog_csv,
    write_weblog_table,
)


def convert_log(
    spark: SparkSession,
    logs: str,
    output: str,
    as_table: bool = False,
    tasks: int | None = None,
    counters: PassCounters | None = None,
) -> None:
    """Access log to structured rows, as header-less CSV or as a columnar table."""
    weblog = parse_access_log(read_access_log(spark, logs, tasks), counters=counters)
    if as_table:
        write_weblog_table(weblog, output)
    else:
        write_weblog_csv(weblog, output)


def presence_job(
    spark: SparkSession,
    weblog: str,
    order_items: str,
    products: str,
    categories: str,
    output: str,
    columnar: Collection[str] = (),
    counters: PassCounters | None = None,
) -> None:
    """Tagged category presence over CSV lines of sufficient width, without a header."""
    paths = {
        "weblog": weblog,
        "order_items": order_items,
        "products": products,
        "categories": categories,
    }
    tables = _line_tables(spark, paths, MIN_FIELDS_PRESENCE, columnar, counters)
    write_presence_lines(category_presence_tagged(tables), output)


def coverage_job(
    spark: SparkSession,
    weblog: str,
    products: str,
    output: str,
    columnar: Collection[str] = (),
    counters: PassCounters | None = None,
) -> None:
    """Product coverage over CSV lines of sufficient width."""
    paths = {"weblog": weblog, "products": products}
    tables = _line_tables(spark, paths, MIN_FIELDS_COVERAGE, columnar, counters)
    write_coverage(product_coverage(tables), output)


def clean_presence_job(tables: RetailTables, output: str) -> None:
    """Category presence on cleaned web categories, with a header."""
    write_report(category_presence_clean(tables), output)


def _line_tables(
    spark: SparkSession,
    paths: dict[str, str],
    min_fields: dict[str, int],
    columnar: Collection[str],
    counters: PassCounters | None,
) -> RetailTables:
    """CSV relations with the places of their rows, so that the last of a repeated id counts.

    Relations named in ``columnar`` are Parquet, which has no lines and no width: nothing is
    counted of them.
    """

    def opener(name: str, path: str):
        if name in columnar:
            return lambda: read_table(spark, path, name)
        return lambda: read_relation(spark, path, name, min_fields[name], placed=True, counters=counters)

    return RetailTables({name: opener(name, path) for name, path in paths.items()})


def rolled_up(
    spark: SparkSession,
    tables: RetailTables,
    folder: str,
    facts: Collection[str] = ("weblog", "order_items"),
) -> RetailTables:
    """The tables with the facts named replaced by roll-ups, written below ``folder``.

    The facts are read once for any number of reports.  The roll-ups are files, so the
    loss of an executor costs nothing but the tasks that ran on it.
    """
    make = {"weblog": web_activity, "order_items": sales_activity}
    replaced = {}
    for name in facts:
        path = f"{folder.rstrip('/')}/{name}"
        make[name](getattr(tables, name)).write.parquet(path)
        replaced[name] = spark.read.parquet(path)
    return tables.replaced(**replaced)


def working_folder(spark: SparkSession, otherwise: str) -> str:
    """The shared folder that the cluster names for checkpoints, if it names one."""
    return spark.conf.get("spark.checkpoint.dir", None) or otherwise


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run_reports(
    spark: SparkSession,
    tables: RetailTables,
    output: str,
    names: Iterable[str] | None = None,
    show: bool = False,
    single_files: bool = False,
) -> None:
    """Save every report below ``output``; print them as well if asked to.

    Only the facts that the reports named read are rolled up, where they are not already,
    and the roll-ups go when the reports are written.  Reports whose size may grow with the data are saved as a sequence
    of part files, unless ``single_files`` asks for one file each.
    """
    chosen = [REPORTS[name] for name in (REPORTS if names is None else names)]
    read = [name for name in ("weblog", "order_items") if any(name in r.reads for r in chosen)]
    facts = [name for name in read if rollup_of(getattr(tables, name)) is None]
    work = working_folder(spark, f"{output.rstrip('/')}/_work").rstrip("/")
    run = f"{work}/rollups-{uuid.uuid4().hex}"
    try:
        source = rolled_up(spark, tables, run, facts)
        for report in chosen:
            # Both uses of a report that is shown share one run of it.
            frame = report.build(source).persist() if show else report.build(source)
            write_report(
                frame,
                f"{output.rstrip('/')}/{report.saved_as}",
                single_file=single_files or report.few_rows,
                two_decimals=report.two_decimals,
            )
            if show:
                preview(frame, report.preview_rows)
                frame.unpersist()
    finally:
        _delete(spark, run)
