"""Command line: ``spark-submit`` this package or ``python -m aislewise``."""

from __future__ import annotations

import argparse
from datetime import date

from aislewise.plans import jobs
from aislewise.plans.registry import REPORTS
from aislewise.plans.store import RollupStore
from aislewise.session import build_session
from aislewise.sources.counters import PassCounters
from aislewise.sources.readers import FILES, read_relation, read_retail_folder


def _columnar(command: argparse.ArgumentParser) -> None:
    command.add_argument(
        "--columnar", nargs="+", choices=list(FILES), default=(), help="relations that are Parquet"
    )


def _counts(command: argparse.ArgumentParser) -> None:
    command.add_argument("--counts", action="store_true", help="print how many lines each guard has met")


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="aislewise", description="Web-versus-store retail analytics")
    commands = main.add_subparsers(dest="command", required=True)

    etl = commands.add_parser("etl", help="access log to structured rows")
    etl.add_argument("logs")
    etl.add_argument("output")
    etl.add_argument("--table", action="store_true", help="write a columnar table instead of CSV")
    etl.add_argument("--tasks", type=int, help="deal the lines out to so many tasks (compressed logs)")
    _counts(etl)

    presence = commands.add_parser("presence", help="tagged category presence")
    for name in ("weblog", "order_items", "products", "categories", "output"):
        presence.add_argument(name)
    _columnar(presence)
    _counts(presence)

    coverage = commands.add_parser("coverage", help="product coverage")
    for name in ("weblog", "products", "output"):
        coverage.add_argument(name)
    _columnar(coverage)
    _counts(coverage)

    for command, help_text in (
        ("clean-presence", "category presence on cleaned web categories"),
        ("reports", "all reports, or those named"),
    ):
        tables = commands.add_parser(command, help=help_text)
        tables.add_argument("data", help="folder of the files")
        tables.add_argument("output")
        _columnar(tables)
        for name, file in FILES.items():
            tables.add_argument(f"--{name.replace('_', '-')}", dest=name, help=f"path instead of {file}")
        if command == "reports":
            tables.add_argument("--only", nargs="+", choices=list(REPORTS), metavar="REPORT")
            tables.add_argument("--show", action="store_true", help="print the first rows")
            tables.add_argument("--single-files", action="store_true", help="one CSV file per report")
            tables.add_argument("--store", help="roll-ups to report on, in place of the facts")
            for end in ("first", "last"):
                tables.add_argument(f"--{end}-day", type=date.fromisoformat, help="with --store: web events of some days")

    update = commands.add_parser("update", help="count new log and order-item files into a store of roll-ups")
    update.add_argument("store", help="folder of the roll-ups")
    update.add_argument("--logs", nargs="+", default=(), metavar="PATH")
    update.add_argument("--order-items", nargs="+", default=(), metavar="PATH")
    update.add_argument("--products", metavar="PATH", help="the products as they are now")
    update.add_argument("--buckets", type=int, default=64, help="buckets of sales and products, when the store is made")
    return main


def main(arguments: list[str] | None = None) -> None:
    given = parser().parse_args(arguments)
    spark = build_session()
    counters = PassCounters() if getattr(given, "counts", False) else None
    if given.command == "etl":
        jobs.convert_log(spark, given.logs, given.output, given.table, given.tasks, counters)
    elif given.command == "presence":
        jobs.presence_job(
            spark,
            given.weblog,
            given.order_items,
            given.products,
            given.categories,
            given.output,
            given.columnar,
            counters,
        )
    elif given.command == "coverage":
        jobs.coverage_job(spark, given.weblog, given.products, given.output, given.columnar, counters)
    elif given.command == "update":
        store = RollupStore(spark, given.store, given.buckets)
        products = read_relation(spark, given.products, "products") if given.products else None
        for relation, files in store.update(given.logs, given.order_items, products).items():
            print(f"{relation}: {files} new files")
    else:
        paths = {name: getattr(given, name) for name in FILES if getattr(given, name)}
        tables = read_retail_folder(spark, given.data, given.columnar, **paths)
        if given.command == "reports" and given.store:
            tables = RollupStore(spark, given.store).tables(tables, given.first_day, given.last_day)
        if given.command == "clean-presence":
            jobs.clean_presence_job(tables, given.output)
        else:
            jobs.run_reports(
                spark, tables, given.output, given.only, given.show, given.single_files
            )
    for name, counts in (counters.counts() if counters else {}).items():
        print(f"{name}: " + ", ".join(f"{counter} {lines}" for counter, lines in counts.items()))


if __name__ == "__main__":
    main()
