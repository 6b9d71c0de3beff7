"""Readers for access logs and header-less CSV relations."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aislewise.sources.counters import PassCounters
from aislewise.sources.relations import PLACE, SCHEMAS, RetailTables

_RAGGED = "_ragged_line"

# --- fixed values -----------------------------------------------------------
# Fewest fields of a usable line in the two jobs that read lines on their own.
MIN_FIELDS_PRESENCE = {"weblog": 6, "products": 3, "categories": 3, "order_items": 3}
MIN_FIELDS_COVERAGE = {"weblog": 7, "products": 3}

FILES = {
    "weblog": "weblog.csv",
    "departments": "departments.csv",
    "categories": "categories.csv",
    "products": "products.csv",
    "customers": "customers.csv",
    "orders": "full_orders.csv",
    "order_items": "full_order_items.csv",
}
# ----------------------------------------------------------------------------


def read_access_log(spark: SparkSession, path: str | list[str], tasks: int | None = None) -> DataFrame:
    """value: one log line per row.

    Files that cannot be split, as compressed ones, are one task each.  ``tasks`` deals the
    lines out to that many, which costs an exchange of the text.
    """
    return spread(spark.read.text(path), tasks)


def spread(source: DataFrame, tasks: int | None) -> DataFrame:
    """The rows dealt out to so many tasks; as they are for None."""
    return source if tasks is None else source.repartition(tasks)


def read_relation(
    spark: SparkSession,
    path: str | list[str],
    relation: str,
    min_fields: int | None = None,
    placed: bool = False,
    counters: PassCounters | None = None,
    **options: str,
) -> DataFrame:
    """A header-less CSV relation; empty fields, quoted or not, are NULL.

    With ``min_fields``, lines with fewer fields are left out, empty ones at the end not
    counted; a longer or shorter line that has enough of them stays, its missing fields
    NULL.  With ``placed``, a further column orders rows as they stand in the files, by the
    file's path, the block's start and the row within it.

    ``counters`` count, under the relation's name, its lines, those too short to be used, and
    those used although their width is not the relation's.  Blank lines are no lines.  Without
    ``min_fields`` all lines are used, and none are counted.
    """
    schema = SCHEMAS[relation]
    more = []
    if placed:
        of_file = [F.col(f"_metadata.{name}") for name in ("file_path", "file_block_start")]
        # Within a block rows are read in order, so a number that grows with them orders them.
        more = [F.struct(*of_file, F.monotonically_increasing_id().alias("row")).alias(PLACE)]
    if min_fields is None:
        return spark.read.schema(schema).options(**options).csv(path, header=False).select("*", *more)
    with_ragged = T.StructType([*schema.fields, T.StructField(_RAGGED, T.StringType())])
    # A parser that skips columns would not notice how many there are.
    rows = (
        spark.read.schema(with_ragged)
        .options(columnPruning=False, **options)
        .csv(path, header=False, mode="PERMISSIVE", columnNameOfCorruptRecord=_RAGGED)
        .select("*", *more)
    )
    # Only lines of an unexpected width carry their text, so only these are counted.
    given = [F.when(F.col(name).isNotNull(), i) for i, name in enumerate(schema.names, 1)]
    width = F.coalesce(field_count(F.col(_RAGGED)), F.greatest(*given))
    if counters is not None:
        used = F.coalesce(width >= min_fields, F.lit(False))
        rows = counters.watch(relation, rows, too_short=~used, other_width=used & F.col(_RAGGED).isNotNull())
    return rows.where(width >= min_fields).drop(_RAGGED)


def field_count(line: Column) -> Column:
    """Fields of a CSV line: commas outside quotes, and one more; none for empty fields at the end."""
    outside_quotes = F.regexp_replace(line, r'"[^"]*"', "_")
    given = F.regexp_replace(outside_quotes, r"[,\r]+$", "")
    return F.length(given) - F.length(F.replace(given, F.lit(","), F.lit(""))) + 1


def read_table(spark: SparkSession, path: str | list[str], relation: str) -> DataFrame:
    """A relation in columnar form, its columns found by name; types may be other than text."""
    paths = [path] if isinstance(path, str) else path
    return spark.read.parquet(*paths).select(*SCHEMAS[relation].names)


def read_retail_folder(
    spark: SparkSession, folder: str, columnar: Collection[str] = (), **paths: str
) -> RetailTables:
    """Tables over a folder with the usual names; any path can be given.

    Relations named in ``columnar`` are Parquet, by default in a folder of the relation's
    name; the others are CSV files.
    """

    def opener(name: str, path: str):
        read = read_table if name in columnar else read_relation
        return lambda: read(spark, path, name)

    return RetailTables(
        {
            name: opener(name, paths.get(name, f"{folder.rstrip('/')}/{name if name in columnar else file}"))
            for name, file in FILES.items()
        }
    )
