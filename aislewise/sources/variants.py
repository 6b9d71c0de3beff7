"""Forms of the test tables that real exports have and the plain tables lack."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aislewise.operators.weblog import parse_access_log
from aislewise.plans.jobs import working_folder
from aislewise.plans.store import RollupStore
from aislewise.sources.counters import PassCounters
from aislewise.sources.readers import MIN_FIELDS_PRESENCE, read_relation, spread
from aislewise.sources.relations import PLACE, RetailTables
from aislewise.sources.storefront import access_log, storefront_tables

# Lines of all widths: full, empty at the end, short, too short, and too long.
_PRODUCT_LINE = """
    CASE p_partkey % 6
      WHEN 0 THEN concat_ws(',', p_partkey, p_brand, p_name, p_type, p_retailprice, 'u')
      WHEN 1 THEN concat_ws(',', p_partkey, p_brand, '', '', '', '')
      WHEN 2 THEN concat(p_partkey, ',', p_brand, ',"', p_name, ', boxed"')
      WHEN 3 THEN concat_ws(',', p_partkey, p_brand)
      WHEN 4 THEN concat_ws(',', p_partkey, p_brand, p_name, '', '', '', '', 'x')
      ELSE concat('"', p_partkey, ',0",', p_brand, ',,,')
    END"""


# Lines that match no request, and lines with something before the visitor.
_UNTIDY_LINE = """
    CASE length(value) % 7
      WHEN 0 THEN replace(value, ' HTTP/', ' FTP/')
      WHEN 1 THEN concat('proxy ', value)
      ELSE value END AS value"""


def untidy_order_dates(tables: RetailTables) -> RetailTables:
    """Order dates with a fraction, or with fields of one digit."""
    date = F.col("order_date")
    short = F.regexp_replace(date, r"([-: ])0(\d)", "$1$2")
    untidy = F.when(F.col("order_id") % 2 == 0, F.concat(date, F.lit(".0"))).otherwise(short)
    return tables.replaced(orders=tables.orders.withColumn("order_date", untidy))


def repeated_ids(tables: RetailTables) -> RetailTables:
    """Look-ups in which some ids come twice, the second time with something else."""

    def twice(relation: DataFrame, which: Column, column: str, again: Column) -> DataFrame:
        first = F.struct(F.lit(1).alias(PLACE), F.col(column).alias("value"))
        second = F.struct(F.lit(2).alias(PLACE), again.alias("value"))
        entries = F.when(which, F.array(second, first)).otherwise(F.array(first))
        rows = relation.withColumn("_entry", F.explode(entries))
        return rows.withColumn(column, F.col("_entry.value")).withColumn(PLACE, F.col(f"_entry.{PLACE}")).drop("_entry")

    moved = F.col("product_id") % 3 == 0
    renamed = F.length("cat_id") % 2 == 0
    return tables.replaced(
        products=twice(tables.products, moved, "cat_id", F.lit("none")),
        categories=twice(tables.categories, renamed, "cat_name", F.concat(F.lit("New "), "cat_name")),
    )


def products_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_id, cat_id, product_name of lines wide enough, written as text and read again."""
    read = read_relation(spark, _product_lines(spark, sf_dir), "products", MIN_FIELDS_PRESENCE["products"], placed=True)
    return read.select("product_id", "cat_id", "product_name")


def _product_lines(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a text file of product lines."""
    folder = f"{working_folder(spark, '/tmp')}/product-lines-{uuid.uuid4().hex}"
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    part.selectExpr(f"{_PRODUCT_LINE} AS value").write.text(folder)
    return folder


def lines_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, counter, lines: what the pass over a log and over product lines, neither tidy, keeps and drops."""
    counters = PassCounters()
    events, part = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("events", "part"))
    log = access_log(spread(events, spark.sparkContext.defaultParallelism), part).selectExpr(_UNTIDY_LINE)
    products = read_relation(
        spark, _product_lines(spark, sf_dir), "products", MIN_FIELDS_PRESENCE["products"], counters=counters
    )
    for rows in (parse_access_log(log, counters=counters), products):
        rows.write.format("noop").mode("overwrite").save()
    found = [(source, *count) for source, counts in counters.counts().items() for count in counts.items()]
    return spark.createDataFrame(found, "source string, counter string, lines long")


def stored_rollups(spark: SparkSession, sf_dir: str, buckets: int = 8) -> RetailTables:
    """The facts as files that arrive over three runs, counted into a store of roll-ups that the reports read."""
    folder = f"{working_folder(spark, '/tmp')}/store-{uuid.uuid4().hex}"
    tables = storefront_tables(spark, sf_dir)
    events, part = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("events", "part"))
    logs, items = f"{folder}/logs", f"{folder}/order_items"
    lines = access_log(events, part)
    lines.withColumn("arrival", F.pmod(F.xxhash64("value"), F.lit(3))).write.partitionBy("arrival").text(logs)
    arrival = F.pmod(F.xxhash64("order_id"), F.lit(2))
    tables.order_items.withColumn("arrival", arrival).write.partitionBy("arrival").parquet(items)

    store = RollupStore(spark, f"{folder}/rollups", buckets)
    all_logs = [f"{logs}/arrival={n}" for n in range(3)]
    all_items = [f"{items}/arrival={n}" for n in range(2)]
    store.update(logs=all_logs[:1], products=tables.products)
    store.update(logs=all_logs[:2], order_items=all_items[:1], columnar=True)
    # A run is given all there is, and reads what is new.
    store.update(logs=all_logs, order_items=all_items, columnar=True)
    return store.tables(tables)
