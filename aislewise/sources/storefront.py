"""The retail model over the order, line-item, part and event tables of the test data.

========================  ====================================================
relation                  made from
========================  ====================================================
departments               distinct part types
categories                distinct (type, brand) pairs of parts; a brand whose
                          number divides by 5 gives one slash-bearing name that
                          all types share, any other gives ``TYPE Brand#n``
products                  parts; every seventh name ends in ``+``
orders, order_items       orders and line items
customers                 customers
access log                one line per event, for the part its ``props.k`` names
========================  ====================================================
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislewise.operators.weblog import parse_access_log
from aislewise.sources.readers import spread
from aislewise.sources.relations import RetailTables

_CATEGORY_ID = "concat_ws('|', p_type, p_brand)"
_CATEGORY_NAME = """
    if(try_cast(substring_index(p_brand, '#', -1) AS int) % 5 = 0,
       replace(p_brand, '#', '/'),
       concat_ws(' ', p_type, p_brand))"""
_PRODUCT_NAME = "concat(p_name, ' ', p_brand, if(p_partkey % 7 = 0, '+', ''))"
_LOG_LINE = """
    concat(
      '10.', shiftright(user_id, 16) % 256, '.', shiftright(user_id, 8) % 256, '.', user_id % 256,
      ' - - [', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] "GET ',
      CASE
        WHEN event_type = 'signup' THEN
          CASE event_id % 3 WHEN 0 THEN '/view_cart' WHEN 1 THEN '/checkout' ELSE '/home' END
        ELSE replace(replace(
          concat(
            '/department/', p_type,
            if(event_type = 'click' AND event_id % 2 = 1, '', concat('/category/', cat_name)),
            if(event_type = 'click', '', concat('/product/', product_name)),
            if(event_type = 'purchase', '/add_to_cart', '')),
          '#', '%23'), ' ', '%20')
      END,
      if(event_type = 'error', ' HTTP/1.1" 500', ' HTTP/1.1" 200'), ' 1063 "-" "Mozilla/5.0"')"""


def storefront_tables(spark: SparkSession, sf_dir: str, log_tasks: int | None = None) -> RetailTables:
    """The relations over a folder of tables; ``log_tasks`` deals the log's lines out."""

    @cache
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    return RetailTables(
        {
            "weblog": lambda: parse_access_log(access_log(spread(table("events"), log_tasks), table("part"))),
            "departments": lambda: departments(table("part")),
            "categories": lambda: categories(table("part")),
            "products": lambda: products(table("part")),
            "customers": lambda: customers(table("customer")),
            "orders": lambda: orders(table("orders")),
            "order_items": lambda: order_items(table("lineitem")),
        }
    )


def departments(part: DataFrame) -> DataFrame:
    return part.selectExpr("p_type AS dept_id", "p_type AS dept_name").distinct()


def categories(part: DataFrame) -> DataFrame:
    return (
        part.select("p_type", "p_brand")
        .distinct()
        .selectExpr(
            f"{_CATEGORY_ID} AS cat_id", "p_type AS dept_id", f"{_CATEGORY_NAME} AS cat_name"
        )
    )


def products(part: DataFrame) -> DataFrame:
    return part.selectExpr(
        "p_partkey AS product_id",
        f"{_CATEGORY_ID} AS cat_id",
        f"{_PRODUCT_NAME} AS product_name",
        "CAST(NULL AS string) AS product_desc",
        "p_retailprice AS price",
        "CAST(NULL AS string) AS product_url",
    )


def customers(customer: DataFrame) -> DataFrame:
    unknown = ("lname", "email", "password", "street", "city")
    return customer.selectExpr(
        "c_custkey AS customer_id",
        "c_name AS fname",
        *[f"CAST(NULL AS string) AS {name}" for name in unknown],
        "CAST(c_nationkey AS string) AS state",
        "CAST(NULL AS string) AS zipcode",
    )


def orders(orders_table: DataFrame) -> DataFrame:
    return orders_table.selectExpr(
        "o_orderkey AS order_id",
        "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') AS order_date",
        "o_custkey AS customer_id",
        "o_orderstatus AS order_status",
    )


def order_items(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber) AS item_id",
        "l_orderkey AS order_id",
        "l_partkey AS product_id",
        "l_quantity AS quantity",
        "l_extendedprice AS subtotal",
        "round(l_extendedprice / nullif(l_quantity, 0), 2) AS unit_price",
    )


def access_log(events: DataFrame, part: DataFrame) -> DataFrame:
    """value: an access-log line per event; a page of a part that is missing has none.

    Parts have one row per key.  Spark broadcasts them when their size, which it knows
    from the files, is below its limit; otherwise it shuffles both sides and splits the
    partitions of hot parts at run time.
    """
    shown = events.selectExpr(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "try_cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) AS shown_part",
    )
    parts = part.selectExpr(
        "p_partkey", "p_type", f"{_CATEGORY_NAME} AS cat_name", f"{_PRODUCT_NAME} AS product_name"
    )
    joined = shown.join(parts, F.col("shown_part") == F.col("p_partkey"), "left")
    return joined.selectExpr(f"{_LOG_LINE} AS value").where("value IS NOT NULL")
