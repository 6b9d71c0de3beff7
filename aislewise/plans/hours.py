"""Hours of the day: web events against orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.functions.numeric import zero_if_null
from aislewise.operators.channels import WEBLOG_TIME, order_hours, web_hours
from aislewise.operators.presence import outer_by_key
from aislewise.sources.relations import RetailTables


def peak_hours(tables: RetailTables, web_time_format: str = WEBLOG_TIME) -> DataFrame:
    """Events, cart adds and orders per hour; unreadable times form NULL rows."""
    joined = outer_by_key(
        web_hours(tables.weblog, web_time_format), order_hours(tables.orders), "hour_of_day"
    )
    adds, placed = zero_if_null(F.col("web_cart_adds")), zero_if_null(F.col("store_orders"))
    return joined.select(
        "hour_of_day",
        zero_if_null(F.col("web_events")).alias("web_events"),
        adds.alias("web_cart_adds"),
        placed.alias("store_orders"),
        (placed - adds).alias("order_vs_cart_gap"),
    ).orderBy("hour_of_day", "store_orders")


def peak_hours_summary(tables: RetailTables, web_time_format: str = WEBLOG_TIME) -> DataFrame:
    """The busiest hour by each measure; of equals the earlier one."""
    web = web_hours(tables.weblog, web_time_format)
    orders = order_hours(tables.orders).agg(_busiest("store_orders"))
    return web.agg(
        _busiest("web_events").alias("peak_web_hour"),
        _busiest("web_cart_adds").alias("peak_cart_add_hour"),
    ).withColumn("peak_order_hour", orders.scalar())


def _busiest(measure: str) -> Column:
    order = F.struct(F.col(measure), (-F.col("hour_of_day")).alias("earlier"))
    return F.max_by("hour_of_day", order)
