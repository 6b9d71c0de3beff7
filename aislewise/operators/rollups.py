"""Additive roll-ups that let all reports share one pass over the facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.operators.channels import (
    WEBLOG_TIME,
    day_of,
    hits,
    hour_of,
    marked_rollup,
    sales_by_product,
    summed_sales,
)


def web_activity(weblog: DataFrame, time_format: str = WEBLOG_TIME, by_day: bool = False) -> DataFrame:
    """Page events counted per department, category, product, page type, status and hour.

    Visitor, day and minute go, the day unless it is asked for.  Every report keeps its
    result, as all of them count events.  The grouping folds repeats before the exchange,
    hot products included.
    """
    days = [day_of(F.col("datetime"), time_format).alias("day")] if by_day else []
    return weblog.groupBy(
        "dept",
        "category",
        "product",
        "pageType",
        "respCode",
        F.col("datetime").isNotNull().alias("has_datetime"),
        hour_of(F.col("datetime"), time_format).alias("hour_of_day"),
        *days,
    ).agg(marked_rollup(hits(weblog), "hits", time_format))


def sales_activity(order_items: DataFrame) -> DataFrame:
    """Order items per product id."""
    by_product = sales_by_product(order_items)
    return by_product.withColumn("order_rows", marked_rollup(F.col("order_rows"), "order_rows", "product"))


def merged_sales(batches: DataFrame) -> DataFrame:
    """Roll-ups of several sets of order items, one behind the other, as one roll-up."""
    merged = summed_sales(batches, F.col("product_id"))
    return merged.withColumn("order_rows", marked_rollup(F.col("order_rows"), "order_rows", "product"))
