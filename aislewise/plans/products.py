"""Products by web interest and by sales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.functions.labels import MISSING_RANK, PRODUCT_LABELS
from aislewise.functions.numeric import money, percent, ratio, two_places, zero_if_null
from aislewise.functions.text import is_given, line_key
from aislewise.operators.channels import sales_by_product_name, web_cart_adds, web_product_keys
from aislewise.operators.presence import outer_by_key, tagged_presence
from aislewise.operators.ranking import rank_descending
from aislewise.sources.relations import RetailTables


def product_coverage(tables: RetailTables) -> DataFrame:
    """One row: products seen on any web page against products of the catalog."""
    catalog = tables.products.select(line_key(F.col("product_name")).alias("name")).where(
        is_given(F.col("name"))
    )
    in_web, in_store = F.col("in_web"), F.col("in_store")
    counts = tagged_presence(web_product_keys(tables.weblog), catalog).agg(
        F.count_if(in_web & in_store).alias("both"),
        F.count_if(in_web & ~in_store).alias("web_only"),
        F.count_if(~in_web).alias("store_only"),
    )
    in_catalog = F.col("both") + F.col("store_only")
    return counts.select(
        "both",
        "web_only",
        "store_only",
        (F.col("both") + F.col("web_only")).alias("total_web_products"),
        in_catalog.alias("total_db_products"),
        two_places(zero_if_null(percent(F.col("both"), in_catalog))).alias("catalog_coverage_pct"),
    )


def _ranked(tables: RetailTables, missing_rank: int | None) -> DataFrame:
    """``missing_rank`` is given to products that a channel lacks; None is one past its last row."""

    def missing(channel: DataFrame) -> Column:
        if missing_rank is not None:
            return F.lit(missing_rank)
        return channel.agg(F.count(F.lit(1)) + 1).scalar()

    web = web_cart_adds(tables.weblog)
    store = sales_by_product_name(tables.order_items, tables.products).select(
        "name", F.col("quantity").alias("store_qty_sold")
    )
    joined = outer_by_key(
        rank_descending(web, "web_cart_adds", "web_rank"),
        rank_descending(store, "store_qty_sold", "store_rank"),
    )
    return joined.select(
        F.col("name").alias("product"),
        zero_if_null(F.col("web_cart_adds")).alias("web_cart_adds"),
        F.coalesce("web_rank", missing(web)).alias("web_rank"),
        zero_if_null(F.col("store_qty_sold")).alias("store_qty_sold"),
        F.coalesce("store_rank", missing(store)).alias("store_rank"),
        "in_web",
    )


def product_rank_gap(tables: RetailTables, missing_rank: int | None = MISSING_RANK) -> DataFrame:
    """Rank by cart adds against rank by units sold."""
    return (
        _ranked(tables, missing_rank)
        .withColumn("rank_gap", F.col("store_rank") - F.col("web_rank"))
        .drop("in_web")
        .orderBy(F.desc("web_cart_adds"), "product")
    )


def product_rank_gap_top5(tables: RetailTables, missing_rank: int | None = MISSING_RANK) -> DataFrame:
    """The five products on the web whose ranks differ most; ties go by name."""
    return (
        _ranked(tables, missing_rank)
        .where("in_web")
        .select(
            "product",
            "web_rank",
            "store_rank",
            F.abs(F.col("store_rank") - F.col("web_rank")).alias("abs_gap"),
        )
        .orderBy(F.desc("abs_gap"), "product")
        .limit(5)
    )


def _web_and_sales(tables: RetailTables) -> DataFrame:
    return outer_by_key(
        web_cart_adds(tables.weblog), sales_by_product_name(tables.order_items, tables.products)
    )


def product_presence(tables: RetailTables) -> DataFrame:
    """Cart adds, order lines, units, revenue and two ratios per product name."""
    average = two_places(ratio(F.col("quantity"), F.col("quantity_rows")))
    adds, lines = zero_if_null(F.col("web_cart_adds")), zero_if_null(F.col("order_lines"))
    return (
        _web_and_sales(tables)
        .select(
            F.col("name").alias("product"),
            adds.alias("web_cart_adds"),
            lines.alias("actual_order_lines"),
            zero_if_null(F.col("quantity")).alias("total_qty_sold"),
            zero_if_null(average).alias("avg_qty_per_order"),
            zero_if_null(two_places(money("revenue"))).alias("total_revenue"),
            two_places(ratio(adds, F.col("quantity"))).alias("web_events_per_unit_sold"),
            two_places(percent(lines, F.col("web_cart_adds"))).alias("cart_to_order_pct"),
            PRODUCT_LABELS.of(F.col("in_web"), F.col("in_store")).alias("presence"),
        )
        .orderBy(F.desc("total_revenue"), "product")
    )


def product_presence_summary(tables: RetailTables) -> DataFrame:
    """Products and revenue per presence."""
    sums = [F.sum(name).alias(name) for name in ("revenue", "revenue_rest")]
    revenue = zero_if_null(money("revenue"))
    return (
        _web_and_sales(tables)
        .groupBy(PRODUCT_LABELS.of(F.col("in_web"), F.col("in_store")).alias("presence"))
        .agg(
            F.count(F.lit(1)).alias("product_count"), *sums
        )
        .select(
            "presence",
            "product_count",
            two_places(revenue).alias("total_revenue"),
            two_places(ratio(revenue, F.col("product_count"))).alias("avg_revenue_per_product"),
        )
        .orderBy(F.desc("total_revenue"), "presence")
    )
