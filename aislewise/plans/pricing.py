"""Price tiers: web interest against units sold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.functions.labels import PRICE_CUTS, price_range, verdict
from aislewise.functions.numeric import money, money_sums, ratio, to_double, two_places, zero_if_null
from aislewise.functions.text import name_key
from aislewise.operators.channels import sales_by_product, web_cart_adds
from aislewise.sources.relations import RetailTables


def _tier_totals(
    tables: RetailTables, cuts: tuple[int, ...], count_names_once: bool
) -> DataFrame:
    """Both channels per tier: the web side by product name, the store side by product id.

    Products are folded to (tier, name) and (tier, id) before these meet the web and the
    sales.  Each join then has one row per key, so neither a name that many products
    share nor a repeated id is a hot key, and distinct names and ids are plain rows.
    A name's cart adds count for every product of that name, an id's units for every row.
    """
    price = to_double(F.col("price"))
    shelf = tables.products.where(F.col("price").isNotNull()).select(
        "product_id",
        name_key(F.col("product_name")).alias("name"),
        price.alias("price"),
        price_range(price, cuts).alias("price_range"),
    )
    copies = F.lit(1) if count_names_once else F.col("products")
    web = (
        shelf.groupBy("price_range", "name")
        .agg(
            F.count(F.lit(1)).alias("products"),
            *money_sums(F.col("price"), "price_sum"),
            F.count("price").alias("priced"),
        )
        .join(web_cart_adds(tables.weblog, blank_products=True), "name", "left")
        .groupBy("price_range")
        .agg(
            *[F.sum(name).alias(name) for name in ("price_sum", "price_sum_rest", "priced")],
            F.count("web_cart_adds").alias("web_unique_products"),
            zero_if_null(F.sum(F.col("web_cart_adds") * copies)).alias("web_cart_adds"),
        )
        .withColumn("avg_price", two_places(ratio(money("price_sum"), F.col("priced"))))
    )
    store = (
        shelf.groupBy("price_range", "product_id")
        .agg(F.count(F.lit(1)).alias("copies"))
        .join(sales_by_product(tables.order_items).select("product_id", "quantity"), "product_id")
        .groupBy("price_range")
        .agg(
            F.count(F.lit(1)).alias("store_unique_products"),
            F.sum(F.col("quantity") * F.col("copies")).alias("store_qty_sold"),
        )
    )
    sold = zero_if_null(F.col("store_qty_sold"))
    return web.join(store, "price_range", "left").select(
        "price_range",
        "avg_price",
        "web_unique_products",
        "web_cart_adds",
        zero_if_null(F.col("store_unique_products")).alias("store_unique_products"),
        sold.alias("store_qty_sold"),
        two_places(ratio(F.col("web_cart_adds"), sold)).alias("web_events_per_unit"),
    )


def price_tiers(tables: RetailTables, cuts: tuple[int, ...] = PRICE_CUTS) -> DataFrame:
    """Average price, products and volumes of both channels per tier."""
    return _tier_totals(tables, cuts, count_names_once=False).orderBy("price_range")


def price_tiers_dedup(tables: RetailTables, cuts: tuple[int, ...] = PRICE_CUTS) -> DataFrame:
    """As :func:`price_tiers`, but a name's cart adds count once per tier."""
    return _tier_totals(tables, cuts, count_names_once=True).orderBy("price_range")


def price_tier_verdict(tables: RetailTables, cuts: tuple[int, ...] = PRICE_CUTS) -> DataFrame:
    """Tiers by web events per unit sold; no units sold calls for a review."""
    return (
        _tier_totals(tables, cuts, count_names_once=False)
        .select(
            "price_range",
            "web_events_per_unit",
            verdict(F.col("web_events_per_unit")).alias("verdict"),
        )
        .orderBy("web_events_per_unit", "price_range")
    )
