"""From product view to cart, checkout and add-to-cart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.functions.numeric import percent, two_places
from aislewise.functions.text import is_given, name_key
from aislewise.operators.channels import hits
from aislewise.operators.weblog import ADD_TO_CART, CHECKOUT, OK_STATUS, PRODUCT, VIEW_CART
from aislewise.sources.relations import RetailTables

# --- fixed values -----------------------------------------------------------
FUNNEL_PAGES = (PRODUCT, VIEW_CART, CHECKOUT, ADD_TO_CART)
# ----------------------------------------------------------------------------


def _funnel_events(tables: RetailTables) -> DataFrame:
    return tables.weblog.where(
        F.col("pageType").isin(*FUNNEL_PAGES)
        & (F.col("respCode") == OK_STATUS)
        & is_given(F.col("category"))
    )


def _step_counts(events: DataFrame, *names: str) -> list[Column]:
    return [
        hits(events, F.col("pageType") == page).alias(name)
        for page, name in zip(FUNNEL_PAGES, names)
    ]


def _step_rate(reached: str, started: str, name: str) -> Column:
    return two_places(percent(F.col(reached), F.col(started))).alias(name)


def funnel_by_category(tables: RetailTables) -> DataFrame:
    """Steps per category; a step that nobody started has no rate."""
    events = _funnel_events(tables)
    steps = ("product_views", "cart_views", "checkouts", "add_to_carts")
    return (
        events.groupBy(name_key(F.col("category")).alias("category"))
        .agg(*_step_counts(events, *steps))
        .select(
            "category",
            *steps,
            _step_rate("cart_views", "product_views", "pct_view_to_cart"),
            _step_rate("checkouts", "cart_views", "pct_cart_to_checkout"),
            _step_rate("add_to_carts", "checkouts", "pct_checkout_to_add"),
        )
        .orderBy(F.desc("add_to_carts"), "category")
    )


def funnel_total(tables: RetailTables) -> DataFrame:
    """Steps over all categories, one row."""
    events = _funnel_events(tables)
    steps = ("total_product_views", "total_cart_views", "total_checkouts", "total_add_to_carts")
    return events.agg(*_step_counts(events, *steps)).select(
        *steps,
        _step_rate("total_cart_views", "total_product_views", "overall_view_to_cart_pct"),
        _step_rate("total_checkouts", "total_cart_views", "overall_cart_to_checkout_pct"),
        _step_rate("total_add_to_carts", "total_checkouts", "overall_checkout_to_add_pct"),
    )
