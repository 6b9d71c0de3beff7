"""Sums that have to agree between reports."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from aislewise.functions.text import title_words
from aislewise.operators.weblog import ADD_TO_CART
from aislewise.plans import categories, departments, funnel, hours, pricing, products


def total(frame, column):
    return frame.agg(F.sum(column)).first()[0]


@pytest.fixture(scope="module")
def facts(storefront):
    weblog = storefront.weblog
    sold = storefront.order_items.join(storefront.products, "product_id")
    shown = F.col("product").isNotNull() & (F.col("product") != "")
    return {
        "adds": weblog.where((F.col("pageType") == ADD_TO_CART) & shown).count(),
        "units": sold.agg(F.sum(F.col("quantity").cast("int"))).first()[0],
        "lines": sold.count(),
        "events": weblog.count(),
    }


def test_cart_adds(storefront, facts):
    assert total(products.product_rank_gap(storefront), "web_cart_adds") == facts["adds"]
    assert total(products.product_presence(storefront), "web_cart_adds") == facts["adds"]
    assert total(departments.dept_traffic_revenue(storefront), "web_cart_adds") == facts["adds"]
    assert total(funnel.funnel_by_category(storefront), "add_to_carts") == facts["adds"]
    assert total(hours.peak_hours(storefront), "web_cart_adds") == facts["adds"]


def test_units_sold(storefront, facts):
    assert total(products.product_rank_gap(storefront), "store_qty_sold") == facts["units"]
    assert total(products.product_presence(storefront), "total_qty_sold") == facts["units"]
    assert total(departments.dept_traffic_revenue(storefront), "store_qty_sold") == facts["units"]
    assert total(pricing.price_tiers(storefront, (925, 950, 975)), "store_qty_sold") == facts["units"]


def test_order_lines(storefront, facts):
    assert total(categories.channel_share(storefront), "store_sales") == facts["lines"]
    assert total(products.product_presence(storefront), "actual_order_lines") == facts["lines"]


def test_events(storefront, facts):
    assert total(hours.peak_hours(storefront), "web_events") == facts["events"]


def test_shares_add_up(storefront):
    shares = categories.channel_share(storefront)
    assert total(shares, "web_pct") == pytest.approx(100, abs=1)
    assert total(shares, "store_pct") == pytest.approx(100, abs=1)
    summary = categories.category_presence_sales_summary(storefront)
    assert total(summary, "pct_of_total") == pytest.approx(100, abs=0.05)


def test_presence_counts(storefront):
    listed = categories.category_presence_sales(storefront).count()
    summary = categories.category_presence_sales_summary(storefront)
    assert total(summary, "category_count") == listed
    assert categories.channel_share(storefront).count() == listed

    coverage = categories.catalog_coverage(storefront).first()
    assert categories.category_presence_catalog(storefront).count() == (
        coverage["both"] + coverage["web_only"] + coverage["catalog_only"]
    )
    flags = products.product_presence_summary(storefront)
    assert total(flags, "product_count") == products.product_presence(storefront).count()


def test_price_tiers_fan_out(storefront, facts):
    plain = total(pricing.price_tiers(storefront), "web_cart_adds")
    once = total(pricing.price_tiers_dedup(storefront), "web_cart_adds")
    assert plain > once and once <= facts["adds"]


def test_tagged_and_clean_presence_agree(storefront):
    """The two ways differ in the spacing of names only."""
    tagged = categories.category_presence_tagged(storefront)
    clean = categories.category_presence_clean(storefront)
    collapsed = clean.select(
        title_words(F.regexp_replace(F.lower("Category"), r"\s+", " ")).alias("category"), "presence"
    )
    assert {tuple(r) for r in tagged.collect()} == {tuple(r) for r in collapsed.collect()}


def test_funnel_total_is_the_sum(storefront):
    per_category = funnel.funnel_by_category(storefront)
    row = funnel.funnel_total(storefront).first()
    assert row["total_product_views"] == total(per_category, "product_views")
    assert row["total_add_to_carts"] == total(per_category, "add_to_carts")
