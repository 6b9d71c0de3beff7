"""All reports by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from aislewise.plans import categories, departments, funnel, hours, pricing, products


@dataclass(frozen=True)
class Report:
    """A report, the folder it is saved in, what it reads, and how much the console shows.

    ``few_rows`` says that the number of rows does not grow with the data, so one output
    file is in order.  ``two_decimals`` are columns written with two places throughout.
    """

    build: Callable[..., DataFrame]
    saved_as: str
    reads: tuple[str, ...]
    preview_rows: int = 20
    few_rows: bool = False
    two_decimals: tuple[str, ...] = ()


WEB = ("weblog",)
SALES = ("order_items", "products")
CATEGORY_SALES = (*SALES, "categories")
DEPARTMENT_SALES = (*CATEGORY_SALES, "departments")

# --- fixed values -----------------------------------------------------------
# Folder names that begin with "analysis", and the columns with two places.
REPORTS: dict[str, Report] = {
    "category_presence_sales": Report(
        categories.category_presence_sales, "analysis1a_web_vs_store_sales", WEB + CATEGORY_SALES, 50
    ),
    "category_presence_sales_summary": Report(
        categories.category_presence_sales_summary,
        "analysis1a_summary",
        WEB + CATEGORY_SALES,
        few_rows=True,
        two_decimals=("pct_of_total",),
    ),
    "category_presence_catalog": Report(
        categories.category_presence_catalog, "analysis1b_web_vs_catalog", (*WEB, "categories"), 50
    ),
    "catalog_coverage": Report(
        categories.catalog_coverage,
        "analysis1b_summary",
        (*WEB, "categories"),
        few_rows=True,
        two_decimals=("catalog_coverage_pct",),
    ),
    "channel_share": Report(
        categories.channel_share,
        "analysis2_sales_proportions",
        WEB + CATEGORY_SALES,
        50,
        two_decimals=("web_pct", "store_pct", "pct_difference"),
    ),
    "channel_share_top5": Report(
        categories.channel_share_top5,
        "channel_share_top5",
        WEB + CATEGORY_SALES,
        few_rows=True,
        two_decimals=("web_pct", "store_pct", "pct_difference"),
    ),
    "product_rank_gap": Report(products.product_rank_gap, "analysis3a_product_rank", WEB + SALES),
    "product_rank_gap_top5": Report(
        products.product_rank_gap_top5, "product_rank_gap_top5", WEB + SALES, few_rows=True
    ),
    "product_presence": Report(products.product_presence, "analysis3b_product_presence", WEB + SALES),
    "product_presence_summary": Report(
        products.product_presence_summary, "product_presence_summary", WEB + SALES, few_rows=True
    ),
    "dept_traffic_revenue": Report(
        departments.dept_traffic_revenue,
        "analysis4_dept_traffic_vs_revenue",
        WEB + DEPARTMENT_SALES,
        two_decimals=("web_traffic_pct",),
    ),
    "dept_efficiency": Report(departments.dept_efficiency, "dept_efficiency", WEB + DEPARTMENT_SALES),
    "funnel_by_category": Report(
        funnel.funnel_by_category,
        "analysis5_funnel_per_category",
        WEB,
        50,
        two_decimals=("pct_view_to_cart", "pct_cart_to_checkout", "pct_checkout_to_add"),
    ),
    "funnel_total": Report(
        funnel.funnel_total,
        "funnel_total",
        WEB,
        few_rows=True,
        two_decimals=(
            "overall_view_to_cart_pct",
            "overall_cart_to_checkout_pct",
            "overall_checkout_to_add_pct",
        ),
    ),
    "price_tiers": Report(pricing.price_tiers, "analysis6_price_influence", WEB + SALES, few_rows=True),
    "price_tier_verdict": Report(
        pricing.price_tier_verdict, "price_tier_verdict", WEB + SALES, few_rows=True
    ),
    "peak_hours": Report(hours.peak_hours, "analysis7_peak_hours", (*WEB, "orders"), 24, few_rows=True),
    "peak_hours_summary": Report(
        hours.peak_hours_summary, "peak_hours_summary", (*WEB, "orders"), few_rows=True
    ),
}
# ----------------------------------------------------------------------------
