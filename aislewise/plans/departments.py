"""Departments: share of traffic against share of revenue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.functions.labels import efficiency
from aislewise.functions.numeric import money, percent, two_places, zero_if_null
from aislewise.operators.channels import sales_by_department_name, web_department_events
from aislewise.operators.presence import outer_by_key
from aislewise.operators.ranking import total_of, totals_of
from aislewise.sources.relations import RetailTables


def _shares(tables: RetailTables, *volumes: str) -> DataFrame:
    """Unrounded shares of both channels per department, and the volumes asked for.

    A department's revenue is rounded before it is divided by the unrounded total.
    """
    web = web_department_events(tables.weblog)
    store = sales_by_department_name(
        tables.order_items, tables.products, tables.categories, tables.departments
    )
    web_volumes = [name for name in volumes if name in web.columns]
    store_volumes = [name for name in volumes if name in store.columns]
    events, revenue = F.col("web_total_events"), two_places(money("revenue"))
    all_events = total_of(web, "web_total_events", *web_volumes)
    totals = totals_of(store, "revenue", "revenue_rest", *store_volumes)
    all_revenue = F.coalesce(totals["revenue"].cast("double"), F.lit(0.0)) + F.coalesce(
        totals["revenue_rest"], F.lit(0.0)
    )
    joined = outer_by_key(
        web.select("name", "web_total_events", *web_volumes, percent(events, all_events).alias("traffic")),
        store.select(
            "name",
            *store_volumes,
            revenue.alias("store_revenue"),
            percent(revenue, all_revenue).alias("sales"),
        ),
    )
    return joined.select(
        F.col("name").alias("department"),
        *[
            zero_if_null(F.col(name)).alias(name)
            for name in ("web_total_events", "store_revenue", "traffic", "sales", *volumes)
        ],
    )


def dept_traffic_revenue(tables: RetailTables) -> DataFrame:
    """Traffic and revenue per department, and how far their shares are apart."""
    traffic, sales = F.col("traffic"), F.col("sales")
    return (
        _shares(tables, "web_cart_adds", "quantity")
        .select(
            "department",
            "web_total_events",
            "web_cart_adds",
            two_places(traffic).alias("web_traffic_pct"),
            F.col("quantity").alias("store_qty_sold"),
            "store_revenue",
            two_places(sales).alias("revenue_pct"),
            two_places(sales - traffic).alias("revenue_vs_traffic_gap"),
        )
        .orderBy(F.desc("store_revenue"), "department")
    )


def dept_efficiency(tables: RetailTables) -> DataFrame:
    """Departments by the gap, which is classified before it is rounded."""
    gap = F.col("sales") - F.col("traffic")
    return (
        _shares(tables)
        .select("department", two_places(gap).alias("gap"), efficiency(gap).alias("classification"))
        .orderBy(F.desc("gap"), "department")
    )
