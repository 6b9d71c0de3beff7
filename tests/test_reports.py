"""Small fixtures for the corners of the reports."""

from __future__ import annotations

import pytest
from retail_rows import by_key, category, item, page, product, rows

from aislewise.plans import categories, departments, funnel, hours, pricing, products
from aislewise.plans.registry import REPORTS


def test_names_shared_by_categories_are_merged(make_tables):
    tables = make_tables(
        weblog=[page("category", " Accessories ")],
        categories=[category("22", "Accessories", "4"), category("27", "ACCESSORIES", "5")],
        products=[product("1", "22"), product("2", "27")],
        order_items=[item("1"), item("2"), item("2")],
    )
    assert rows(categories.channel_share(tables), "category", "web_events", "store_sales") == [
        ("accessories", 1, 3)
    ]
    assert rows(categories.category_presence_catalog(tables)) == [
        ("accessories", "Both (Web & Catalog)")
    ]


def test_presence_labels(make_tables):
    tables = make_tables(
        weblog=[page("product", "web"), page("add_to_cart", "both"), page("department", "other")],
        categories=[category("1", "Both"), category("2", "Store"), category("3", "Unsold")],
        products=[product("1", "1"), product("2", "2"), product("3", "3")],
        order_items=[item("1"), item("2"), item("99")],
    )
    assert rows(categories.category_presence_sales(tables)) == [
        ("both", "Both (Web & Store)"),
        ("store", "Store Only"),
        ("web", "Web Only"),
    ]
    assert rows(categories.category_presence_sales_summary(tables)) == [
        ("Both (Web & Store)", 1, 33.33),
        ("Store Only", 1, 33.33),
        ("Web Only", 1, 33.33),
    ]
    assert rows(categories.catalog_coverage(tables)) == [(1, 1, 2, 2, 3, 33.33)]


def test_blank_category_of_spaces_is_a_category(make_tables):
    tables = make_tables(weblog=[page("product", "  "), page("product", ""), page("product", None)])
    assert rows(categories.category_presence_sales(tables)) == [("", "Web Only")]


def test_display_names(make_tables):
    tables = make_tables(
        weblog=[
            page("category", "as seen on  TV!"),
            page("category", "indoor/outdoor games/product/o'brien/add_to_cart"),
            page("category", "trade-in/add_to_cart"),
        ],
    )
    assert rows(categories.category_presence_clean(tables), "Category") == [
        ("As Seen On  Tv!",), ("Indoor/outdoor Games",), ("Trade-in",),
    ]
    assert rows(categories.category_presence_tagged(tables), "category") == [
        ("As Seen On Tv!",), ("Indoor/outdoor Games",), ("Trade-in",),
    ]


def test_fragment_cut_prefers_product(make_tables):
    tables = make_tables(weblog=[page("category", "a/add_to_cart/product/x")])
    assert rows(categories.category_presence_clean(tables), "Category") == [("A/add_to_cart",)]


def test_tagged_lookup_keeps_the_last_of_repeated_ids(spark, make_tables):
    tables = make_tables(
        categories=[category("1", "old"), category("1", "new")],
        products=[product("7", "2"), product("7", "1")],
        order_items=[item(" 7 "), item("7")],
    )
    one_file = tables.replaced(
        categories=tables.categories.coalesce(1), products=tables.products.coalesce(1)
    )
    assert rows(categories.category_presence_tagged(one_file)) == [("New", "Store Only")]


def test_tagged_page_type_ignores_case_and_space(make_tables):
    tables = make_tables(weblog=[page(" Product\t", "Golf Balls"), page("home", "x"), page("product", " ")])
    assert rows(categories.category_presence_tagged(tables)) == [("Golf Balls", "Web Only")]


def test_top5_breaks_ties_by_name(make_tables):
    names = ["f", "b", "d", "a", "e", "c"]
    tables = make_tables(weblog=[page("category", name) for name in names])
    assert rows(categories.channel_share_top5(tables), "category") == [(n,) for n in "abcde"]
    gaps = make_tables(weblog=[page("add_to_cart", "c", name) for name in names])
    assert rows(products.product_rank_gap_top5(gaps)) == [(n, 1, 9999, 9998) for n in "abcde"]


def test_rank_leaves_gaps_after_ties(make_tables):
    adds = {"a": 3, "b": 2, "c": 2, "d": 1}
    tables = make_tables(
        weblog=[page("add_to_cart", "c", name) for name, n in adds.items() for _ in range(n)],
        products=[product("1", name="A"), product("2", name="z")],
        order_items=[item("1", "5"), item("2", "9.0")],
    )
    report = by_key(
        products.product_rank_gap(tables), "product", "web_rank", "store_qty_sold", "store_rank", "rank_gap"
    )
    assert report == {
        "a": (1, 5, 2, 1),
        "b": (2, 0, 9999, 9997),
        "c": (2, 0, 9999, 9997),
        "d": (4, 0, 9999, 9995),
        "z": (9999, 9, 1, -9998),
    }
    sentinel = by_key(products.product_rank_gap(tables, missing_rank=-1), "product", "web_rank")
    assert sentinel["z"] == (-1,)


def test_product_presence(make_tables):
    tables = make_tables(
        weblog=[page("add_to_cart", "c", "Kayak")] * 3 + [page("add_to_cart", "c", "free 5.0 ")],
        products=[product("1", name="kayak "), product("2", name="Free 5.0+"), product("3", name="bad")],
        order_items=[
            item("1", "2", "10.10"), item("1", "1", "5.05"), item("2", "4", "x"), item("3", "no", "1"),
            item("1", "3", "0.005", item_id=None), item("9", "9", "9"),
        ],
    )
    columns = (
        "web_cart_adds", "actual_order_lines", "total_qty_sold", "avg_qty_per_order", "total_revenue",
        "web_events_per_unit_sold", "cart_to_order_pct", "presence",
    )
    assert by_key(products.product_presence(tables), "product", *columns) == {
        "kayak": (3, 2, 6, 2.0, 15.16, 0.5, 66.67, "Both (Web & Store)"),
        "free 5.0": (1, 0, 0, 0.0, 0.0, None, 0.0, "Web Only (abandoned)"),
        "free 5.0+": (0, 1, 4, 4.0, 0.0, 0.0, None, "Store Only"),
        "bad": (0, 1, 0, 0.0, 1.0, None, None, "Store Only"),
    }
    assert by_key(products.product_presence_summary(tables), "presence", "product_count") == {
        "Both (Web & Store)": (1,),
        "Store Only": (2,),
        "Web Only (abandoned)": (1,),
    }


def test_product_coverage(make_tables):
    tables = make_tables(
        weblog=[page("product", "c", "A"), page("home", "", "\tb "), page("home", "", " ")],
        products=[product("1", name="a"), product("2", name="C"), product("3", name="c")],
    )
    assert rows(products.product_coverage(tables)) == [(1, 1, 1, 2, 2, 50.0)]


def test_department_gap_of_two_is_balanced(make_tables):
    """52 / 48 events against 50 / 50 revenue: gaps of exactly -2 and 2."""
    depts = [{"dept_id": str(i), "dept_name": name} for i, name in enumerate(("Golf", "Fitness"))]

    def tables(golf_events, other_events):
        return make_tables(
            weblog=[page("home", dept="golf")] * golf_events + [page("home", dept="FITNESS")] * other_events,
            departments=depts,
            categories=[category("1", "a", "0"), category("2", "b", "1")],
            products=[product("1", "1"), product("2", "2")],
            order_items=[item("1", "1", "10"), item("2", "1", "10")],
        )

    assert by_key(departments.dept_efficiency(tables(52, 48)), "department", "gap", "classification") == {
        "golf": (-2.0, "Balanced"),
        "fitness": (2.0, "Balanced"),
    }
    assert by_key(departments.dept_efficiency(tables(53, 47)), "department", "gap", "classification") == {
        "golf": (-3.0, "Underperforming (high traffic, low revenue)"),
        "fitness": (3.0, "Efficient (high revenue, low web need)"),
    }
    traffic = departments.dept_traffic_revenue(tables(52, 48))
    assert by_key(traffic, "department", "web_total_events", "web_traffic_pct", "revenue_pct") == {
        "golf": (52, 52.0, 50.0),
        "fitness": (48, 48.0, 50.0),
    }


def test_funnel_needs_a_category(make_tables):
    tables = make_tables(
        weblog=[page("product", "Golf")] * 2 + [page("add_to_cart", "golf ")]
        + [page("view_cart"), page("checkout"), page("category", "golf")]
        + [{**page("product", "golf"), "respCode": "404"}],
    )
    assert rows(funnel.funnel_by_category(tables)) == [("golf", 2, 0, 0, 1, 0.0, None, None)]
    assert rows(funnel.funnel_total(tables)) == [(2, 0, 0, 1, 0.0, None, None)]


def test_price_boundaries_go_to_the_upper_tier(make_tables):
    prices = ["49.99", "50", "100", "200", "n/a", None]
    tables = make_tables(products=[product(str(i), name=str(i), price=p) for i, p in enumerate(prices)])
    report = by_key(pricing.price_tiers(tables), "price_range", "avg_price")
    assert report == {
        "1. $0-$50": (49.99,),
        "2. $50-$100": (50.0,),
        "3. $100-$200": (100.0,),
        "4. $200+": (200.0,),
    }


def test_price_tier_fan_out_and_distinct_counts(make_tables):
    tables = make_tables(
        weblog=[page("add_to_cart", "c", "ball")] * 5,
        products=[
            product("1", name="Ball", price="10"), product("2", name="ball", price="20"),
            product("3", name="BALL", price="60"), product("4", name="bat", price="30"),
            product("4", name="bat two", price="40"),
        ],
        order_items=[item("1", "2"), item("4", "1"), item("3", "4")],
    )
    columns = ("web_unique_products", "web_cart_adds", "store_unique_products", "store_qty_sold")
    assert by_key(pricing.price_tiers(tables), "price_range", *columns, "web_events_per_unit") == {
        "1. $0-$50": (1, 10, 2, 4, 2.5),
        "2. $50-$100": (1, 5, 1, 4, 1.25),
    }
    assert by_key(pricing.price_tiers_dedup(tables), "price_range", *columns) == {
        "1. $0-$50": (1, 5, 2, 4),
        "2. $50-$100": (1, 5, 1, 4),
    }
    assert by_key(pricing.price_tier_verdict(tables), "price_range", "verdict") == {
        "1. $0-$50": ("Review Needed",),
        "2. $50-$100": ("Review Needed",),
    }
    unsold = tables.replaced(order_items=tables.order_items.limit(0))
    assert set(rows(pricing.price_tier_verdict(unsold), "web_events_per_unit", "verdict")) == {
        (None, "Review Needed")
    }
    unseen = tables.replaced(weblog=tables.weblog.limit(0))
    assert set(rows(pricing.price_tier_verdict(unseen), "verdict")) == {("Best Converter",)}


def test_unreadable_hours_are_two_rows(make_tables):
    tables = make_tables(
        weblog=[page("home", datetime="junk"), page("add_to_cart", "c", "p"), page("home", datetime=None)],
        orders=[{"order_date": "2014-07-25 00:00:00"}, {"order_date": "soon"}, {"order_date": None}],
    )
    assert sorted(rows(hours.peak_hours(tables)), key=repr) == sorted(
        [(None, 1, 0, 0, 0), (None, 0, 0, 1, 1), (0, 0, 0, 1, 1), (23, 1, 1, 0, -1)], key=repr
    )


def test_peak_hours_summary(make_tables):
    tables = make_tables(
        weblog=[
            page("home", datetime="14/Jun/2014 05:00:00"), page("home", datetime="14/Jun/2014 04:00:00"),
            page("add_to_cart", "c", "p", datetime="14/Jun/2014 09:00:00"),
        ],
        orders=[{"order_date": "2014-07-25 07:00:00"}],
    )
    assert rows(hours.peak_hours_summary(tables)) == [(4, 9, 7)]


@pytest.mark.parametrize("name", list(REPORTS))
def test_no_data(make_tables, name):
    """Only the one-row reports have rows without data."""
    result = rows(REPORTS[name].build(make_tables()))
    expected = {
        "catalog_coverage": [(None,) * 6],
        "funnel_total": [(0, 0, 0, 0, None, None, None)],
        "peak_hours_summary": [(None, None, None)],
    }
    assert result == expected.get(name, [])


def test_no_data_in_coverage(make_tables):
    assert rows(products.product_coverage(make_tables())) == [(0, 0, 0, 0, 0, 0.0)]
