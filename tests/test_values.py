"""Money that no decimal holds, and times as exports have them."""

from __future__ import annotations

import math

import pytest
from retail_rows import by_key, category, item, page, product, rows
from pyspark.sql import functions as F

from aislewise.functions.numeric import money, money_sums
from aislewise.operators.channels import ORDER_TIME, WEBLOG_TIME, hour_of, order_hours
from aislewise.plans import departments, pricing, products


@pytest.mark.parametrize(
    "values",
    [[1.5e18, 2.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, float("-inf")], [0.1234567891, 2.5], [None, 3.0], [None]],
)
def test_money_is_what_a_double_sum_gives(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    sums = frame.agg(*money_sums(F.col("x"), "m")).select(money("m")).first()[0]
    expected = frame.agg(F.sum("x")).first()[0]
    assert sums == expected or (math.isnan(sums) and math.isnan(expected))


def test_large_money_stays_in_the_reports(make_tables):
    tables = make_tables(
        order_items=[item("1", "1", "1.5e18"), item("1", "1", "2.25"), item("2", "1", "NaN")],
        products=[product("1", name="big", price="1e19"), product("2", name="nan", price="5"), product("3", name="b", price="3e19")],
        categories=[category("1", "c")],
        departments=[{"dept_id": "1", "dept_name": "golf"}],
        weblog=[page("add_to_cart", product="big")],
    )
    revenue = by_key(products.product_presence(tables), "product", "total_revenue")
    assert revenue["big"] == (1.5e18,) and math.isnan(revenue["nan"][0])
    assert math.isnan(rows(departments.dept_traffic_revenue(tables), "store_revenue")[0][0])
    tiers = by_key(pricing.price_tiers(tables), "price_range", "avg_price")
    assert tiers == {"1. $0-$50": (5.0,), "4. $200+": (2e19,)}


@pytest.mark.parametrize(
    ("text", "time_format", "hour"),
    [
        ("2013-07-25 00:00:00.0", ORDER_TIME, 0),
        ("2013-7-5 9:00:00", ORDER_TIME, 9),
        ("2013-07-25 23:59:59", ORDER_TIME, 23),
        (" 2013-07-25 11:00:00 UTC", ORDER_TIME, 11),
        ("2013-02-30 11:00:00", ORDER_TIME, None),
        ("2013-07-25 24:00:00", ORDER_TIME, None),
        ("2013-07-25 11:60:00", ORDER_TIME, None),
        ("2013-07-25", ORDER_TIME, None),
        ("25/07/2013 11:00:00", ORDER_TIME, None),
        ("9/Jun/2014 5:03:01", WEBLOG_TIME, 5),
        ("14/jun/2014 23:30:13", WEBLOG_TIME, 23),
        ("31/Jun/2014 23:30:13", WEBLOG_TIME, None),
        ("14/Foo/2014 23:30:13", WEBLOG_TIME, None),
        ("14/Jun/2014:23:30:13", WEBLOG_TIME, None),
        ("", WEBLOG_TIME, None),
        (None, WEBLOG_TIME, None),
        # An hour that a clock change leaves out somewhere is an hour all the same.
        ("30/Mar/2014 02:30:00", WEBLOG_TIME, 2),
    ],
)
def test_hours(spark, text, time_format, hour):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        frame = spark.createDataFrame([(text,)], "t string")
        assert frame.select(hour_of(F.col("t"), time_format)).first()[0] == hour
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_orders_of_some_statuses(make_tables):
    orders = make_tables(
        orders=[
            {"order_id": "1", "order_date": "2014-07-25 10:00:00", "order_status": "COMPLETE"},
            {"order_id": "2", "order_date": "2014-07-25 10:00:00", "order_status": "closed "},
            {"order_id": "3", "order_date": "2014-07-25 11:00:00", "order_status": "CANCELED"},
        ]
    ).orders
    assert rows(order_hours(orders, statuses=["COMPLETE", "CLOSED"])) == [(10, 2)]
    assert dict(rows(order_hours(orders))) == {10: 2, 11: 1}


def test_missing_rank_may_follow_the_last_row(make_tables):
    tables = make_tables(
        order_items=[item("1", "5"), item("2", "3")],
        products=[product("1", name="a"), product("2", name="b")],
        weblog=[page("add_to_cart", product="c")],
    )
    ranks = by_key(products.product_rank_gap(tables, missing_rank=None), "product", "web_rank", "store_rank")
    assert ranks == {"a": (2, 1), "b": (2, 2), "c": (1, 3)}


@pytest.mark.parametrize("time_format", [ORDER_TIME, WEBLOG_TIME])
def test_exact_times_have_the_hour_of_the_lenient_reading(spark, time_format):
    """Every day of four years, days that do not exist, and clocks at and beyond their limits."""
    months = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec Foo".split()
    clocks = ["00:00:00", "23:59:59", "24:00:00", "12:60:00", "12:59:60", "09:05:61", "1:02:03", "10:11"]
    texts = []
    for number, month in enumerate(months, 1):
        for year in ("2012", "2014", "0000", "9999", "14"):
            for day in range(0, 33):
                clock = clocks[(day + number + len(year)) % len(clocks)]
                date = f"{year}-{number:02}-{day:02}" if time_format == ORDER_TIME else f"{day:02}/{month}/{year}"
                texts.append(f"{date} {clock}")
    frame = spark.createDataFrame([(text,) for text in texts], "t string")
    # A blank before the time calls for the lenient reading.
    hours = frame.select("t", hour_of(F.col("t"), time_format), hour_of(F.concat(F.lit(" "), F.col("t")), time_format))
    found = rows(hours)
    assert [exact for _, exact, _ in found] == [lenient for _, _, lenient in found]
    assert sum(hour is not None for _, hour, _ in found) > 300


def test_exact_times_take_no_lenient_step(spark):
    """The lenient reading is a branch of its own, and never in a common subexpression."""
    frame = spark.range(1).select(F.col("id").cast("string").alias("t"))
    plan = frame.select(hour_of(F.col("t"), ORDER_TIME).alias("h"))._jdf.queryExecution().executedPlan().toString()
    case = plan[plan.index("CASE WHEN") :]
    assert case.index("THEN cast(substring(") < case.index("ELSE") < case.index("split(")
