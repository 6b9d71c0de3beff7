"""Every branch of the log conversion, and a brute-force answer for odd lines."""

from __future__ import annotations

import random
import re
from urllib.parse import unquote_plus

import pytest
from pyspark.sql import functions as F

from aislewise.operators.weblog import (
    CATEGORY_REQUEST,
    DEPARTMENT_REQUEST,
    PAGE_REQUEST,
    PRODUCT_REQUEST,
    VISIT,
    WEBLOG_COLUMNS,
    parse_access_log,
)

TIME = "14/Jun/2014 23:30:13"


def line(path, status=200, user="-"):
    return (
        f'1.2.3.4 - {user} [14/Jun/2014:23:30:13 -0400] "GET {path} HTTP/1.1" {status} 1063 "-" "UA"'
    )


def parse(spark, lines):
    frame = spark.createDataFrame([(text,) for text in lines], "value string")
    return [tuple(row) for row in parse_access_log(frame).collect()]


PRODUCT_URL = "/department/fan%20shop/category/water%20sports/product/kayak"

CASES = [
    (line(PRODUCT_URL), ("fan shop", "water sports", "kayak", "product")),
    (line(PRODUCT_URL + "/add_to_cart"), ("fan shop", "water sports", "kayak", "add_to_cart")),
    (
        line("/department/fan%20shop/category/indoor/outdoor%20games/product/o'brien%20vest/add_to_cart"),
        ("fan shop", "indoor/outdoor games/product/o'brien vest/add_to_cart", "", "category"),
    ),
    (line("/department/golf/category/golf%20balls"), ("golf", "golf balls", "", "category")),
    (line("/department/golf"), ("golf", "", "", "department")),
    (line("/department/golf/products"), ("golf/products", "", "", "department")),
    (line("/checkout"), ("", "", "", "checkout")),
    (line("/checkout?x=1"), ("", "", "", "checkout?x=1")),
    (line("/"), ("", "", "", "")),
    (line("/a/b"), None),
    (line(PRODUCT_URL, status=404), None),
    (line("/department/golf/category/golf%20balls", status=500), None),
    (line("/department/golf", status=301), None),
    (line("/home", status=404), None),
    (line("/home", user="bob"), None),
    ("garbage", None),
    ("", None),
    (None, None),
    (line("/department/d/category/c/product/free%205.0+"), ("d", "c", "free 5.0 ", "product")),
    (line("/department/d/category/c/product/bad%ZZ"), ("d", "c", "bad%ZZ", "product")),
    (
        line("/department/d/category/c/product/x/add_to_cart/y/add_to_cart"),
        ("d", "c", "x/y", "add_to_cart"),
    ),
    (line("/department/d/category/c/product/x%2Fadd_to_cart"), ("d", "c", "x", "add_to_cart")),
    (line("/department/d/category/c/product/"), ("d", "c", "", "product")),
    (line("/department//category//product/x"), ("", "", "x", "product")),
    (line("/product"), ("", "", "", "product")),
    (line("/department/d e/category/c"), ("d e", "c", "", "category")),
]


@pytest.mark.parametrize("text, fields", CASES, ids=[str(i) for i in range(len(CASES))])
def test_line(spark, text, fields):
    expected = [] if fields is None else [("1.2.3.4", TIME, *fields, "200")]
    assert parse(spark, [text]) == expected


def test_time_with_missing_parts_is_null(spark):
    text = '1.2.3.4 - - [14/Jun/2014] "GET /home HTTP/1.1" 200 1'
    assert parse(spark, [text]) == [("1.2.3.4", None, "", "", "", "home", "200")]


def test_text_before_the_visitor_is_skipped(spark):
    assert parse(spark, ["proxy7 " + line("/home")])[0][0] == "1.2.3.4"


def test_earlier_pattern_wins_over_earlier_place(spark):
    """Two records in one line: the product request is second, and still decides."""
    both = line("/home") + " " + line(PRODUCT_URL)
    assert parse(spark, [both]) == [
        ("1.2.3.4", TIME, "fan shop", "water sports", "kayak", "product", "200")
    ]


def brute_force(text):
    requests = (PRODUCT_REQUEST, CATEGORY_REQUEST, DEPARTMENT_REQUEST, PAGE_REQUEST)
    for kind, request in zip(("product", "category", "department", None), requests):
        found = re.search(VISIT + request, text)
        if found is None:
            continue
        ip, stamp, *names, status = found.groups()
        if status != "200":
            return None
        parts = stamp.split(":")
        time = None
        if len(parts) >= 4:
            time = f"{parts[0]} {parts[1]}:{parts[2]}:{parts[3].split(' ')[0]}"
        if kind is None:
            return (ip, time, "", "", "", names[0], status)
        dept, cat, prod = ([unquote_plus(name) for name in names] + ["", ""])[:3]
        if kind == "product" and prod.endswith("/add_to_cart"):
            kind, prod = "add_to_cart", prod.replace("/add_to_cart", "")
        return (ip, time, dept, cat, prod, kind, status)
    return None


def test_random_lines_against_brute_force(spark):
    draw = random.Random(7)
    pieces = [
        "1.2.3.4", " ", " - - [", "14/Jun/2014:23:30:13 -0400", "14/Jun", '] "', "GET ", "/department/",
        "golf", "/category/", "a%20b", "/product/", "kayak", "/add_to_cart", " HTTP/1.1", " 200", " 404",
        "/", "home", '" 12 "-"', "x+y", "[", "]",
    ]
    lines = ["".join(draw.choices(pieces, k=draw.randint(1, 14))) for _ in range(3000)]
    paths = ["/department/", "/category/", "/product/", "/add_to_cart", "/", "golf", "a%20b", "x+y", " "]
    names = ["golf", "a%20b", "x+y", "a b", "in/out", "", "x/add_to_cart", "y%2Fz", " - - [q", "o'b"]

    def path():
        if draw.random() < 0.3:
            return "".join(draw.choices(paths, k=draw.randint(1, 8)))
        steps = ("/department/", "/category/", "/product/")[: draw.randint(1, 3)]
        return "".join(step + draw.choice(names) for step in steps) + draw.choice(("", "/add_to_cart"))

    for _ in range(4000):
        records = [
            line(path(), draw.choice((200, 200, 404)))
            for _ in range(draw.choice((1, 1, 2, 3)))
        ]
        lines.append(draw.choice(("", "junk ", "- - [")) + draw.choice((" ", "")).join(records))
    expected = sorted(filter(None, map(brute_force, lines)), key=repr)
    assert len(expected) > 1000
    assert sorted(parse(spark, lines), key=repr) == expected


def test_no_shuffle_and_no_python(spark, storefront):
    frame = spark.createDataFrame([(line("/home"),)], "value string")
    plan = parse_access_log(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_matching_is_not_repeated_in_filters(spark, storefront):
    """A filter on parsed fields stays above the generator that does the matching."""
    frame = spark.createDataFrame([(line("/home"),)], "value string")
    filtered = parse_access_log(frame).where(F.col("pageType").isin("home") & (F.col("dept") != "x"))
    plan = filtered.select("category")._jdf.queryExecution().optimizedPlan().toString()
    before_generate = plan[: plan.index("Generate")]
    assert "regexp_replace" not in before_generate and "Filter" in before_generate
    assert filtered.columns == list(WEBLOG_COLUMNS)
