"""Rows of the retail relations and short ways to read results, for all tests but those of subpackages."""

from __future__ import annotations

import re

import __spark_entry__ as contract


def retail_queries():
    """Names of the queries of the retail reports; those of subpackages have tests of their own."""
    return [name for name in contract.queries() if name != "pipeline" and not re.match(r"op\d+_", name)]


def page(page_type, category="", product="", dept="golf", datetime="14/Jun/2014 23:30:13"):
    return {
        "ip": "1.2.3.4",
        "datetime": datetime,
        "dept": dept,
        "category": category,
        "product": product,
        "pageType": page_type,
        "respCode": "200",
    }


def item(product_id, quantity="1", subtotal="1.0", item_id="i"):
    return {"item_id": item_id, "product_id": product_id, "quantity": quantity, "subtotal": subtotal}


def product(product_id, cat_id="1", name="p", price="10"):
    return {"product_id": product_id, "cat_id": cat_id, "product_name": name, "price": price}


def category(cat_id, name, dept_id="1"):
    return {"cat_id": cat_id, "cat_name": name, "dept_id": dept_id}


def rows(frame, *columns):
    selected = frame.select(*columns) if columns else frame
    return [tuple(row) for row in selected.collect()]


def by_key(frame, key, *columns):
    return {row[0]: tuple(row[1:]) for row in rows(frame, key, *columns)}
