"""The relations of the retail model and where they are read from."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _all_text(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


# --- fixed values -----------------------------------------------------------
# Columns by position; every column is text, typed where a report needs it.
SCHEMAS: dict[str, T.StructType] = {
    "weblog": _all_text("ip", "datetime", "dept", "category", "product", "pageType", "respCode"),
    "departments": _all_text("dept_id", "dept_name"),
    "categories": _all_text("cat_id", "dept_id", "cat_name"),
    "products": _all_text(
        "product_id", "cat_id", "product_name", "product_desc", "price", "product_url"
    ),
    "customers": _all_text(
        "customer_id", "fname", "lname", "email", "password", "street", "city", "state", "zipcode"
    ),
    "orders": _all_text("order_id", "order_date", "customer_id", "order_status"),
    "order_items": _all_text(
        "item_id", "order_id", "product_id", "quantity", "subtotal", "unit_price"
    ),
}
# ----------------------------------------------------------------------------


#: Where a row stood in its files, in a relation that was read with that.
PLACE = "_place"


class RetailTables:
    """The seven relations, each opened when a report first asks for it."""

    def __init__(self, openers: Mapping[str, Callable[[], DataFrame]]):
        unknown = set(openers) - set(SCHEMAS)
        if unknown:
            raise ValueError(f"no such relations: {sorted(unknown)}")
        self._openers = dict(openers)

    def _open(self, name: str) -> DataFrame:
        if name not in self._openers:
            raise KeyError(f"relation {name} was not given")
        return self._openers[name]()

    @cached_property
    def weblog(self) -> DataFrame:
        return self._open("weblog")

    @cached_property
    def departments(self) -> DataFrame:
        return self._open("departments")

    @cached_property
    def categories(self) -> DataFrame:
        return self._open("categories")

    @cached_property
    def products(self) -> DataFrame:
        return self._open("products")

    @cached_property
    def customers(self) -> DataFrame:
        return self._open("customers")

    @cached_property
    def orders(self) -> DataFrame:
        return self._open("orders")

    @cached_property
    def order_items(self) -> DataFrame:
        return self._open("order_items")

    def replaced(self, **frames: DataFrame) -> RetailTables:
        """The same tables with some of them exchanged, for instance for a roll-up."""
        openers = dict(self._openers)
        openers.update({name: (lambda frame=frame: frame) for name, frame in frames.items()})
        return RetailTables(openers)

    def register_views(self) -> None:
        """Make every given relation a temporary view of its own name."""
        for name in self._openers:
            getattr(self, name).createOrReplaceTempView(name)
