"""What each channel did, per category, product, department and hour.

Facts may come in raw or rolled up (see :mod:`aislewise.operators.rollups`).  A roll-up is
marked as such in its schema, also in the file it is written to; the names of columns say
nothing.  A rolled-up web frame counts ``hits`` events per row, and a rolled-up sales frame
is per product already.

Store aggregates climb the star one key at a time: order items are summed per product
before products are joined, the result per category before categories are joined, and
so on.  Every join then meets at most one fact row per key, however hot a key is, and
no side has to be broadcast; Spark still does so where it finds a side small enough.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.functions.numeric import money_sums, to_int
from aislewise.functions.text import is_given, line_key, name_key
from aislewise.operators.weblog import ADD_TO_CART, CATEGORY, PRODUCT

# --- fixed values -----------------------------------------------------------
CATEGORY_PAGES = (ADD_TO_CART, PRODUCT, CATEGORY)
WEBLOG_TIME = "dd/MMM/yyyy HH:mm:ss"
RAW_STAMP_TIME = "dd/MMM/yyyy:HH:mm:ss Z"
ORDER_TIME = "yyyy-MM-dd HH:mm:ss"
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
# What a time looks like at least, and the places of year, month and day among its fields.
_CLOCK = r" +\d{1,2}:\d{1,2}:\d{1,2}"
_MONTH = "(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
_LENIENT = {
    ORDER_TIME: (r"^\d{1,4}-\d{1,2}-\d{1,2}" + _CLOCK, (0, 1, 2)),
    WEBLOG_TIME: (r"^\d{1,2}/" + _MONTH + r"/\d{1,4}" + _CLOCK, (2, 1, 0)),
}
# Exact times, each field at its full width; the last day of February in a leap year is left to the lenient way.
_EXACT_CLOCK = r" (?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d$"
_EXACT = {
    ORDER_TIME: r"^\d{4}-(?:(?:0[1-9]|1[0-2])-(?:0[1-9]|1\d|2[0-8])|(?:0[13-9]|1[0-2])-(?:29|30)|(?:0[13578]|1[02])-31)"
    + _EXACT_CLOCK,
    WEBLOG_TIME: r"^(?:(?:0[1-9]|1\d|2[0-8])/(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
    r"|(?:29|30)/(?:Jan|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)|31/(?:Jan|Mar|May|Jul|Aug|Oct|Dec))/\d{4}"
    + _EXACT_CLOCK,
}
# Where the hour begins in an exact time.
_HOUR_AT = {ORDER_TIME: 12, WEBLOG_TIME: 13}
# ----------------------------------------------------------------------------


_ROLLUP = "aislewise_rollup"


def marked_rollup(column: Column, name: str, made_with: str) -> Column:
    """A column that marks its frame as a roll-up; ``made_with`` says what cannot be undone."""
    return column.alias(name, metadata={_ROLLUP: made_with})


def rollup_of(frame: DataFrame) -> str | None:
    """What a roll-up was made with; None for a frame of single facts."""
    found = [field.metadata[_ROLLUP] for field in frame.schema if _ROLLUP in field.metadata]
    return found[0] if found else None


def hits(weblog: DataFrame, condition: Column | None = None) -> Column:
    """Number of page events, of those that meet the condition; 0 for none."""
    weight = F.col("hits") if rollup_of(weblog) is not None else F.lit(1).cast("bigint")
    if condition is not None:
        weight = F.when(condition, weight)
    return F.coalesce(F.sum(weight), F.lit(0).cast("bigint"))


# --- web --------------------------------------------------------------------


def category_events(weblog: DataFrame) -> DataFrame:
    """Events that show a category: product, category and add-to-cart pages."""
    return weblog.where(F.col("pageType").isin(*CATEGORY_PAGES) & is_given(F.col("category")))


def web_category_names(weblog: DataFrame) -> DataFrame:
    return category_events(weblog).select(name_key(F.col("category")).alias("name")).distinct()


def web_category_events(weblog: DataFrame) -> DataFrame:
    """name, web_events."""
    events = category_events(weblog)
    return events.groupBy(name_key(F.col("category")).alias("name")).agg(
        hits(weblog).alias("web_events")
    )


def web_cart_adds(weblog: DataFrame, blank_products: bool = False) -> DataFrame:
    """name, web_cart_adds: add-to-cart events per product name."""
    adds = weblog.where(F.col("pageType") == ADD_TO_CART)
    if not blank_products:
        adds = adds.where(is_given(F.col("product")))
    return adds.groupBy(name_key(F.col("product")).alias("name")).agg(
        hits(weblog).alias("web_cart_adds")
    )


def web_product_keys(weblog: DataFrame) -> DataFrame:
    """name: products on any page, one row per event; repeats fall away downstream."""
    name = line_key(F.col("product"))
    return weblog.select(name.alias("name")).where(is_given(F.col("name")))


def web_department_events(weblog: DataFrame) -> DataFrame:
    """name, web_total_events, web_cart_adds."""
    return (
        weblog.where(is_given(F.col("dept")))
        .groupBy(name_key(F.col("dept")).alias("name"))
        .agg(
            hits(weblog).alias("web_total_events"),
            hits(weblog, F.col("pageType") == ADD_TO_CART).alias("web_cart_adds"),
        )
    )


def hour_of(text: Column, time_format: str) -> Column:
    """Hour of day as int, as written; NULL where the text is no time of the format.

    The two formats of the relations are read leniently: fields may have one digit, and
    text after the seconds, such as a fraction, is ignored.  A date that does not exist is
    no time.  No time zone is involved.  Any other format has to be met exactly.

    A time whose fields all have their full width is only checked, and its hour cut out; the
    lenient reading is the other branch of the same expression and runs for the rest.
    """
    text = text.cast("string")
    if time_format not in _LENIENT:
        return F.hour(F.try_to_timestamp(text, F.lit(time_format)))
    shape, (year, month, day) = _LENIENT[time_format]
    fields = F.split(F.trim(text), "[^0-9A-Za-z]+")
    named = (F.position(F.lower(F.get(fields, F.lit(month))), F.lit(_MONTHS)) + 2) / 3
    numbers = [F.get(fields, F.lit(at)).try_cast("int") for at in (year, month, day, 3, 4, 5)]
    numbers[1] = F.coalesce(numbers[1], named.cast("int"))
    time = F.try_make_timestamp_ntz(*numbers[:5], numbers[5].cast("decimal(16,6)"))
    lenient = F.when(F.trim(text).rlike(shape), F.hour(time))
    exact = F.substring(text, _HOUR_AT[time_format], 2).cast("int")
    return F.when(text.rlike(_EXACT[time_format]), exact).otherwise(lenient)


def day_of(text: Column, time_format: str) -> Column:
    """The date as written; NULL where the text is no time of the format, in the sense of :func:`hour_of`."""
    text = text.cast("string")
    if time_format not in _LENIENT:
        return F.to_date(F.try_to_timestamp(text, F.lit(time_format)))
    fields = F.split(F.trim(text), "[^0-9A-Za-z]+")
    numbers = [F.get(fields, F.lit(at)) for at in _LENIENT[time_format][1]]
    named = (F.position(F.lower(numbers[1]), F.lit(_MONTHS)) + 2) / 3
    numbers[1] = F.coalesce(numbers[1].try_cast("int"), named.cast("int"))
    exact = F.concat_ws("-", *[F.lpad(number.cast("string"), width, "0") for number, width in zip(numbers, (4, 2, 2))])
    return F.when(hour_of(text, time_format).isNotNull(), exact.try_cast("date"))


def web_hours(weblog: DataFrame, time_format: str = WEBLOG_TIME) -> DataFrame:
    """hour_of_day, web_events, web_cart_adds; unparsable times share a NULL hour.

    A rolled-up frame has its hour already; another format than that of the roll-up is an
    error.
    """
    made_with = rollup_of(weblog)
    rolled_up = made_with is not None
    if rolled_up and made_with != time_format:
        raise ValueError(f"the roll-up has read times as {made_with!r}, not as {time_format!r}")
    hour = F.col("hour_of_day") if rolled_up else hour_of(F.col("datetime"), time_format)
    timed = F.col("has_datetime") if rolled_up else F.col("datetime").isNotNull()
    return (
        weblog.where(timed)
        .groupBy(hour.alias("hour_of_day"))
        .agg(
            hits(weblog).alias("web_events"),
            hits(weblog, F.col("pageType") == ADD_TO_CART).alias("web_cart_adds"),
        )
    )


# --- store ------------------------------------------------------------------


def sales_by_product(order_items: DataFrame) -> DataFrame:
    """Order items summed per product id; sums stay NULL where no value was readable.

    Revenue is an exact decimal here, with what no decimal holds beside it, and becomes a
    double in the reports.
    """
    if rollup_of(order_items) is not None:
        return order_items
    quantity = to_int(F.col("quantity"))
    return order_items.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("order_rows"),
        F.count("item_id").alias("order_lines"),
        F.sum(quantity).alias("quantity"),
        F.count(quantity).alias("quantity_rows"),
        *money_sums(F.col("subtotal"), "revenue"),
    )


_MEASURES = ("order_rows", "order_lines", "quantity", "quantity_rows", "revenue", "revenue_rest")


def summed_sales(frame: DataFrame, key: Column) -> DataFrame:
    """Sales measures of several rows added up by key."""
    return frame.groupBy(key).agg(*[F.sum(measure).alias(measure) for measure in _MEASURES])


def _sales_by_category_id(order_items: DataFrame, products: DataFrame) -> DataFrame:
    sold = sales_by_product(order_items).join(products.select("product_id", "cat_id"), "product_id")
    return summed_sales(sold, F.col("cat_id"))


def sales_by_category_name(
    order_items: DataFrame, products: DataFrame, categories: DataFrame
) -> DataFrame:
    """name and measures; categories of one name are merged."""
    sold = _sales_by_category_id(order_items, products).join(
        categories.select("cat_id", "cat_name"), "cat_id"
    )
    return summed_sales(sold, name_key(F.col("cat_name")).alias("name"))


def sales_by_product_name(order_items: DataFrame, products: DataFrame) -> DataFrame:
    """name and measures; products of one name are merged."""
    sold = sales_by_product(order_items).join(
        products.select("product_id", "product_name"), "product_id"
    )
    return summed_sales(sold, name_key(F.col("product_name")).alias("name"))


def sales_by_department_name(
    order_items: DataFrame, products: DataFrame, categories: DataFrame, departments: DataFrame
) -> DataFrame:
    by_category = _sales_by_category_id(order_items, products)
    by_department = summed_sales(
        by_category.join(categories.select("cat_id", "dept_id"), "cat_id"), F.col("dept_id")
    )
    sold = by_department.join(departments.select("dept_id", "dept_name"), "dept_id")
    return summed_sales(sold, name_key(F.col("dept_name")).alias("name"))


def sold_category_names(
    order_items: DataFrame, products: DataFrame, categories: DataFrame
) -> DataFrame:
    return sales_by_category_name(order_items, products, categories).select("name")


def catalog_category_names(categories: DataFrame) -> DataFrame:
    return categories.select(name_key(F.col("cat_name")).alias("name")).distinct()


def order_hours(
    orders: DataFrame, time_format: str = ORDER_TIME, statuses: Sequence[str] | None = None
) -> DataFrame:
    """hour_of_day, store_orders; with ``statuses``, of orders in one of these only."""
    if statuses is not None:
        orders = orders.where(F.upper(F.trim("order_status")).isin([s.upper() for s in statuses]))
    return (
        orders.where(F.col("order_date").isNotNull())
        .groupBy(hour_of(F.col("order_date"), time_format).alias("hour_of_day"))
        .agg(F.count(F.lit(1)).alias("store_orders"))
    )
