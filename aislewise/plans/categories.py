"""Categories on the web, in the store and in the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aislewise.functions.labels import CATALOG_LABELS, SALES_LABELS
from aislewise.functions.numeric import percent, two_places, zero_if_null
from aislewise.functions.text import (
    is_given,
    line_key,
    strip_url_fragments,
    title_words,
    title_words_collapsed,
    trim_controls,
)
from aislewise.operators.channels import (
    CATEGORY_PAGES,
    catalog_category_names,
    sales_by_category_name,
    sales_by_product,
    sold_category_names,
    web_category_events,
    web_category_names,
)
from aislewise.operators.presence import last_row_per_key, outer_by_key, tagged_presence
from aislewise.operators.ranking import total_of
from aislewise.sources.relations import PLACE, RetailTables


def _web_against_sales(tables: RetailTables) -> DataFrame:
    sold = sold_category_names(tables.order_items, tables.products, tables.categories)
    return outer_by_key(web_category_names(tables.weblog), sold)


def _web_against_catalog(tables: RetailTables) -> DataFrame:
    return outer_by_key(web_category_names(tables.weblog), catalog_category_names(tables.categories))


def category_presence_sales(tables: RetailTables) -> DataFrame:
    """Categories browsed against categories sold."""
    presence = SALES_LABELS.of(F.col("in_web"), F.col("in_store"))
    return (
        _web_against_sales(tables)
        .select(F.col("name").alias("category"), presence.alias("presence"))
        .orderBy("presence", "category")
    )


def category_presence_sales_summary(tables: RetailTables) -> DataFrame:
    """Number and share of categories per presence."""
    presence = SALES_LABELS.of(F.col("in_web"), F.col("in_store"))
    counts = (
        _web_against_sales(tables)
        .groupBy(presence.alias("presence"))
        .agg(F.count(F.lit(1)).alias("category_count"))
    )
    share = percent(F.col("category_count"), total_of(counts, "category_count"))
    return counts.withColumn("pct_of_total", two_places(share)).orderBy(
        F.desc("category_count"), "presence"
    )


def category_presence_catalog(tables: RetailTables) -> DataFrame:
    """Categories browsed against all categories of the catalog."""
    presence = CATALOG_LABELS.of(F.col("in_web"), F.col("in_store"))
    return (
        _web_against_catalog(tables)
        .select(F.col("name").alias("category"), presence.alias("presence"))
        .orderBy("presence", "category")
    )


def catalog_coverage(tables: RetailTables) -> DataFrame:
    """One row: how much of the catalog has web traffic.  All NULL without any category."""
    in_web, in_store = F.col("in_web"), F.col("in_store")

    def number(condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0))

    counts = _web_against_catalog(tables).agg(
        number(in_web & in_store).alias("both"),
        number(in_web & ~in_store).alias("web_only"),
        number(~in_web).alias("catalog_only"),
    )
    catalog = F.col("both") + F.col("catalog_only")
    return counts.select(
        "both",
        "web_only",
        "catalog_only",
        (F.col("both") + F.col("web_only")).alias("total_web_categories"),
        catalog.alias("total_catalog_categories"),
        two_places(percent(F.col("both"), catalog)).alias("catalog_coverage_pct"),
    )


def category_presence_clean(tables: RetailTables) -> DataFrame:
    """Presence after URL fragments are cut off the web categories, names capitalised."""
    cleaned = tables.weblog.withColumn("category", strip_url_fragments(F.col("category")))
    sold = sold_category_names(tables.order_items, tables.products, tables.categories)
    presence = SALES_LABELS.of(F.col("in_web"), F.col("in_store"))
    return (
        outer_by_key(web_category_names(cleaned), sold)
        .select("name", presence.alias("presence"))
        .orderBy("presence", "name")
        .select(title_words(F.col("name")).alias("Category"), "presence")
    )


def _id(relation: DataFrame, name: str) -> Column:
    """An id column without control characters around it; numbers have none."""
    column = F.col(name)
    if isinstance(relation.schema[name].dataType, T.StringType):
        column = trim_controls(column)
    return column.alias(name)


def category_presence_tagged(tables: RetailTables) -> DataFrame:
    """The same question by one grouping of tagged names, with two dimension look-ups.

    Keys lose control characters at both ends; spaces that a cut fragment leaves behind
    belong to the key.  A repeated id in a look-up keeps its last row: by the relation's place
    column, which readers of files add, or else in the order in which the rows come.
    Look-ups are cut to the ids sold before they are ordered.
    """
    category, page_type = trim_controls(F.col("category")), line_key(F.col("pageType"))
    web = tables.weblog.where(page_type.isin(*CATEGORY_PAGES) & is_given(category)).select(
        F.lower(strip_url_fragments(category)).alias("name")
    )

    def look_up(ids: DataFrame, relation: DataFrame, key: str, value: Column, name: str) -> DataFrame:
        place = F.col(PLACE) if PLACE in relation.columns else F.monotonically_increasing_id()
        entries = relation.select(_id(relation, key), value.alias(name), place.alias(PLACE))
        sold_entries = entries.join(ids, key, "left_semi")
        return last_row_per_key(sold_entries, key, name, PLACE).select(name).distinct()

    order_items, products = sales_by_product(tables.order_items), tables.products
    product_ids = order_items.select(_id(order_items, "product_id")).distinct()
    category_ids = look_up(product_ids, products, "product_id", _id(products, "cat_id"), "cat_id")
    sold = look_up(category_ids, tables.categories, "cat_id", line_key(F.col("cat_name")), "name")
    presence = SALES_LABELS.of(F.col("in_web"), F.col("in_store"))
    return (
        tagged_presence(web, sold)
        .select("name", presence.alias("presence"))
        .orderBy("name")
        .select(title_words_collapsed(F.col("name")).alias("category"), "presence")
    )


def _shares(tables: RetailTables) -> DataFrame:
    web = web_category_events(tables.weblog)
    store = sales_by_category_name(tables.order_items, tables.products, tables.categories).select(
        "name", F.col("order_rows").alias("store_sales")
    )
    joined = outer_by_key(
        web.withColumn("web_share", percent(F.col("web_events"), total_of(web, "web_events"))),
        store.withColumn("store_share", percent(F.col("store_sales"), total_of(store, "store_sales"))),
    )
    web_share, store_share = zero_if_null(F.col("web_share")), zero_if_null(F.col("store_share"))
    return joined.select(
        F.col("name").alias("category"),
        zero_if_null(F.col("web_events")).alias("web_events"),
        two_places(web_share).alias("web_pct"),
        zero_if_null(F.col("store_sales")).alias("store_sales"),
        two_places(store_share).alias("store_pct"),
        two_places(F.abs(web_share - store_share)).alias("pct_difference"),
    )


def channel_share(tables: RetailTables) -> DataFrame:
    """Share of web events against share of order lines, per category."""
    return _shares(tables).orderBy((F.col("web_events") + F.col("store_sales")).desc(), "category")


def channel_share_top5(tables: RetailTables) -> DataFrame:
    """The five categories whose shares differ most; ties go by name."""
    return (
        _shares(tables)
        .select("category", "web_pct", "store_pct", "pct_difference")
        .orderBy(F.desc("pct_difference"), "category")
        .limit(5)
    )
