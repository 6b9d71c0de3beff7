"""What the plans must not do at scale, and skewed input that must not matter."""

from __future__ import annotations

import re

import pytest
from retail_rows import by_key, category, item, page, product, retail_queries, rows
from parity import compare, duck
from pyspark.sql import functions as F

import __spark_entry__ as contract
from aislewise.plans import categories, products
from aislewise.sources import storefront as model


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", retail_queries())
def test_no_product_of_tables_and_no_python(spark, sf_dir, name):
    plan = plan_of(contract.queries()[name](spark, sf_dir))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert operator not in plan


def test_scans_read_needed_columns_only(spark, sf_dir):
    plan = plan_of(contract.queries()["category_presence_sales"](spark, sf_dir))
    assert "ReadSchema: struct<l_partkey:bigint>" in plan
    totals = plan_of(contract.queries()["product_rank_gap"](spark, sf_dir))
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double>" in totals


def test_lookups_are_not_sorted_for_aggregates(spark, sf_dir):
    assert "SortAggregate" not in plan_of(contract.queries()["category_presence_tagged"](spark, sf_dir))


def test_facts_are_summed_before_joins(spark, sf_dir):
    """The join with products sits above the aggregation of order items by product."""
    plan = plan_of(contract.queries()["product_presence"](spark, sf_dir))
    lines = plan.splitlines()
    scan = next(i for i, text in enumerate(lines) if "l_extendedprice" in text and "Scan" in text)
    above = [text for text in reversed(lines[:scan]) if "Aggregate" in text or "Join" in text]
    assert "HashAggregate" in above[0] and "HashAggregate" in above[1]


def executed_lines(plan):
    """Lines of an executed plan without the initial plans, of subqueries neither."""
    lines, initial = [], None
    for text in plan.splitlines():
        begin = re.search(r"[^ :+-]", text)
        depth = begin.start() if begin else 0
        # Expressions with line feeds run on at the left margin.
        continued = depth == 0 and not text.startswith("AdaptiveSparkPlan")
        if continued or (initial is not None and depth >= initial):
            continue
        initial = depth if "== Initial Plan ==" in text else None
        if initial is None:
            lines.append(text)
    return lines


SHARES = [
    "category_presence_sales_summary",
    "channel_share",
    "channel_share_top5",
    "dept_traffic_revenue",
    "dept_efficiency",
]


@pytest.mark.parametrize("name", SHARES)
def test_totals_reuse_the_exchange_of_the_counts(spark, sf_dir, name):
    frame = contract.queries()[name](spark, sf_dir)
    frame.collect()
    plan = executed_lines(plan_of(frame))
    totals = {m.group() for m in (re.search(r"Subquery subquery#\d+", text) for text in plan) if m}
    reused = {m.group() for m in (re.search(r"ReusedExchange \[_groupingexpression\S+", t) for t in plan) if m}
    assert totals and len(reused) >= len(totals)


@pytest.mark.parametrize("name", retail_queries())
def test_facts_are_read_once(spark, sf_dir, name):
    """Totals, ranks and repeated sides reuse an exchange instead of a second scan."""
    frame = contract.queries()[name](spark, sf_dir)
    frame.collect()
    scans = [text for text in executed_lines(plan_of(frame)) if "FileScan" in text]
    for column in ("l_partkey", "event_id", "o_orderdate"):
        assert sum(column in text.split("Batched")[0] for text in scans) <= 1


WITHOUT_BROADCAST = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


@pytest.fixture
def no_broadcast(spark):
    for key, value in WITHOUT_BROADCAST.items():
        spark.conf.set(key, value)
    yield
    for key in WITHOUT_BROADCAST:
        spark.conf.unset(key)


@pytest.mark.parametrize("name", retail_queries())
def test_same_results_without_broadcasts(spark, sf_dir, no_broadcast, name):
    frame = contract.queries()[name](spark, sf_dir)
    assert compare(frame, duck(sf_dir), contract.oracle_sql()[name]) == []
    assert "BroadcastHashJoin" not in plan_of(frame)


def test_a_third_of_all_rows_on_one_key(spark, sf_dir, no_broadcast):
    """Hot part in events and line items; partitions split at run time, results whole."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    hot = F.col("n") % 3 == 0
    numbers = spark.range(60_000).withColumnRenamed("id", "n")
    events = numbers.select(
        F.col("n").alias("event_id"),
        F.lit("2024-01-01 10:00:00").cast("timestamp_ntz").alias("ts"),
        (F.col("n") % 500).alias("user_id"),
        F.lit("purchase").alias("event_type"),
        F.format_string('{"k": %d}', F.when(hot, 8).otherwise(F.col("n") % 100)).alias("props"),
    )
    from aislewise.operators.weblog import parse_access_log
    from aislewise.sources.relations import RetailTables

    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
    }
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        log = model.access_log(events.repartition(8), part)
        tables = RetailTables(
            {"weblog": lambda: parse_access_log(log), "products": lambda: model.products(part)}
        )
        counted = tables.weblog.groupBy("product").count()
        assert sum(n for _, n in rows(counted)) == 60_000
        assert "skew=true" in plan_of(counted)
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_hot_names_in_small_tables(make_tables):
    tables = make_tables(
        weblog=[page("add_to_cart", "c", "hot")] * 300 + [page("add_to_cart", "c", f"p{i}") for i in range(20)],
        categories=[category("1", "c")],
        products=[product(str(i), name="hot" if i % 3 == 0 else f"p{i}") for i in range(60)],
        order_items=[item("0", "1", "1")] * 300 + [item(str(i), "2", "3") for i in range(60)],
    )
    report = by_key(products.product_presence(tables), "product", "web_cart_adds", "actual_order_lines")
    assert report["hot"] == (300, 320) and len(report) == 41 + 7
    assert rows(categories.channel_share(tables), "web_events", "store_sales") == [(320, 360)]
