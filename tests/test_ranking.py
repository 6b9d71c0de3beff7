"""Ranks from a histogram against the window function, and shares of a total."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from aislewise.operators.ranking import rank_descending, total_of


def test_same_as_rank_over_all_rows(spark):
    draw = random.Random(3)
    data = [(f"p{i}", draw.choice((None, 0, 1, 1, 1, 2, 5, 8, -3, draw.randint(0, 400)))) for i in range(3000)]
    frame = spark.createDataFrame(data, "name string, units bigint")
    expected = frame.withColumn("place", F.rank().over(Window.orderBy(F.desc("units"))))
    actual = rank_descending(frame, "units", "place")
    assert actual.columns == expected.columns
    assert {tuple(r) for r in actual.collect()} == {tuple(r) for r in expected.collect()}


def test_ranks_without_a_broadcast_join(spark):
    """Beyond the broadcast limit the join is a sort-merge join; a third of rows share a measure."""
    frame = spark.range(9000).select(
        F.col("id").alias("name"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("units")
    )
    expected = {tuple(r) for r in rank_descending(frame, "units", "place").collect()}
    limits = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for limit in limits:
            spark.conf.set(limit, "-1")
        ranked = rank_descending(frame, "units", "place")
        assert {tuple(r) for r in ranked.collect()} == expected
        assert "SortMergeJoin" in ranked._jdf.queryExecution().executedPlan().toString()
    finally:
        for limit in limits:
            spark.conf.unset(limit)
    assert len(expected) == 9000


def test_one_task_only_adds_up_ranges(spark):
    """However many rows and values there are, a single task sees one row for each range of the measure."""
    frame = spark.range(200_000).select(F.col("id").alias("name"), (F.col("id") % 90_000).alias("units"))
    ranked = rank_descending(frame, "units", "place")
    assert ranked.where("place = 1").count() == 2
    assert ranked.where("units = 0").first()["place"] == 199_998
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    single = plan[plan.index("Exchange SinglePartition") :].splitlines()
    assert any("HashAggregate(keys=[_range" in text for text in single[1:3])


def test_total_is_a_scalar_subquery(spark):
    frame = spark.createDataFrame([("a", 1, 5), ("b", 3, 6)], "k string, x bigint, y bigint")
    grouped = frame.groupBy("k").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    shares = grouped.select("k", (F.col("x") / total_of(grouped, "x", "y")).alias("share"), "y")
    assert {tuple(r) for r in shares.collect()} == {("a", 0.25, 5), ("b", 0.75, 6)}
    assert "ReusedExchange" in shares._jdf.queryExecution().executedPlan().toString()
