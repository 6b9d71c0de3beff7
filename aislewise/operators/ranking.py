"""Shares of a total and ranks over all rows, without moving all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a measure for each doubling of its size.
_RANGES_PER_OCTAVE = 256


def totals_of(frame: DataFrame, *measures: str) -> Column:
    """Sums of columns over a whole frame, as a scalar subquery: a struct by their names.

    Spark reuses the exchange below the aggregate that made ``frame``, so the facts are
    read once; partial sums are all that travels.  For that the subquery has to need the
    same columns as the query around it, so name those as well that it would not need.
    """
    sums = [F.sum(name).alias(name) for name in measures]
    return frame.agg(F.struct(*sums).alias("sums")).scalar()


def total_of(frame: DataFrame, measure: str, *also_used: str) -> Column:
    """The sum of one column; ``also_used`` are columns that the query around it needs."""
    return totals_of(frame, measure, *also_used)[measure]


def rank_descending(frame: DataFrame, measure: str, rank_column: str) -> DataFrame:
    """SQL ``RANK()`` by ``measure`` from high to low: ties share a rank and leave a gap.

    The rank of a row is one more than the number of rows with a larger measure, so it
    depends on the measure alone and is found on its histogram.  That is cut into ranges by
    the logarithm: at most some 30,000 whatever the data, and these alone are added up in
    one task.  Within a range, a window adds up the histogram's rows.  The ranks return to
    the rows by a join on the measure, which Spark broadcasts when the histogram is small
    and splits on hot values otherwise.
    """
    histogram = frame.groupBy(measure).agg(F.count(F.lit(1)).alias("_rows"))
    size = F.col(measure).cast("double")
    octaves = F.floor(F.log2(F.abs(size) + 1) * _RANGES_PER_OCTAVE)
    # NULL is the smallest value in a descending order and has a rank as well.
    place = F.when(size < 0, -octaves).otherwise(octaves)
    histogram = histogram.withColumn("_range", F.coalesce(place, F.lit(-(2**31))))

    larger_ranges = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = histogram.groupBy("_range").agg(F.sum("_rows").alias("_in_range"))
    before = ranges.select("_range", F.coalesce(F.sum("_in_range").over(larger_ranges), F.lit(0)).alias("_before"))
    larger = (
        Window.partitionBy("_range")
        .orderBy(F.col(measure).desc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ranks = histogram.join(before, "_range").select(
        F.col(measure).alias("_measure"),
        (F.col("_before") + F.coalesce(F.sum("_rows").over(larger), F.lit(0)) + 1).alias(rank_column),
    )
    same = F.col(measure).eqNullSafe(F.col("_measure"))
    return frame.join(ranks, same, "inner").drop("_measure")
