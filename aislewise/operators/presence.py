"""Which names a channel has and the other one lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outer_by_key(web: DataFrame, store: DataFrame, key: str = "name") -> DataFrame:
    """Full outer join of two frames with unique keys.

    Adds ``in_web`` and ``in_store``.  NULL keys of the two sides stay two rows.
    Both sides come out of an aggregation on the key, so the join needs no exchange of
    its own and no key has more than one row per side.
    """
    web_key, store_key = F.col(f"web.{key}"), F.col(f"store.{key}")
    joined = web.alias("web").join(store.alias("store"), web_key == store_key, "full_outer")
    return joined.select(
        F.coalesce(web_key, store_key).alias(key),
        web_key.isNotNull().alias("in_web"),
        store_key.isNotNull().alias("in_store"),
        *[F.col(f"web.{name}") for name in web.columns if name != key],
        *[F.col(f"store.{name}") for name in store.columns if name != key],
    )


def tagged_presence(web: DataFrame, store: DataFrame) -> DataFrame:
    """name, in_web, in_store from one grouping of both channels' names.

    Repeated names are folded before the exchange, so each task sends a name at most
    once per channel.
    """
    tagged = _tagged(web, F.lit(True)).unionByName(_tagged(store, F.lit(False)))
    return tagged.groupBy("name").agg(
        F.bool_or("from_web").alias("in_web"), F.bool_or(~F.col("from_web")).alias("in_store")
    )


def _tagged(names: DataFrame, from_web: Column) -> DataFrame:
    return names.select("name", from_web.alias("from_web"))


def last_row_per_key(relation: DataFrame, key: str, value: str, place: str) -> DataFrame:
    """key, value: a lookup where a repeated key keeps the value read last.

    ``place`` is the column to order rows by; of rows at one place the largest value counts.
    NULL keys and values are no lookup entries.  Tasks keep one row per key before the
    exchange.
    """
    last = Window.partitionBy(key).orderBy(F.desc(place), F.desc(value))
    return (
        relation.where(F.col(key).isNotNull())
        .withColumn("_row", F.row_number().over(last))
        .where("_row = 1")
        .where(F.col(value).isNotNull())
        .select(key, value)
    )
