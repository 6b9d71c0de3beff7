"""Connected components of a table of links, by smallest labels and pointer jumping.

Each round takes the smallest label of a vertex's neighbours (summed up in each task before the shuffle) and
then the label of that label; paths shrink by half or more a round.  Every round's labels are a table in the
shared folder: lineage stays short and a lost executor costs one round's task at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import removed, written


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links(a, b)``; the component is its smallest id."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(both.where("a <> b").distinct(), "edges")
    labels = written(
        edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("component")),
        "labels",
    )
    while True:
        near = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        lowered = labels.join(near, labels["id"] == near["a"]).select(
            "id", F.col("component").alias("before"), F.least("component", "near").alias("label")
        )
        root = labels.select(F.col("id").alias("label"), F.col("component").alias("root"))
        after = written(
            lowered.join(root, "label").select("id", "before", F.least("label", "root").alias("component")), "labels"
        )
        changed = not after.where("before <> component").isEmpty()
        removed(labels)
        labels = after.select("id", "component")
        if not changed:
            removed(edges)
            return labels
