"""Exact deduplication with the frequent digests split off.

1. One pass digests every text and writes (doc_id, digest) to the shared folder.
2. Misra-Gries counters, ``counters`` for each task and ``counters`` after merging, name the digests that may
   be frequent: every digest on more than two rows in ``counters`` is among them.
3. One more pass over the digests counts the candidates exactly, with partial sums in each task.
4. The verified winners, at most ``counters`` rows, are broadcast, and their rows are settled where they are.
   All other rows meet in an ordinary shuffle of digests, where no group is a large share of them.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import with_text, written

COUNTERS = 1024
_DIGEST, _KEY = "_llm_text_digest", "_llm_doc_key"


def _digests(texts: pa.Array) -> list[bytes]:
    # ascii_lower changes A-Z only.
    return [hashlib.sha256(t.as_buffer()).digest() for t in pc.ascii_lower(texts)]


def _add_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "")
        yield batch.append_column(_DIGEST, pa.array(_digests(texts), pa.binary()))


def _digest_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = pa.array(_digests(batch.column("text")), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), digests], ["doc_id", "digest"])


def misra_gries(counts: Counter, counters: int) -> Counter:
    """At most ``counters`` of the counts, each lowered by the largest one that is left out.

    Applied to sums of such summaries it gives a summary again: a key's count is too low by one row in
    ``counters`` at most, whatever the order of the merges.
    """
    if len(counts) <= counters:
        return counts
    ranked = counts.most_common(counters + 1)
    lowered_by = ranked[-1][1]
    return Counter({key: n - lowered_by for key, n in ranked[:-1] if n > lowered_by})


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` digests, with every one that is on more than two rows in ``counters``."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary: Counter = Counter()
        for batch in batches:
            for pair in pc.value_counts(batch.column("digest")):
                summary[pair["values"].as_py()] += pair["counts"].as_py()
            summary = misra_gries(summary, counters)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(summary.keys()), pa.binary()), pa.array(list(summary.values()), pa.int64())],
            ["digest", "n"],
        )

    merged = digests.select("digest").mapInArrow(summarise, "digest binary, n long").groupBy("digest")
    return (
        merged.agg(F.sum("n").alias("n"))
        .where("n > 1")
        .orderBy(F.desc("n"), "digest")
        .limit(counters)
        .select("digest")
    )


def duplicate_groups(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null is equal to the empty text.  The row with the
    largest doc_id stays; a null doc_id is smaller than any other.  Of rows that repeat both the doc_id and
    the text, one stays.  An empty table gives no row; columns other than ``doc_id`` and ``text`` are not read.
    """
    digests = written(
        # The position tells rows of one doc_id apart; it is fixed once the table is written.
        with_text(docs)
        .mapInArrow(_digest_only, "doc_id long, digest binary")
        .withColumn("position", F.monotonically_increasing_id()),
        "digests",
    )
    winner = F.max(F.struct(F.col("doc_id"), (-F.col("position")).alias("position"))).alias("winner")
    size = F.count(F.lit(1)).alias("group_size")
    candidates = F.broadcast(frequent_digests(digests, counters))
    frequent = written(digests.join(candidates, "digest").groupBy("digest").agg(winner, size), "frequent")

    heavy = digests.join(F.broadcast(frequent), "digest")
    rest = digests.join(F.broadcast(frequent.select("digest")), "digest", "left_anti")
    light = rest.join(rest.groupBy("digest").agg(winner, size), "digest")
    return heavy.unionByName(light).select(
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("position") == -F.col("winner.position")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``docs`` with one row of each text, the one that ``duplicate_groups`` keeps; its columns stay as they are."""
    kept = duplicate_groups(docs, counters).where("kept")
    # As text with a mark in front, a null id is a key like any other.
    key = F.concat(F.lit("="), F.col("doc_id").cast("long").cast("string"))
    kept = kept.select(F.coalesce(key, F.lit("")).alias(_KEY), F.unhex("text_sha256").alias(_DIGEST))
    rows = docs.mapInArrow(_add_digest, docs.select("*").schema.add(_DIGEST, "binary"))
    rows = rows.withColumn(_KEY, F.coalesce(key, F.lit("")))
    same = [_KEY, _DIGEST]
    return rows.join(kept, same, "left_semi").dropDuplicates(same).select(*docs.columns)
