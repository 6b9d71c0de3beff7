"""Near-duplicate groups by HyperMinHash, every link confirmed on the full sets.

1. A text becomes the set of its word shingles, of 128 bits each, and the set 256 registers.  Texts of one set are
   one class from here on, whatever their doc_ids; classes that share a doc_id are linked.
2. Bands of six registers, empty ones filled from others, are bucket keys.  Two sets at the threshold of 0.85
   meet in none of the 42 bands with a chance of about 2e-9 (at 0.8, 3e-6).
3. Each member of a bucket is compared with the bucket's smallest member on the full sets, and the links give
   components.  A bucket whose members are then in one component is done.
4. In the others, members of different components are compared: first by the collision-corrected estimate from
   1,024 registers, which passes everything that is not five standard errors below the threshold, then on the
   full sets.  Large buckets are cut into blocks, so no task holds a whole bucket.  In a first round each member
   sends on its best partner in its own block alone, which joins most of what is one component.  In a second one
   all pairs that are still across components go on, each from the first band they share: the blocks of a
   bucket's largest component meet those of its other rows, and these meet each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .components import components
from .work import with_text, written

BAND_ROWS = 6
BLOCK = 512
#: Sets that travel together.
_SETS = 16
#: Bits of the bucket number in the registers that estimates are made from.
FINE_BITS = 10
#: Standard errors below the threshold at which an estimate rules a pair out.
ERRORS = 5.0


def _set_key(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, registers = [], [], []
            for text in batch.column("text"):
                own = S.shingle_set(text.as_py(), words)
                sizes.append(own.shape[1])
                keys.append(_set_key(own) if own.shape[1] else None)
                registers.append(S.registers(own[0]).tobytes() if own.shape[1] else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(registers, pa.binary())],
                ["doc_id", "n_shingles", "set_key", "registers"],
            )

    schema = "doc_id long, n_shingles long, set_key binary, registers binary"
    return written(with_text(docs).mapInArrow(sketch, schema), "sketches")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bands = S.BUCKETS // BAND_ROWS
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            keys = [S.band_keys(np.frombuffer(r.as_py(), np.uint16), BAND_ROWS) for r in part.column("registers")]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(keys)),
                    pa.array(np.tile(np.arange(bands, dtype=np.int32), len(keys))),
                    pa.array(np.repeat(part.column("class_id").to_numpy(), bands)),
                ],
                ["key", "band", "class_id"],
            )


def _sets(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(class_id, shingles) of the classes given, each made from a text of its representative."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A set may be as large as its text, so that few of them make a batch.
            for at in range(0, batch.num_rows, _SETS):
                texts = batch.column("text").slice(at, _SETS)
                sets = [S.shingle_set(text.as_py(), words) for text in texts]
                keys = [_set_key(own) for own in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array([own.tobytes() for own in sets], pa.binary())], ["set_key", "shingles"]
                )

    ids = classes.select(F.col("representative").alias("doc_id")).distinct()
    made = with_text(docs).join(ids, "doc_id", "left_semi").mapInArrow(full, "set_key binary, shingles binary")
    # Rows that repeat a doc_id may have made a set several times.
    rows = made.join(classes.select("set_key", "class_id"), "set_key").select("class_id", "shingles")
    return written(rows.dropDuplicates(["class_id"]), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
                one, two = S.lanes(left.as_buffer()), S.lanes(right.as_buffer())
                both = S.shared(one, two)
                keep.append(100 * both >= percent * (one.shape[1] + two.shape[1] - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("class_id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("class_id").alias("b"), F.col("shingles").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(compare, "a long, b long")


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = (S.lanes(own.as_buffer())[0] for own in batch.column("shingles"))
        fine = pa.array([S.registers(own, FINE_BITS).tobytes() for own in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("class_id"), fine], ["class_id", "fine"])


def _least_estimate(used: np.ndarray, n: int, m: np.ndarray, threshold: float) -> np.ndarray:
    """What an estimate from ``used`` registers is at least, for sets of ``n`` and ``m`` at the threshold.

    Each register that is filled draws one element of the union, none twice: a hypergeometric sample.
    """
    union = np.maximum((n + m) / (1 + threshold), used)
    undrawn = (union - used) / np.maximum(union - 1, 1)
    error = np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1) * undrawn)
    return threshold - ERRORS * error - 1 / np.maximum(used, 1)


def _blocks(rows: str | Column) -> Column:
    return F.ceil(rows / F.lit(BLOCK)).cast("long")


def _mixed(grouped: DataFrame, best_only: bool) -> DataFrame:
    """The keys of buckets with several components; but for ``best_only``, with the largest one and its rows."""
    if best_only:
        ends = grouped.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"))
        return ends.where("least < most").select("key")
    n_rows = grouped.groupBy("key", "component").agg(F.count("*").alias("n"))
    most = n_rows.groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("n_components"))
    return most.where("n_components > 1").select("key", F.col("most.n").alias("n_largest"), F.col("most.component").alias("largest"))


def _dealt(rows: DataFrame, best_only: bool) -> DataFrame:
    """The rows of every bucket with their ``block``, and the runs (key, low, high) of one block or two to be compared.

    With ``best_only``, each block is a run of its own, so no row is repeated.  Otherwise a bucket's largest
    component (``largest``, of ``n_largest`` rows) has blocks of its own behind those of all other rows, and only
    the others' blocks meet every block: rows of that component are as many as before for up to ``BLOCK`` others.
    """
    number = F.xxhash64("class_id")
    if best_only:
        block = F.pmod(number, _blocks(F.col("members")))
        return rows.withColumn("block", block).withColumn("low", F.col("block")).withColumn("high", F.col("block"))
    of_others, of_largest = _blocks(F.col("members") - F.col("n_largest")), _blocks(F.col("n_largest"))
    other = F.col("component") != F.col("largest")
    block = F.when(other, F.pmod(number, of_others)).otherwise(of_others + F.pmod(number, of_largest))
    n_met = F.when(other, of_others + of_largest).otherwise(of_others)
    return (
        rows.withColumn("block", block)
        .withColumn("met", F.explode(F.sequence(F.lit(0).cast("long"), n_met - 1)))
        .withColumn("low", F.least("block", "met"))
        .withColumn("high", F.greatest("block", "met"))
        .drop("met", "members", "largest", "n_largest")
    )


def _across(rows: DataFrame, percent: int, best_only: bool) -> DataFrame:
    """Pairs (a, b) of different components in one bucket whose estimates do not rule them out.

    With ``best_only``, each row's best partner in another component alone, of those in its own block.
    """
    threshold = percent / 100

    def run(own: pa.Table) -> pa.RecordBatch:
        ids, groups = own["class_id"].to_numpy(), own["component"].to_numpy()
        # A bucket of lent registers may hold a class twice, in two bands.
        _, unique = np.unique(ids, return_index=True)
        own = own.take(pa.array(unique))
        ids, groups, sizes = ids[unique], groups[unique], own["n_shingles"].to_numpy()
        blocks, pivot = own["block"].to_numpy(), own["pivot"].to_numpy()[0]
        (low,), (high,), (band,) = (own[c].unique().to_pylist() for c in ("low", "high", "band"))
        coarse, sketches = (
            np.stack([np.frombuffer(r.as_buffer(), np.uint16) for r in own[c].combine_chunks()])
            for c in ("registers", "fine")
        )
        values = np.stack([S.filled(r) for r in coarse])[:, : S.BUCKETS // BAND_ROWS * BAND_ROWS]
        best, partner = np.full(len(ids), -1.0), np.zeros(len(ids), np.int64)
        a, b = [], []
        for i in range(len(ids) - 1):
            # Pairs within a block belong to the run of that block alone, those with the pivot are settled.
            later = slice(i + 1, None)
            other = (groups[later] != groups[i]) & (ids[later] != pivot)
            other &= (blocks[later] != blocks[i]) if low != high else True
            fewer = np.minimum(sizes[later], sizes[i])
            other &= 100 * fewer >= percent * np.maximum(sizes[later], sizes[i])
            at = np.flatnonzero(other) + i + 1
            if ids[i] == pivot or not len(at):
                continue
            estimate, used = S.jaccard_estimates(sketches[i], sizes[i], sketches[at], sizes[at])
            likely = estimate >= _least_estimate(used, sizes[i], sizes[at], threshold)
            at, estimate = at[likely], estimate[likely]
            if best_only and len(at):
                better = estimate > best[at]
                best[at[better]], partner[at[better]] = estimate[better], i
                if estimate.max() > best[i]:
                    best[i], partner[i] = estimate.max(), at[estimate.argmax()]
            elif len(at):
                equal = (values[at] == values[i]).reshape(len(at), -1, BAND_ROWS).all(axis=2)
                at = at[equal.argmax(axis=1) == band]
                a.append(np.full(len(at), ids[i]))
                b.append(ids[at])
        if best_only:
            found = np.flatnonzero(best >= 0)
            a, b = [np.minimum(ids[found], ids[partner[found]])], [np.maximum(ids[found], ids[partner[found]])]
        columns = [pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in (a, b)]
        return pa.RecordBatch.from_arrays(columns, ["a", "b"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (key, low, high); each run of equal keys is one block or two."""
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("key", "low", "high")], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if start == end:
                    continue
                if last is not None and tuple(key[start]) != last:
                    yield run(pa.Table.from_batches(held))
                    held = []
                last = tuple(key[start])
                held.append(batch.slice(start, end - start))
        if held:
            yield run(pa.Table.from_batches(held))

    place = ["key", "low", "high"]
    dealt = _dealt(rows, best_only).repartition(*place).sortWithinPartitions(*place)
    return dealt.mapInArrow(walk, "a long, b long")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) with further links; ids that had no component yet come in with them."""
    left = labels.select(F.col("id").alias("a"), F.col("component").alias("left"))
    right = labels.select(F.col("id").alias("b"), F.col("component").alias("right"))
    between = links.join(left, "a", "left").join(right, "b", "left")
    between = between.select(F.coalesce("left", "a").alias("a"), F.coalesce("right", "b").alias("b"))
    over = components(written(between, "links"))
    known = labels.join(over.select(F.col("id").alias("component"), F.col("component").alias("over")), "component", "left")
    known = known.select("id", F.coalesce("over", "component").alias("component"))
    new = over.join(labels, "id", "left_anti")
    return written(known.unionByName(new), "labels")


def _classes(sketches: DataFrame) -> DataFrame:
    """class_id, set_key, representative (its smallest doc_id), n_shingles, registers of every set that has a doc_id."""
    linkable = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    alike = linkable.groupBy("set_key").agg(
        F.min("doc_id").alias("representative"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("registers").alias("registers"),
    )
    # Numbers are drawn once and written with their rows.
    return written(alike.withColumn("class_id", F.monotonically_increasing_id()), "classes")


def _same_document(sketches: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between classes that share a doc_id: all others of the doc_id with the first."""
    of_rows = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "set_key")
    repeated = of_rows.groupBy("doc_id").agg(F.min("set_key").alias("least"), F.max("set_key").alias("most")).where("least < most")
    several = of_rows.join(repeated, "doc_id").where("set_key <> least").select("least", "set_key").distinct()
    a = classes.select(F.col("set_key").alias("least"), F.col("class_id").alias("a"))
    return several.join(a, "least").join(classes.select("set_key", F.col("class_id").alias("b")), "set_key").select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= ``percent`` * union of their shingle sets; the component
    is the smallest doc_id that links reach.  A text without words, or null, has no shingle and is linked with
    nothing.  A row with a null doc_id is linked with nothing and has a null component; it is kept.  Rows that
    repeat a doc_id are one document, with the links of all its texts that have words.  An empty table gives no
    row; columns other than ``doc_id`` and ``text`` are not read.
    """
    sketches = _sketches(docs, words)
    classes = _classes(sketches)
    bands = classes.select("class_id", "registers").mapInArrow(_bands, "key long, band int, class_id long")
    shared = bands.groupBy("key").agg(F.min("class_id").alias("pivot"), F.count("*").alias("members"))
    buckets = written(bands.join(shared.where("members > 1"), "key"), "buckets")
    met = classes.join(buckets.select("class_id").distinct(), "class_id", "left_semi")
    sets = _sets(docs, met.select("class_id", "set_key", "representative"), words)

    with_pivot = buckets.where("class_id <> pivot").select(F.col("pivot").alias("a"), F.col("class_id").alias("b"))
    confirmed = _confirmed(with_pivot.distinct(), sets, percent)
    labels = components(written(confirmed.unionByName(_same_document(sketches, classes)), "links"))

    fine = sets.mapInArrow(_fine, "class_id long, fine binary")
    coarse = classes.select("class_id", "n_shingles", "registers")
    for best_only in (True, False):
        grouped = buckets.where("members > 2").join(labels.withColumnRenamed("id", "class_id"), "class_id", "left")
        grouped = grouped.withColumn("component", F.coalesce("component", "class_id"))
        mixed = _mixed(grouped, best_only)
        open_buckets = grouped.join(mixed, "key")
        rows = open_buckets.join(coarse, "class_id").join(fine, "class_id")
        across = written(_across(rows, percent, best_only).distinct(), "across")
        labels = _joined(labels, written(_confirmed(across, sets, percent), "links"))

    of_class = classes.select("class_id", "set_key", "representative").join(
        labels.withColumnRenamed("id", "class_id"), "class_id", "left"
    )
    of_class = of_class.withColumn("component", F.coalesce("component", "class_id"))
    least = of_class.groupBy("component").agg(F.min("representative").alias("component_id"))
    of_class = of_class.join(least, "component").select("set_key", "component_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return (
        sketches.join(of_class, "set_key", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest doc_id; all columns stay as they are."""
    gone = near_duplicates(docs, words, percent).where("NOT kept").select(F.col("doc_id").alias("_llm_gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_llm_gone"), "left_anti")
