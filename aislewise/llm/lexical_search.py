"""Ranked lexical search over a length-stratified index.

A document's normaliser m depends on its length alone, so documents of one m form a stratum, and within a
stratum a term's share in a score depends on its tf alone.  The index is the documents in order of m, dealt
into ranges; a task takes its range a batch at a time and inverts it: postings by term, stratum and tf, with
one impact for each (term, stratum, tf).  The highest tf of a term in a stratum bounds what the term can add
there.  A query visits strata in descending order of their bounds, in groups of doubling size, and stops where
a bound is below its k-th score so far; the k best of all ranges are merged.  All scores are integers, so the
result depends on no order.

A stratum of any size is cut by the range partitioning, as ranges are of (m, doc_id).  Queries are taken in
blocks of ``QUERY_BYTES`` of text; for each block the documents are read once, and only postings of the
block's terms are kept.  What the driver gets is one row a term of the block.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .work import removed, written

QUERY_BYTES = 16_000_000
#: Bytes of a text that are cut into terms at a time.
SLICE_BYTES = 1_000_000

#: Terms are runs of these bytes (digits, letters, all beyond ASCII), A-Z lower-cased.
_TERM_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_FOLDED = bytes(ord(chr(b).lower()) if b < 0x80 else b for b in range(256))
_SPACED = bytes(_FOLDED[b] if b in _TERM_BYTES else 0x20 for b in range(256))

_COUNTED = "doc_id long, n long, term array<int>, tf array<long>"
_FOUND = "item_id long, doc_id long, score long"


def terms_in_slices(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, some at a time: no byte of a character beyond ASCII is a separator."""
    spaced = text.translate(_SPACED)
    at = 0
    while at < len(spaced):
        end = spaced.find(b" ", at + SLICE_BYTES)
        end = len(spaced) if end < 0 else end
        yield spaced[at:end].split()
        at = end


@dataclass(frozen=True)
class QueryBlock:
    """Items with the numbers of their terms and how often each holds them."""

    items: list[int | None]
    terms: list[np.ndarray]
    times: list[np.ndarray]
    number_of: dict[bytes, int]

    @classmethod
    def of(cls, rows: list[tuple[int | None, bytes]]) -> QueryBlock:
        counts: dict[int | None, Counter] = {}
        number_of: dict[bytes, int] = {}
        for item, text in rows:
            own = counts.setdefault(item, Counter())
            for some in terms_in_slices(text):
                own.update(number_of.setdefault(term, len(number_of)) for term in some)
        return cls(
            list(counts),
            [np.array(list(c), np.int64) for c in counts.values()],
            [np.array(list(c.values()), np.int64) for c in counts.values()],
            number_of,
        )


def _query_blocks(items: DataFrame) -> Iterator[QueryBlock]:
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.encode("text", "UTF-8").alias("text"))
    texts = texts.where("text IS NOT NULL")
    whole = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-whole // QUERY_BYTES))
    for block in range(blocks):
        mine = texts.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        yield QueryBlock.of([(r.item_id, bytes(r.text)) for r in mine.collect()])


def count_terms(docs: DataFrame, number_of: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, term, tf): a document's length in terms, and how often it holds each numbered term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = number_of.get
        for batch in batches:
            lengths, terms, tfs = [], [], []
            for text in batch.column("text"):
                found: Counter = Counter()
                n = 0
                for some in terms_in_slices(text.as_buffer().to_pybytes() if text.is_valid else b""):
                    n += len(some)
                    found.update(map(number, some))
                found.pop(None, None)
                lengths.append(n)
                terms.append(list(found))
                tfs.append(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(lengths, pa.int64()),
                    pa.array(terms, pa.list_(pa.int32())),
                    pa.array(tfs, pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "term", "tf"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text"))
    return texts.mapInArrow(count, _COUNTED)


class Strata:
    """Some documents of the index, inverted: postings in order of term, stratum and tf."""

    def __init__(self, m: np.ndarray, term: np.ndarray, tf: np.ndarray, held: np.ndarray, weight: np.ndarray) -> None:
        """``m`` ascending, one each document; ``term`` and ``tf`` of document after document, ``held`` of each."""
        self.documents = len(m)
        values, stratum = np.unique(m, return_inverse=True)
        document = np.repeat(np.arange(len(m)), held)
        order = np.lexsort((document, tf, stratum[document], term))
        self.document, term, tf = document[order], term[order], tf[order]
        self.stratum = stratum[self.document]
        self.count = len(values)

        def starts(*columns: np.ndarray) -> np.ndarray:
            changed = np.ones(len(term), bool)
            changed[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
            return np.flatnonzero(changed)

        # One impact for each term, stratum and tf.
        first = starts(term, self.stratum, tf)
        impact = weight[term[first]] * (1_000_000_000 * tf[first] // (1000 * tf[first] + 8 * values[self.stratum[first]]))
        self.impact = np.repeat(impact, np.diff(np.append(first, len(term))))
        # Impacts grow with tf: the last posting of a term in a stratum has the highest.
        last = np.append(starts(term, self.stratum), len(term))[1:] - 1
        self.bound_stratum, self.bound = self.stratum[last], self.impact[last]
        numbers = np.arange(len(weight) + 1)
        self.postings = np.searchsorted(term, numbers)
        self.bounds = np.searchsorted(term[last], numbers)

    def visit(self, terms: np.ndarray, times: np.ndarray, best: Best, doc_ids: np.ndarray) -> None:
        bounds = np.zeros(self.count, np.int64)
        held = []
        for term, n in zip(terms.tolist(), times.tolist(), strict=True):
            low, high = self.bounds[term], self.bounds[term + 1]
            if low < high:
                bounds[self.bound_stratum[low:high]] += n * self.bound[low:high]
                held.append((n, slice(self.postings[term], self.postings[term + 1])))
        order = np.argsort(-bounds, kind="stable")
        at, size = 0, 1
        while at < len(order):
            group = order[at : at + size]
            # A stratum whose bound equals the k-th score may hold an equal score of a smaller id.
            group = group[bounds[group] >= best.threshold]
            if not len(group):
                break
            chosen = np.zeros(self.count, bool)
            chosen[group] = True
            scores = np.zeros(self.documents, np.int64)
            for n, own in held:
                here = chosen[self.stratum[own]]
                scores[self.document[own][here]] += n * self.impact[own][here]
            found = np.flatnonzero(scores >= best.threshold)
            best.add(scores[found], doc_ids[found])
            at, size = at + size, size * 2


class Best:
    """The k highest scores so far, equal ones by ascending doc_id."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.scores = np.empty(0, np.int64)
        self.doc_ids = np.empty(0, np.int64)

    @property
    def threshold(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, doc_ids: np.ndarray) -> None:
        scores, doc_ids = np.append(self.scores, scores), np.append(self.doc_ids, doc_ids)
        if len(scores) > self.k:
            enough = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, doc_ids = scores[enough], doc_ids[enough]
        order = np.lexsort((doc_ids, -scores))[: self.k]
        self.scores, self.doc_ids = scores[order], doc_ids[order]


def _ranges_best(queries: QueryBlock, weight: np.ndarray, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries.items]
        for batch in batches:
            if not batch.num_rows:
                continue
            doc_ids = batch.column("doc_id").to_numpy()
            term, tf = batch.column("term"), batch.column("tf")
            strata = Strata(
                batch.column("m").to_numpy(),
                term.flatten().to_numpy().astype(np.int64),
                tf.flatten().to_numpy(),
                term.value_lengths().to_numpy(zero_copy_only=False),
                weight,
            )
            for own, terms, times in zip(best, queries.terms, queries.times, strict=True):
                strata.visit(terms, times, own, doc_ids)
        items = [item for item, own in zip(queries.items, best, strict=True) for _ in own.scores]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(items, pa.int64()),
                pa.array(np.concatenate([np.empty(0, np.int64), *(b.doc_ids for b in best)])),
                pa.array(np.concatenate([np.empty(0, np.int64), *(b.scores for b in best)])),
            ],
            ["item_id", "doc_id", "score"],
        )

    return search


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Each item's ``k`` documents of the highest score above 0: item_id, rank from 1, doc_id, score.

    ``docs`` is (doc_id, text), ``items`` (item_id, text).  Equal scores go by ascending doc_id; with fewer
    than k documents of a score above 0 all are returned, and an item without any has no row.  A null text has
    no term.  Rows that repeat a doc_id are a document each.  A document without a doc_id counts in the number
    of documents, their lengths and the documents of a term, but is not returned.  Rows that repeat an item_id
    are one item that has the terms of all of them; a null item_id is an id like others.  Empty tables give no
    row; other columns are not read.
    """
    spark = docs.sparkSession
    found = [_block_best(docs, block, k) for block in _query_blocks(items)]
    found = [some for some in found if some is not None]
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    merged = found[0]
    for some in found[1:]:
        merged = merged.unionByName(some)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _block_best(docs: DataFrame, queries: QueryBlock, k: int) -> DataFrame | None:
    """(item_id, doc_id, score): the k best of each range of the index, for one block of queries."""
    if not queries.number_of:
        return None
    counted = written(count_terms(docs, queries.number_of), "term-counts")
    documents, whole = counted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not documents:
        removed(counted)
        return None
    # One row a term of the block.
    holders = counted.select(F.explode("term").alias("term")).groupBy("term").count().collect()
    weight = np.zeros(len(queries.number_of), np.int64)
    for row in holders:
        weight[row["term"]] = math.floor(1000.0 * math.log((2 * documents + 2) / (2 * row["count"] + 1)))
    share = f"CAST(75 * n AS DECIMAL(20, 0)) * CAST({documents} AS DECIMAL(18, 0)) DIV CAST({whole} AS DECIMAL(18, 0))"
    index = (
        counted.where((F.size("term") > 0) & F.col("doc_id").isNotNull())
        .select("doc_id", F.expr(f"CAST(100 - 75 + ({share}) AS BIGINT)").alias("m"), "term", "tf")
        .repartitionByRange("m", "doc_id")
        .sortWithinPartitions("m", "doc_id")
    )
    return index.mapInArrow(_ranges_best(queries, weight, k), _FOUND)
