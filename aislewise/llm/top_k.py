"""Exact top-k search by exhaustive term-at-a-time accumulation.

Queries and candidates are dealt into blocks of bounded size, and every query block meets every candidate
block once, as one group of rows.  There, each dimension is a term with a posting list (the candidates where
it is not zero, and their weights); a query scatters its weight times the list into a dense array of scores.
Partition selection takes each query's best of the block, and the best of all blocks are merged.  Scores are
integers, so the result does not depend on any order.

A group holds ``QUERY_BLOCK`` queries and ``CANDIDATE_BLOCK`` candidates whatever the size of the table, and
leaves k rows a query; candidates are copied once for each block of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 8192
#: Scores held at a time: one array of this many queries by the candidates of a block.
SCORED_TOGETHER = 64

_FOUND = "query_id long, vec_id long, score long"


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """One row a vector; a shorter vector has zeros at its end."""
    lengths = vectors.combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.combine_chunks().flatten().to_numpy()
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _block_best(query_ids, queries, candidate_ids, candidates, k: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(candidate_ids, kind="stable")
    candidate_ids, candidates = candidate_ids[order], candidates[order]
    postings = [np.flatnonzero(candidates[:, term]) for term in range(candidates.shape[1])]
    weights = [candidates[own, term] for term, own in enumerate(postings)]
    for at in range(0, len(queries), SCORED_TOGETHER):
        part, own_ids = queries[at : at + SCORED_TOGETHER], query_ids[at : at + SCORED_TOGETHER]
        scores = np.zeros((len(part), len(candidate_ids)), np.int64)
        for row, query in zip(scores, part, strict=True):
            for term in np.flatnonzero(query):
                row[postings[term]] += query[term] * weights[term]
        found: list[tuple[np.ndarray, ...]] = []
        for row, query_id in zip(scores, own_ids, strict=True):
            others = np.flatnonzero(candidate_ids != query_id)
            scored = row[others]
            if len(scored) > k:
                limit = np.partition(scored, len(scored) - k)[len(scored) - k]
                above = np.flatnonzero(scored > limit)
                # Candidates are in ascending vec_id, so the first of equal ones have the smaller ids.
                ties = np.flatnonzero(scored == limit)[: k - len(above)]
                best = np.concatenate([above, ties])
            else:
                best = np.arange(len(scored))
            found.append((np.full(len(best), query_id), candidate_ids[others[best]], scored[best]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"]
        )


def usable_vectors(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, vector) with components as doubles, of the rows without null or non-finite components."""
    vector = F.col(vector_column).cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return table.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & ~bad).select(
        F.col(id_column).cast("long").alias("id"), vector.alias("vector")
    )


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """Each query's ``k`` candidates of the highest inner product: query_id, rank from 1, vec_id, score.

    Both tables are (id long, vector array<long>), as ``scaled`` makes them.  A candidate of the query's own
    id is left out; ties go to the smaller id; with fewer than k candidates all are returned, and a query
    without any has no row.  A vector without components scores 0 with all.  Rows that repeat an id are each
    a candidate; of query rows that repeat an id all but the first in order of their vectors are dropped.
    """
    queries = queries.groupBy("id").agg(F.min("vector").alias("vector"))
    n_queries, width = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    n_candidates, other_width = candidates.agg(F.count("*"), F.max(F.size("vector"))).first()
    query_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    candidate_blocks = max(1, -(-n_candidates // CANDIDATE_BLOCK))
    width = max(width or 0, other_width or 0, 0)

    def numbers(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def block(n: int):
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    dealt_queries = queries.select(block(query_blocks).alias("q"), numbers(candidate_blocks).alias("c"), "*")
    dealt = candidates.select(numbers(query_blocks).alias("q"), block(candidate_blocks).alias("c"), "*")

    def best(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        batches = []
        if left.num_rows and right.num_rows:
            batches = list(
                _block_best(
                    left["id"].to_numpy(), _matrix(left["vector"], width),
                    right["id"].to_numpy(), _matrix(right["vector"], width), k,
                )
            )
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        return pa.Table.from_batches(batches, schema)

    found = dealt_queries.groupBy("q", "c").cogroup(dealt.groupBy("q", "c")).applyInArrow(best, _FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (
        found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def scaled(vectors: DataFrame, factor: int = 1024) -> DataFrame:
    """(id, vector) with every component x as the integer floor(factor * x)."""
    whole = F.transform("vector", lambda x: F.floor(x * F.lit(float(factor))).cast("long"))
    return vectors.select("id", whole.alias("vector"))
