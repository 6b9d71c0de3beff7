"""Ranked lexical search against a plain scoring of all documents."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from helpers import LOWER
from parity import compare, duck
from pyspark.sql import functions as F

from aislewise.llm import lexical_search, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_force(docs, items, k=10):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    counted = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    n_docs = sum(bool(c) for _, c in counted)
    whole = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for item_id, text in items:
        asked.setdefault(item_id, Counter()).update(terms(text))
    out = set()
    for item_id, own in asked.items():
        scores = []
        for doc_id, c in counted:
            if doc_id is None or not c:
                continue
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // whole
            score = sum(
                q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t, q in own.items()
                if c[t]
            )
            if score > 0:
                scores.append((-score, doc_id))
        out |= {(item_id, rank, d, -s) for rank, (s, d) in enumerate(sorted(scores)[:k], 1)}
    return out


def found(frame):
    return {tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()}


def test_terms_are_those_of_the_pattern():
    text = "Ab9_c É\x00ß--x@Y[z`{\x7f中 文  q\tÀ'b" + "w" * 50 + " 1.5"
    assert [t for some in lexical_search.terms_in_slices(text.encode()) for t in some] == [t.encode() for t in terms(text)]


def test_slices_do_not_cut_terms(monkeypatch):
    monkeypatch.setattr(lexical_search, "SLICE_BYTES", 7)
    text = "one twotwotwotwo  three, four" * 9
    assert [t.decode() for some in lexical_search.terms_in_slices(text.encode()) for t in some] == terms(text)


@pytest.mark.parametrize("query_bytes", [10**7, 40])
def test_awkward_rows(spark, awkward, awkward_rows, monkeypatch, query_bytes):
    monkeypatch.setattr(lexical_search, "QUERY_BYTES", query_bytes)
    items = [(1, "the of THE and"), (2, "word naïve 中文"), (3, None), (4, ""), (5, "absent"), (1, "tion"), (None, "cat's 42"), (6, "x" * 5000)]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    rows = [(r[0], r[1]) for r in awkward_rows] + [(3, "the of and"), (None, "the cat word")]
    docs = awkward.select("doc_id", "text").unionByName(spark.createDataFrame(rows[-2:], "doc_id long, text string"))
    docs = docs.withColumn("item_id", F.lit(9)).withColumn("n", F.lit("x")).withColumn("tf", F.lit(0))
    assert found(lexical_search.rank_documents(docs, table)) == brute_force(rows, items)


def test_ties_go_by_doc_id(spark):
    """Many equal documents over several strata: the bound of a stratum may equal the k-th score."""
    rows = [(500 - i, "alpha beta " + "other " * (i % 4)) for i in range(400)] + [(1000 + i, "gamma") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    items = [(1, "alpha"), (2, "alpha beta beta"), (3, "other gamma"), (4, "gamma")]
    table = spark.createDataFrame(items, "item_id long, text string")
    for k in (1, 3, 10):
        assert found(lexical_search.rank_documents(docs, table, k)) == brute_force(rows, items, k)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    blank = spark.createDataFrame([(1, ".."), (2, None)], "doc_id long, text string")
    for some in (docs, blank):
        assert lexical_search.rank_documents(some, items).count() == 0
    none = lexical_search.rank_documents(blank, items.where("item_id > 1"))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_leave_strata_out(monkeypatch):
    """With a high score at hand, strata of lower bounds are not visited."""
    import numpy as np

    m = np.array([25, 25, 100, 400, 400])
    strata = lexical_search.Strata(m, np.zeros(5, np.int64), np.array([3, 1, 1, 1, 1]), np.ones(5, np.int64), np.array([100]))
    assert strata.count == 3 and (np.diff(strata.bound) < 0).all()
    best = lexical_search.Best(1)
    seen = []
    monkeypatch.setattr(best, "add", lambda s, d: (seen.append(len(s)), lexical_search.Best.add(best, s, d)))
    strata.visit(np.array([0]), np.array([1]), best, np.arange(5))
    assert best.doc_ids.tolist() == [0] and seen == [2]


def test_query_against_sql(spark, sf_dir):
    frame = queries.op13_lexical_search(spark, sf_dir)
    assert compare(frame, duck(sf_dir), queries.ORACLE_SQL["op13_lexical_search"]) == []
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [tuple(r) for r in queries.documents(spark, sf_dir).select("doc_id", "text").collect()]
    assert found(frame) == brute_force(docs, items)
