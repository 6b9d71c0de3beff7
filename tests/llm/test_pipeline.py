"""The registered queries against their SQL, and each stage of the pipeline against a brute-force version."""

from __future__ import annotations

import collections

import corpus_pipeline
import pytest
from helpers import LOWER, near_components
from parity import compare, duck
from test_tokens import check_packing
from tokenizers import Tokenizer

from aislewise.llm import queries


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    frame = queries.QUERIES[name](spark, sf_dir)
    assert compare(frame, duck(sf_dir), queries.ORACLE_SQL[name]) == []


def test_stages(spark, sf_dir):
    source = queries.documents(spark, sf_dir)
    tables = [source]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], sf_dir).cache())
    texts = [[(r.doc_id, r.text) for r in t.collect()] for t in tables[:-1]]
    assert all(t.schema == source.schema for t in tables[:-1])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}

    # Language: no document of a known language goes.
    gone = {d for d, _ in texts[0]} - {d for d, _ in texts[1]}
    assert len(gone) <= 0.01 * len(texts[0])
    # Quality: the labels tell what goes.
    kept = {d for d, _ in texts[2]}
    assert sum((d in kept) == bool(labels[d]) for d, _ in texts[1] if d in labels) >= 0.97 * sum(d in labels for d, _ in texts[1])
    # Exact copies: the largest doc_id of each text stays.
    groups = collections.defaultdict(list)
    for doc_id, text in texts[2]:
        groups[(text or "").translate(LOWER)].append(doc_id)
    assert sorted(d for d, _ in texts[3]) == sorted(map(max, groups.values()))
    # Near copies: the smallest doc_id of each group stays.
    assert {d for d, _ in texts[4]} == {d for d, _, _, own in near_components(sorted(texts[3]), 5, 80) if own}
    check_packing(tables[-1].collect(), texts[4], Tokenizer.from_file(queries.BYTE_BPE), 1024)


def test_run_is_the_stages_one_after_the_other(spark, sf_dir):
    docs = queries.documents(spark, sf_dir)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    wanted = {r.doc_id: r.text for r in docs.collect()}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    check_packing(rows, list(wanted.items()), Tokenizer.from_file(queries.BYTE_BPE), 1024)
