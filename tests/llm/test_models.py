"""Language models, the quality classifier and top-k search."""

from __future__ import annotations

import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislewise.llm import language_id, quality, queries, tokens, top_k, work


def test_languages_of_held_out_documents(spark, sf_dir):
    langs = {r.doc_id: r.lang for r in queries.documents(spark, sf_dir).select("doc_id", "lang").collect()}
    rows = queries.op2_language_id(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(langs)
    for row in rows:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1)
        assert 0 <= row.score <= 1 and row.lang_pred in {*langs.values(), "und"}
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.95
    assert np.mean([r.rejected for r in rows]) < 0.02


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    codes, counts = np.unique(rng.integers(0, 1 << 18, 5000), return_counts=True)
    model = language_id.KneserNey.of(codes, counts)
    for context in (int(codes[7] >> 6), 4095, 0):
        every = (context << 6) | np.arange(64)
        assert np.isclose((2.0 ** model.log_probabilities(every)).sum(), 1)


def test_languages_of_awkward_rows(make_docs, awkward, awkward_rows):
    found = {r.doc_id: r for r in language_id.predict_languages(awkward).collect()}
    for row in awkward_rows:
        has_letter = any(c.isalpha() for c in row[1] or "")
        assert (found[row[0]].lang_pred == "und") == (not has_letter)
    assert language_id.predict_languages(make_docs([])).count() == 0
    unlabelled = make_docs([(1, "some text", None, None, None), (None, None, None, None, None)])
    assert {r.lang_pred for r in language_id.predict_languages(unlabelled).collect()} == {"und"}


def test_foreign_text_is_rejected_and_columns_stay(make_docs):
    rows = [(i, f"the cat and the dog number {i} went to the house of the man " * 8, "en", "s", i) for i in range(200)]
    strange = (900, "zxqj vvkq xxzj qqpz jjxw " * 40, None, None, None)
    table = make_docs([*rows, strange, (901, "1234", "en", None, None)])
    # Columns of the operator's own names pass through.
    clashing = table.withColumn("lang_pred", F.lit("x")).withColumn("rejected", F.lit(1))
    kept = language_id.drop_rejected(clashing)
    assert kept.schema == clashing.schema
    assert sorted(r.doc_id for r in kept.collect()) == list(range(200))


def test_limits_do_not_depend_on_the_sample(make_docs, monkeypatch):
    """A rare language of which the sample has a handful of rows at most keeps all of them."""
    rng = np.random.default_rng(3)

    def text(letters):
        return " ".join("".join(rng.choice(list(letters), rng.integers(2, 9))) for _ in range(60))

    rows = [(i, text("etaoinshrdlu"), "en", "s", None) for i in range(600)]
    rows += [(1000 + i, text("кволмьдщжюя"), "rare", "s", None) for i in range(30)]
    rows += [(2000, text("αβγδεζηθικ"), "single", "s", None)]
    table = make_docs(rows).cache()
    whole = language_id.fit(table)
    monkeypatch.setattr(language_id, "CALIBRATION_ROWS", 40)
    few = language_id.fit(table)
    assert set(few.limits) == set(whole.limits) == {"en", "rare", "single"}
    for lang, limit in whole.limits.items():
        assert np.allclose(few.limits[lang], limit)
    # One row says nothing of the spread: others do.
    assert few.limits["single"][1] >= few.limits["en"][1] > 0.01
    assert language_id.drop_rejected(table).count() == len(rows)


def test_quality_separates_the_labels(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.op3_quality(spark, sf_dir).collect()
    assert len(rows) == queries.documents(spark, sf_dir).count()
    right = [r.kept == bool(labels[r.doc_id]) for r in rows if r.doc_id in labels]
    assert np.mean(right) > 0.97


def test_sparse_sites_have_their_parents_rate(make_docs):
    """Texts say nothing here: the posteriors of sites are their shrunk rates."""
    rows, labels = [], []
    for host, n, good in (("large", 300, 0.9), ("other", 300, 0.3), ("small", 1, 0.0)):
        for i in range(n):
            doc_id = len(rows)
            rows.append((doc_id, "same words", None, host, None))
            labels.append((doc_id, int(i < good * n)))
    table = make_docs(rows)
    spark = table.sparkSession
    scored = quality.score_quality(
        table, spark.createDataFrame(labels, "doc_id long, quality int"), F.col("source"), F.lit("p")
    )
    found = {r.host: r.p for r in scored.join(table, "doc_id").groupBy(F.col("source").alias("host")).agg(F.avg("path_posterior").alias("p")).collect()}
    assert abs(found["large"] - 0.9) < 0.02 and abs(found["other"] - 0.3) < 0.02
    assert 0.45 < found["small"] < 0.75


def test_quality_of_awkward_rows(spark, make_docs, awkward, awkward_rows):
    labels = spark.createDataFrame([(3, 1), (6, 0), (6, 1), (None, 1), (9, None)], "doc_id long, quality int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    for own in (labels, none):
        rows = quality.score_quality(awkward, own, F.col("source"), F.col("lang")).collect()
        assert len(rows) == len(awkward_rows)
        assert all(0 <= r.quality <= 1 for r in rows)
    assert all(r.kept for r in rows)
    assert quality.score_quality(make_docs([]), labels, F.col("source"), F.col("lang")).count() == 0
    kept = quality.drop_poor(awkward, none, F.col("source"), F.col("lang"))
    assert kept.count() == len(awkward_rows) and kept.schema == awkward.schema


def test_poor_rows_go_each_on_its_own(spark, make_docs):
    """A good and a poor row share a doc_id, and others have none."""
    good = "The people of the town came to the house, and they were glad of it. "
    poor = "$$ @@ ## 77 || ~~ ^^ BUY >> << {} [] 99 "
    rows = [(i, (good if i % 2 else poor) * (5 + i % 7), "en", "s", None) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    odd = [(d, text * 6, "en", "s", None) for d in (900, None) for text in (good, poor)]
    kept = quality.drop_poor(make_docs([*rows, *odd]), labels, F.col("source"), F.col("lang"))
    found = sorted(((r.doc_id, r.text) for r in kept.collect() if r.doc_id is None or r.doc_id >= 400), key=str)
    assert found == sorted([(900, good * 6), (None, good * 6)], key=str)


def brute_force_top(vectors, queries_, k):
    out = set()
    for query_id, query in queries_.items():
        scores = sorted(((-int(np.dot(query, v)), i) for i, v in vectors if i != query_id))[:k]
        out |= {(query_id, rank, i, -score) for rank, (score, i) in enumerate(scores, 1)}
    return out


@pytest.mark.parametrize(("query_block", "candidate_block"), [(2048, 8192), (3, 10)])
def test_top_k_with_ties(spark, monkeypatch, query_block, candidate_block):
    monkeypatch.setattr(top_k, "QUERY_BLOCK", query_block)
    monkeypatch.setattr(top_k, "CANDIDATE_BLOCK", candidate_block)
    rng = np.random.default_rng(2)
    vectors = [(i, rng.integers(-2, 3, 4).tolist()) for i in range(80)]
    table = spark.createDataFrame(vectors, "id long, vector array<long>")
    found = {tuple(r) for r in top_k.exact_top_k(table.where("id % 9 = 0"), table, 10).collect()}
    assert found == brute_force_top(vectors, {i: v for i, v in vectors if i % 9 == 0}, 10)


def test_top_k_leaves_out_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, None), (2, [nan, 1.0]), (3, [inf, 0.0]), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, [-0.1, 0.3]), (6, [0.2])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = top_k.scaled(top_k.usable_vectors(table))
    scaled = dict(map(tuple, vectors.collect()))
    assert scaled == {0: [1024, 512], 5: [-103, 307], 6: [204]}
    found = [tuple(r) for r in top_k.exact_top_k(vectors.where("id = 0"), vectors, 10).orderBy("rank").collect()]
    assert found == [(0, 1, 6, 204 * 1024), (0, 2, 5, -103 * 1024 + 307 * 512)]
    empty = vectors.where("id > 100")
    assert top_k.exact_top_k(empty, vectors).count() == 0 and top_k.exact_top_k(vectors, empty).count() == 0


def test_top_k_query(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    vectors = [(r.vec_id, np.floor(1024 * np.array(r.embedding, float)).astype(int)) for r in table]
    found = {tuple(r) for r in queries.op5_top_k(spark, sf_dir).collect()}
    assert found == brute_force_top(vectors, {i: v for i, v in vectors if i % 100 == 0}, 10)


def test_a_slice_of_texts_takes_little_memory():
    words = "the quick brown fox jumps over the lazy dog " * 5
    (texts,) = language_id._slices(iter([words] * (language_id.SLICE_CHARS // len(words) + 1)))
    language_id.sequences(["a"])
    tracemalloc.start()
    language_id.sequences(texts)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 30_000_000


def test_a_worker_keeps_one_thing():
    made = []
    for key in ("a", "a", "b", "a"):
        assert work.kept_by_worker(key, lambda key=key: made.append(key) or key) == key
    assert made == ["a", "b", "a"]
    encoder = tokens.encoder(queries.BYTE_BPE)
    assert tokens.encoder(queries.BYTE_BPE) is encoder
    language_id.sequences(["a"])
    assert tokens.encoder(queries.BYTE_BPE) is not encoder
