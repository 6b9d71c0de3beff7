"""The toxicity network: its gradients, its windows, and held-out accuracy."""

from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from aislewise.llm import gated_network, queries, toxicity


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    parameters = {k: v.astype(float) for k, v in gated_network.new_parameters(5, rng).items()}
    inputs = rng.standard_normal((9, 5))
    words, mask = rng.integers(0, 9, (4, 6)), np.ones((4, 6))
    mask[1, 3:] = mask[2, 1:] = 0
    slope = rng.standard_normal(4)

    def loss():
        gates = gated_network.projected(parameters, inputs)
        return float(gated_network.forward(parameters, gates, words, mask)[0] @ slope)

    gates = gated_network.projected(parameters, inputs)
    _, found = gated_network.forward(parameters, gates, words, mask, keep=True)
    grown, d_gates = gated_network.backward(parameters, words, mask, found, slope)
    for way, places in d_gates.items():
        by_input = np.zeros((9, places.shape[2]))
        np.add.at(by_input, words.T, places)
        grown[f"{way}_input"] = inputs.T @ by_input
    assert set(grown) == set(parameters)
    for name, values in parameters.items():
        for at in rng.integers(0, values.size, 6):
            before = values.flat[at]
            values.flat[at] = before + 1e-3
            up = loss()
            values.flat[at] = before - 1e-3
            down = loss()
            values.flat[at] = before
            assert np.isclose((up - down) / 2e-3, np.asarray(grown[name]).flat[at], rtol=0.02, atol=2e-3), name


def test_masked_places_do_not_matter():
    rng = np.random.default_rng(2)
    parameters = gated_network.new_parameters(3, rng)
    gates = gated_network.projected(parameters, rng.standard_normal((7, 3)).astype(np.float32))
    words, mask = rng.integers(0, 7, (2, 8)), np.ones((2, 8), np.float32)
    mask[:, 5:] = 0
    whole = gated_network.forward(parameters, gates, words, mask)[0]
    short = gated_network.forward(parameters, gates, words[:, :5], mask[:, :5])[0]
    assert np.allclose(whole, short, atol=1e-6)


def test_windows_cover_all_words():
    counts = np.array([0, 1, toxicity.WINDOW, toxicity.WINDOW + 1, 0, 1000])
    ids = np.arange(counts.sum())
    starts, document = toxicity.windows_of(counts)
    words, mask = toxicity.window_words(ids, counts, starts, document, -1)
    offsets = np.cumsum(counts) - counts
    for i, n in enumerate(counts):
        own = words[document == i][mask[document == i] > 0]
        expected = set(range(offsets[i], offsets[i] + n)) or {-1}
        assert set(own.tolist()) == expected
        first = np.sort(starts[document == i])
        assert (np.diff(first) == toxicity.STRIDE).all()
        # No window lies within the one before it, and none is beyond the end.
        assert len(first) == 1 or first[-2] + toxicity.WINDOW < offsets[i] + n <= first[-1] + toxicity.WINDOW


def test_words_have_the_same_buckets_in_any_company(monkeypatch):
    words = [b"a", b"clown", "é".encode(), b"x" * 300, b"clowns"]
    together = toxicity.Words(words)
    monkeypatch.setattr(toxicity, "HASHED_TOGETHER", 2)
    in_parts = toxicity.Words(words)
    for name in ("rate_bucket", "embedding_bucket", "sequences", "first", "short", "short_first"):
        assert np.array_equal(getattr(together, name), getattr(in_parts, name)), name
    for i, word in enumerate(words):
        alone = toxicity.Words([word])
        assert alone.rate_bucket[0] == together.rate_bucket[i]
        own = slice(together.first[i], together.first[i + 1])
        assert sorted(alone.sequences) == sorted(together.sequences[own]) and len(alone.sequences) > 0


def made_documents(n, seed, toxic_share=0.2):
    """Words of random syllables; toxic documents have some of a stem with an ending of its own."""
    draw = random.Random(seed)
    syllables = "ba ke lo mi nu ra se ti vo du fe ga".split()
    rows, labels = [], []
    for i in range(n):
        words = ["".join(draw.choices(syllables, k=draw.randint(1, 4))) for _ in range(draw.choice([8, 40, 300]))]
        toxic = draw.random() < toxic_share
        if toxic:
            for _ in range(draw.randint(1, 4)):
                words.insert(draw.randrange(len(words) + 1), "zwox" + "".join(draw.choices(syllables, k=2)))
        rows.append((i, " ".join(words).capitalize() + ".", None, None, None))
        labels.append((i, int(toxic)))
    return rows, labels


def test_new_words_of_a_toxic_stem_are_found(spark, make_docs):
    rows, labels = made_documents(900, 3)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.predict_toxicity(make_docs(rows), table).collect()}
    held = [(found[i].predicted, y) for i, y in labels if found[i].held_out]
    assert len(held) > 250
    assert np.mean([p for p, y in held if y]) > 0.9
    assert np.mean([p for p, y in held if not y]) < 0.03


def test_one_toxic_word_in_a_very_long_text(spark, make_docs):
    rows, labels = made_documents(600, 4)
    network = toxicity.fit(make_docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    clean = [words for (_, words, *_), (_, y) in zip(rows, labels) if not y]
    long = " ".join(clean) * 12
    middle = long.index(" ", len(long) // 2)
    texts = [(1, long[:middle] + " zwoxbake zwoxlomi" + long[middle:]), (2, long), (3, "x" * 3_000_000), (4, None), (5, ""), (6, "!?")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, network).collect()}
    assert len(long) > 1_000_000 and scores[1] > scores[2]
    assert scores[4] == scores[5] == scores[6] < 0.7


def test_awkward_rows(spark, make_docs, awkward, awkward_rows):
    some = [(r[0], i % 2) for i, r in enumerate(awkward_rows)] + [(None, 1), (3, None), (6, 0), (6, 1)]
    for labels in (some, [(1, 0), (2, 0)], [(1, 1)], []):
        table = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("x"))
        clashing = awkward.withColumn("score", F.lit("x")).withColumn("toxic", F.lit(9))
        found = toxicity.predict_toxicity(clashing, table).collect()
        assert sorted(r.doc_id for r in found) == sorted(r[0] for r in awkward_rows)
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    table = spark.createDataFrame(some, "doc_id long, toxic int")
    assert toxicity.predict_toxicity(make_docs([]), table).count() == 0
    repeated = make_docs([(3, "same", None, None, None), (3, "same", None, None, None), (None, None, None, None, None)])
    assert toxicity.predict_toxicity(repeated, table).count() == 3


def test_query(spark, sf_dir):
    rows = queries.op12_toxicity(spark, sf_dir).collect()
    ids = sorted(r.doc_id for r in queries.documents(spark, sf_dir).select("doc_id").collect())
    assert sorted(r.doc_id for r in rows) == ids
    for row in rows:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1)
        assert 0 <= row.score <= 1 and row.predicted == int(row.score >= 0.7)
