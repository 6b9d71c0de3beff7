"""Links between the tokens of two tokenizers against a byte-by-byte version."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aislewise.llm import queries, token_alignment
from aislewise.llm.bpe import byte_characters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_force(docs):
    """The rows of all documents, from the set of id pairs at every byte."""
    a_of, b_of = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_of.encode_special_tokens = True
    byte_of = {c: i for i, c in enumerate(byte_characters())}

    def b_bytes(token):
        piece = b_of.id_to_piece(token)
        return bytes([int(piece[3:-1], 16)]) if b_of.is_byte(token) else piece.replace("▁", " ").encode()

    encoded, counts = [], collections.Counter()
    for doc_id, text in docs:
        text = text or ""
        whole = (" " + text).encode()
        a = [(i, bytes(byte_of[c] for c in a_of.id_to_token(i))) for i in a_of.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, b_bytes(i)) for i in b_of.encode(text)]
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            encoded.append((doc_id, [], [], [], []))
            continue
        of_byte = [[n for n, (_, x) in enumerate(side) for _ in x] for side in (a, b)]
        links = sorted(set(zip(*of_byte)))
        links = [(a[i][0], b[j][0]) for i, j in links]
        counts.update(links)
        ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (a, b)]
        groups, start = [], 0
        for end in sorted(ends[0] & ends[1]):
            own = [list(dict.fromkeys(n for n in places[start:end])) for places in of_byte]
            groups.append("|".join(",".join(str(side[n][0]) for n in some) for side, some in zip((a, b), own)))
            start = end
        encoded.append((doc_id, a, b, links, groups))
    best = collections.Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return sorted(
        (
            (
                doc_id, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links),
                sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "",
            )
            for doc_id, a, b, links, groups in encoded
        ),
        key=repr,
    )


def found(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.mark.parametrize("size", [1, 7, 8192, 20_000])
def test_perfect_hash(size):
    keys = np.random.default_rng(size).choice(1 << 48, size, replace=False)
    own = token_alignment.PerfectHash.from_bytes(token_alignment.PerfectHash.of(keys).to_bytes())
    assert sorted(own.slots(keys).tolist()) == list(range(size))
    with pytest.raises(ValueError):
        token_alignment.PerfectHash.of(np.array([5, 5]))


def test_a_foreign_key_is_noticed():
    keys = np.arange(100, dtype="<i8")
    own = token_alignment.PerfectHash.of(keys)
    in_order = np.empty(100, "<i8")
    in_order[own.slots(keys)] = keys
    cell = {"hash": own.to_bytes(), "pairs": in_order.tobytes()}
    assert in_order[token_alignment._verified_slots(cell, keys)].tolist() == keys.tolist()
    with pytest.raises(ValueError):
        token_alignment._verified_slots(cell, np.array([1000]))


ODD = ["a▁b", " lead", "trail ", "a  b\n\n\tc", "<s> </s> <0x0A> <unk>", "<|endoftext|>", "\x00x", "é中文🙂", "é", "​", "﻿x"]


@pytest.mark.parametrize("small", [False, True])
def test_awkward_rows(spark, awkward, awkward_rows, monkeypatch, small):
    if small:
        # Many blocks, cells and parts, and so a tree of several levels.
        for name, value in (("BLOCK_CHARS", 300), ("CELL_PAIRS", 50), ("BLOCKS_TOGETHER", 3), ("FAN", 2)):
            monkeypatch.setattr(token_alignment, name, value)
    draw = random.Random(4)
    texts = ODD + ["".join(draw.choices("ab é中\n.'1<s>", k=draw.randint(1, 60))) for _ in range(60)]
    more = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "no id"), (None, None)]
    docs = awkward.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    docs = docs.withColumn("pair", F.lit("x")).withColumn("block", F.lit(1)).withColumn("a", F.lit(1)).repartition(3)
    rows = [(r[0], r[1]) for r in awkward_rows] + more
    assert found(token_alignment.align_tokens(docs, A, B)) == brute_force(rows)


def test_blocks_are_aligned_by_portions_of_their_documents(make_docs, monkeypatch):
    monkeypatch.setattr(token_alignment, "PORTION", 12)
    assert list(token_alignment._portions([5, 7, 0, 30, 1], 12)) == [(0, 2), (2, 4), (4, 5)]
    texts = ["the end", "", "the end of the end", None, "a▁b", "ends and ends", *ODD, "the end"]
    docs = make_docs([(i, text, None, None, None) for i, text in enumerate(texts)]).coalesce(1)
    assert found(token_alignment.align_tokens(docs, A, B)) == brute_force(list(enumerate(texts)))


def test_empty_tables(make_docs):
    assert token_alignment.align_tokens(make_docs([]), A, B).count() == 0
    blank = make_docs([(1, None, None, None, None), (2, "", None, None, None)])
    assert found(token_alignment.align_tokens(blank, A, B)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_query(spark, sf_dir, documents):
    assert found(queries.op11_token_alignment(spark, sf_dir)) == brute_force(documents)
