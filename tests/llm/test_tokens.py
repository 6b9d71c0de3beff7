"""Ids and counts against the tokenizers library: files, packing, transducer, streaming encoder."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import crc
from tokenizers import Tokenizer

from aislewise.llm import finite_state_count, packing, queries, streaming_bpe, token_files, tokens
from aislewise.llm.work import new_path

PARTS = [*"aabcdest'  \n\t.,!?0129éßçñ中😀½²٣\x1c\x85_-Σ", "'s", "'re ", "<|endoftext|>", " the", "   ", " ", "<|startoftext|>"]


def random_texts(n: int, seed: int = 3) -> list[str]:
    rnd = random.Random(seed)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 50))) for _ in range(n)]
    return [*texts, "", "a" * 4000, "ab" * 2500 + "中" * 900, " " * 2000, "\n" * 7, "ΑΣ İ ΣΑΣ", "haha" * 900]


@pytest.fixture(scope="module")
def byte_bpe():
    return Tokenizer.from_file(queries.BYTE_BPE)


@pytest.fixture(scope="module")
def word_bpe():
    return Tokenizer.from_file(queries.WORD_BPE)


def library_ids(tokenizer, texts):
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_piece_memo_gives_the_librarys_ids(byte_bpe, monkeypatch):
    texts = random_texts(4000) + ["a b\nc d. e\n", " lead", "\nlead", "trail ", "trail\n", "one two\nthree 's"]
    monkeypatch.setattr(tokens, "SLICE_CHARS", 500)
    monkeypatch.setattr(tokens, "MEMO_PIECES", 40)
    found = [np.frombuffer(i, "<u4").tolist() for i in tokens.PieceEncoder(queries.BYTE_BPE).encode(texts)]
    assert found == library_ids(byte_bpe, texts)


def test_columns_of_texts_give_the_librarys_ids(byte_bpe, monkeypatch):
    """Each distinct piece of a slice is looked up once, and known ones do not meet the library again."""
    texts = ["one two\nthree one", "x" * 70 + " one " + "x" * 70, "\n", " ", "\u2003a b"]
    texts += [*random_texts(3000, seed=8), *texts]
    monkeypatch.setattr(tokens, "SLICE_CHARS", 3000)
    encoder = tokens.PieceEncoder(queries.BYTE_BPE)
    learnt = collections.Counter()
    learn = encoder._learn
    encoder._memo._learn = lambda pieces: learnt.update(pieces) or learn(pieces)
    column = pa.array(["cut off", *texts]).slice(1)
    found = [np.frombuffer(i, "<u4").tolist() for i in encoder.encode_column(column)]
    assert found == library_ids(byte_bpe, texts)
    assert learnt["one"] == 1 and learnt["x" * 70] > 1
    assert list(encoder.encode_column(pa.array([], pa.string()))) == []


def test_special_strings_as_text(byte_bpe):
    texts = random_texts(2000, seed=9)
    plain = Tokenizer.from_file(queries.BYTE_BPE)
    plain.encode_special_tokens = True
    encoder = tokens.PieceEncoder(queries.BYTE_BPE, specials_as_text=True, memo_pieces=30)
    found = [np.frombuffer(i, "<u4").tolist() for i in encoder.encode(texts)]
    assert found == library_ids(plain, texts) != library_ids(byte_bpe, texts)


def test_transducer_counts_as_the_library(byte_bpe, monkeypatch):
    texts = random_texts(4000)
    wanted = [len(i) for i in library_ids(byte_bpe, texts)]
    for chunk in (1, 7, 64, 1024):
        monkeypatch.setattr(finite_state_count, "CHUNK_BYTES", chunk)
        some = slice(None) if chunk > 7 else slice(3900, 4001)
        machine = finite_state_count.CountingTransducer(queries.BYTE_BPE)
        assert finite_state_count._counted(machine, texts[some]) == wanted[some]


def test_transducer_is_the_same_after_states_are_dropped(byte_bpe, monkeypatch):
    texts = random_texts(300)
    monkeypatch.setattr(finite_state_count, "MOST_STATES", 10)
    machine = finite_state_count.CountingTransducer(queries.BYTE_BPE)
    counts = [n for i in range(0, len(texts), 20) for n in finite_state_count._counted(machine, texts[i : i + 20])]
    assert counts == [len(i) for i in library_ids(byte_bpe, texts)]


def test_streaming_round_trip(word_bpe):
    codec = streaming_bpe.TextCodec(queries.WORD_BPE)
    texts = random_texts(3000)
    for text, ids in zip(texts, library_ids(word_bpe, texts), strict=True):
        own = np.frombuffer(b"".join(codec.encode(text)), "<u4").tolist()
        assert own == ids
        decoder = streaming_bpe.StreamingDecoder(codec)
        pieces = [decoder.push(own[i : i + 3]) for i in range(0, len(own), 3)]
        assert "".join(pieces) + decoder.close() == word_bpe.decode(ids, skip_special_tokens=False)


def test_streaming_encoder_keeps_constant_memory(word_bpe):
    merges = streaming_bpe.TextCodec(queries.WORD_BPE).merges
    rnd = random.Random(5)
    letters = [rnd.choice("aehlnorst") for _ in range(6000)]
    # A short lookahead shows that what is emitted early stays right, and that little is held.
    encoder = streaming_bpe.StreamingEncoder(merges, lookahead=60)
    out, most = [], 0
    for i, letter in enumerate(letters):
        out += encoder.push(letter + "</w>" if i == len(letters) - 1 else letter)
        most = max(most, encoder.held)
    out += encoder.close()
    assert out == library_ids(word_bpe, ["".join(letters)])[0]
    assert most <= 2 * (60 + merges.longest) + 1


def test_learnt_words_have_the_librarys_ids_and_share_prefixes(word_bpe, monkeypatch):
    codec = streaming_bpe.TextCodec(queries.WORD_BPE)
    texts = [*random_texts(2000, seed=6), "string strings stringent strange", "x" * 60 + "a " + "x" * 60 + "b"]
    pushed = []
    push = streaming_bpe.StreamingEncoder.push
    monkeypatch.setattr(
        streaming_bpe.StreamingEncoder, "push", lambda own, *symbols: pushed.extend(symbols) or push(own, *symbols)
    )
    held = [codec.parts(text) for text in texts]
    codec.learn(held)
    own = [np.frombuffer(b"".join(codec.encode_parts(parts)), "<u4").tolist() for parts in held]
    assert own == library_ids(word_bpe, texts)
    pushed.clear()
    codec.learn([codec.parts("mnopqrstuvwxya mnopqrstuvwxyb mnopqrstuvwxyc mnopqrstuvwxya")])
    assert len(pushed) == 13 + 3


def test_neighbours_are_told_without_replaying_merges():
    merges = streaming_bpe.TextCodec(queries.WORD_BPE).merges
    rnd = random.Random(4)
    short = [token for token, symbols in merges.symbols_of.items() if len(symbols) < 4]
    for pool in (short, list(merges.symbols_of)):
        for _ in range(4000):
            left, right = rnd.choice(pool), rnd.choice(pool)
            texts = [merges.symbols_of[left], merges.symbols_of[right]]
            replayed = merges.merged(texts[0] + texts[1]) == ["".join(text) for text in texts]
            assert merges.may_follow(left, right) == replayed


def test_byte_level_decoder_joins_bytes_across_tokens(byte_bpe):
    codec = streaming_bpe.TextCodec(queries.BYTE_BPE)
    for text in ["中文 😀 naïve", "a<|endoftext|>b", "", "½"]:
        ids = byte_bpe.encode(text, add_special_tokens=False).ids
        decoder = streaming_bpe.StreamingDecoder(codec)
        assert "".join(decoder.push([i]) for i in ids) + decoder.close() == text
    decoder = streaming_bpe.StreamingDecoder(codec)
    cut = byte_bpe.encode("😀", add_special_tokens=False).ids[:1]
    assert decoder.push(cut) + decoder.close() == byte_bpe.decode(cut, skip_special_tokens=False)


def test_token_files(spark, awkward, awkward_rows, byte_bpe):
    folder = new_path(spark, "files")
    manifest = token_files.write_token_files(awkward, folder, queries.BYTE_BPE, end_id=2, sequence_tokens=64).collect()
    found = sorted(map(tuple, token_files.read_token_files(spark, folder).collect()))
    rows = sorted(awkward_rows, key=lambda r: r[0])
    start, wanted = 0, []
    stream = []
    for row, ids in zip(rows, library_ids(byte_bpe, [r[1] for r in rows]), strict=True):
        ids = [*ids, 2]
        wanted.append((row[0], start, len(ids), crc(ids)))
        start += len(ids)
        stream.append(ids)
    # Documents of one id may stand in either order; here ids are unique.
    assert found == wanted
    flat = []
    for shard in sorted(manifest, key=lambda m: m.shard):
        reader = token_files.Shard(shard.ids_path)
        own = []
        for i in range(shard.n_sequences):
            ids, mask = reader.sequence(i)
            assert len(ids) == len(mask) == 64 and not ids.flags.owndata
            own += ids[np.array(mask)].tolist()
        assert len(own) == shard.n_tokens
        flat += own
    assert flat == [i for ids in stream for i in ids]


def test_token_files_of_an_empty_table(spark, make_docs):
    assert token_files.token_files_round_trip(make_docs([]), queries.BYTE_BPE).count() == 0


def check_packing(rows, docs, tokenizer, capacity):
    wanted = {d: [*i, 0] for (d, _), i in zip(docs, library_ids(tokenizer, [t for _, t in docs]), strict=True)}
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for row in rows:
        assert crc(wanted[row.doc_id][row.start : row.start + row.length]) == row.ids_crc32
        assert row.doc_tokens == len(wanted[row.doc_id]) and row.length > 0
        by_doc[row.doc_id].append((row.start, row.length))
        by_sequence[row.sequence_id].append((row.offset, row.length))
    assert set(by_doc) == set(wanted)
    for pieces, total in [(by_doc[d], len(i)) for d, i in wanted.items()]:
        assert sum(n for _, n in pieces) == total
    for pieces in [*by_doc.values(), *by_sequence.values()]:
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
    for pieces in by_sequence.values():
        fill = sum(n for _, n in pieces)
        assert fill == capacity or fill & (fill - 1) == 0 and fill < capacity
    return by_sequence


@pytest.mark.parametrize("capacity", [16, 100, 1024])
def test_packing(awkward, awkward_rows, byte_bpe, capacity):
    rows = packing.pack_documents(awkward, queries.BYTE_BPE, capacity).collect()
    check_packing(rows, [r[:2] for r in awkward_rows], byte_bpe, capacity)


def test_packing_of_all_documents(spark, sf_dir, documents, byte_bpe):
    rows = queries.op10_packing(spark, sf_dir).collect()
    check_packing(rows, documents, byte_bpe, 1024)


def test_packing_closes_windows_beyond_the_limit(monkeypatch):
    monkeypatch.setattr(packing, "MOST_OPEN", 5)
    fills = []
    packer = packing.SumOfSquares(100, lambda window: fills.append(sum(map(len, window))))
    rnd = random.Random(2)
    total = 0
    for i in range(3000):
        size = rnd.randint(1, 140)
        total += size
        packer.add(packing.Piece(i, 0, bytes(4 * size), size))
        assert packer._n_open <= 5
    packer.finish()
    assert sum(fills) == total and set(fills) <= {100, 64, 32, 16, 8, 4, 2, 1}


def test_level_choice_minimises_the_sum_of_squares():
    rnd = random.Random(4)
    packer = packing.SumOfSquares(30, lambda window: None)
    for i in range(400):
        size = rnd.randint(1, 29)
        before = packer._levels.copy()

        def after(level, before=before, size=size):
            levels = before.copy()
            if level:
                levels[level] -= 1
            if level + size < 30:
                levels[level + size] += 1
            return int((levels**2).sum())

        choices = {h: after(h) for h in range(31 - size) if h == 0 or before[h]}
        assert choices[packer.level_for(size)] == min(choices.values())
        packer.add(packing.Piece(i, 0, bytes(4 * size), size))


@pytest.mark.parametrize("operator", ["op4_token_counts", "op9_streaming_bpe"])
def test_queries_on_all_documents(spark, sf_dir, documents, byte_bpe, word_bpe, operator):
    found = {r.doc_id: r for r in queries.QUERIES[operator](spark, sf_dir).collect()}
    tokenizer = byte_bpe if operator.startswith("op4") else word_bpe
    for (doc_id, text), ids in zip(documents, library_ids(tokenizer, [t for _, t in documents]), strict=True):
        row = found[doc_id]
        assert row.n_tokens == len(ids)
        if operator.startswith("op4"):
            assert row.over_limit == (len(ids) > 512) and row.n_bytes == len((text or "").encode())
        else:
            decoded = tokenizer.decode(ids, skip_special_tokens=False)
            assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_counts_and_round_trip_of_awkward_rows(make_docs, awkward, awkward_rows, byte_bpe):
    counted = {r.doc_id: r.n_tokens for r in finite_state_count.count_tokens(awkward, queries.BYTE_BPE).collect()}
    assert counted == {r[0]: len(i) for r, i in zip(awkward_rows, library_ids(byte_bpe, [r[1] for r in awkward_rows]), strict=True)}
    assert streaming_bpe.encode_and_decode(awkward, queries.WORD_BPE).count() == len(awkward_rows)
    for operator in (finite_state_count.count_tokens, streaming_bpe.encode_and_decode):
        assert operator(make_docs([]), queries.BYTE_BPE).count() == 0
        assert operator(make_docs([(None, None, None, None, None)] * 2), queries.BYTE_BPE).count() == 2
