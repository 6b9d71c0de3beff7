"""How the tokens of two tokenizers line up over a corpus, byte by byte.

A text is encoded by a byte-level BPE file (A) and by a sentencepiece model (B).  Tokens of both that share a
byte are linked, and a pair of ids is counted over all links of the corpus.  The distinct pairs get a minimal
perfect hash, so their counts are dense vectors: each part of the corpus sums its own vector, and the vectors
are added up in a tree.  A second pass aligns the documents again and looks the counts up.

* Documents are taken in blocks of ``BLOCK_CHARS`` characters.  The first pass writes each block's ids, and
  its distinct pairs with the number of their links; all later steps read this table.
* Pairs are dealt by hash into cells of some ``CELL_PAIRS``, each with a hash of its own: a level places the
  pairs that meet no other one in a bit array, and leaves the rest to the next level; the slot is the rank of
  the bit.  The pairs lie beside it in the order of their slots, so every use verifies its key.
* A cell's blocks are counted ``BLOCKS_TOGETHER`` at a time, and ``FAN`` vectors are added at a time after that.
* The driver gets one number for each id of B, as many as its vocabulary has.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import PieceEncoder
from .work import with_text, written

BLOCK_CHARS = 2_000_000
#: Characters, or tokens of both, whose documents are encoded or aligned at a time within a block.
PORTION = 250_000
#: Pieces of a generation of A's memo.
MEMO_PIECES = 60_000
CELL_PAIRS = 8192
BLOCKS_TOGETHER = 256
FAN = 16
#: Bits of a level of the hash for each pair that is left.
_ROOM = 2

_ALIGNED = (
    "block long, doc_id array<long>, n_a array<long>, n_b array<long>, a binary, b binary, "
    "pair array<long>, links array<long>"
)
_REPORT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        # A memo this small takes some 20 MB a worker.
        self._a = PieceEncoder(a_path, specials_as_text=True, memo_pieces=MEMO_PIECES)
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = self._a.entries
        entries = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self.b_bytes = [
            bytes([int(entry[3:-1], 16)]) if self._b.is_byte(i) else entry.replace("▁", " ").encode()
            for i, entry in enumerate(entries)
        ]
        self.a_lengths = np.array([len(b) for b in self.a_bytes])
        self.b_lengths = np.array([len(b) for b in self.b_bytes])
        #: Numbers of both fit in this type, in the table of the first pass.
        self.stored = np.dtype("<u2" if max(len(self.a_bytes), len(self.b_bytes)) <= 1 << 16 else "<u4")

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both for each text; none where the bytes of either differ from a space and the text."""
        a = self._a.encode([" " + t for t in texts])
        b = self._b.encode(texts, num_threads=1)
        none = np.empty(0, self.stored)
        out = []
        for text, of_a, own_b in zip(texts, a, b, strict=True):
            whole, own_a = b" " + text.encode(), np.frombuffer(of_a, "<u4")
            same = (
                text != ""
                and b"".join(map(self.a_bytes.__getitem__, own_a.tolist())) == whole
                and b"".join(map(self.b_bytes.__getitem__, own_b)) == whole
            )
            out.append((own_a.astype(self.stored) if same else none, np.array(own_b, self.stored) if same else none))
        return out


@lru_cache(maxsize=1)
def _tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


class Alignment:
    """The tokens of some texts, one text after the other, as byte ranges; no token is without a byte."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_lengths: np.ndarray, b_lengths: np.ndarray) -> None:
        self.a, self.b = a.astype(np.int64), b.astype(np.int64)
        self.a_ends, self.b_ends = np.cumsum(a_lengths[self.a]), np.cumsum(b_lengths[self.b])
        # Ends of both in one order, of equal ones A's first; how many of either come before each place.
        both = np.concatenate([self.a_ends, self.b_ends])
        order = np.argsort(both, kind="stable")
        both, of_a = both[order], order < len(self.a)
        a_before = np.cumsum(of_a) - of_a
        new = np.ones(len(both), bool)
        new[1:] = both[1:] != both[:-1]
        # Between two neighbouring ends lie the bytes that one token of A and one of B share.
        self.ends, self.common = both[new], both[~new]
        self._link_a = a_before[new]
        self._link_b = np.flatnonzero(new) - self._link_a
        # The group of a token is the number of common ends before its own.
        groups = np.cumsum(~new)
        self._a_group = groups[of_a]
        self._b_group = groups[~of_a] - ~new[~of_a]

    def pairs(self) -> np.ndarray:
        """One number a link."""
        return self.a[self._link_a] << 32 | self.b[self._link_b]

    def group_codes(self) -> np.ndarray:
        """All ids in the order of their groups, A before B; three times the id, and what follows it:
        0 another of the group, 1 the group's B, 2 the next group."""
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        of_a, of_b = (np.bincount(own, minlength=len(self.common)) for own in (self._a_group, self._b_group))
        before_a, before_b = np.cumsum(of_b) - of_b, np.cumsum(of_a)
        for ids, group, before, follows in (
            (self.a, self._a_group, before_a, 1),
            (self.b, self._b_group, before_b, 2),
        ):
            last = np.ones(len(ids), bool)
            last[:-1] = group[1:] != group[:-1]
            codes[np.arange(len(ids)) + before[group]] = 3 * ids + follows * last
        return codes


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """64-bit finalizer of splitmix64 (its constants are fixed values), another one for each level."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """n distinct numbers to the slots 0 to n - 1."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self._levels = levels
        self._ranks = []
        before = 0
        for taken in levels:
            self._ranks.append(before + np.cumsum(taken) - 1)
            before += int(taken.sum())

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(keys):
            if len(levels) == 256:
                raise ValueError("the keys are not distinct")
            at = _mixed(keys, len(levels)) % np.uint64(_ROOM * len(keys))
            taken = np.bincount(at.astype(np.int64), minlength=_ROOM * len(keys)) == 1
            levels.append(taken)
            keys = keys[~taken[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys; -1 or some slot for a key that is not of the hash."""
        slots = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (taken, ranks) in enumerate(zip(self._levels, self._ranks, strict=True)):
            at = _mixed(keys[left], level) % np.uint64(len(taken))
            here = taken[at]
            slots[left[here]] = ranks[at[here]]
            left = left[~here]
        return slots

    def to_bytes(self) -> bytes:
        head = struct.pack(f"<{len(self._levels) + 1}q", len(self._levels), *map(len, self._levels))
        return head + b"".join(np.packbits(taken).tobytes() for taken in self._levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        (n,) = struct.unpack_from("<q", data)
        at, levels = 8 * (n + 1), []
        for size in struct.unpack_from(f"<{n}q", data, 8):
            packed = np.frombuffer(data, np.uint8, -(-size // 8), at)
            levels.append(np.unpackbits(packed, count=size).astype(bool))
            at += len(packed)
        return cls(levels)


def _verified_slots(cell: dict, keys: np.ndarray) -> np.ndarray:
    slots = PerfectHash.from_bytes(cell["hash"]).slots(keys)
    if not np.array_equal(np.frombuffer(cell["pairs"], "<i8")[slots], keys):
        raise ValueError("a pair is not the one in its slot")
    return slots


def _rows(schema: str, **columns: Iterable) -> pa.Table:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    kinds = dict(field.split(" ") for field in schema.split(", "))
    return pa.table({name: pa.array(values, types[kinds[name]]) for name, values in columns.items()})


def _packed(ids: np.ndarray) -> bytes:
    """Compressed with like bytes of all ids side by side."""
    return zstandard.compress(ids.view(np.uint8).reshape(-1, ids.itemsize).T.tobytes(), 3)


def _unpacked(data: bytes, kind: np.dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind)[:, 0]


def _portions(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Starts and ends of neighbouring documents, cut behind the one that reaches ``most``."""
    start, held = 0, 0
    for end, size in enumerate(sizes, 1):
        held += size
        if held >= most or end == len(sizes):
            yield start, end
            start, held = end, 0


def _first_pass(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each block: its documents' tokens one after the other, and its distinct pairs."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _tokenizers(a_path, b_path)
        first = TaskContext.get().partitionId() << 32

        def block(number: int, doc_ids: list, texts: list[str]) -> pa.RecordBatch:
            found, counted = [], []
            for start, end in _portions(list(map(len, texts)), PORTION):
                some = both.encode(texts[start:end])
                a, b = (np.concatenate(ids) for ids in zip(*some, strict=True))
                counted.append(np.unique(Alignment(a, b, both.a_lengths, both.b_lengths).pairs(), return_counts=True))
                found += some
            a, b = (np.concatenate(ids) for ids in zip(*found, strict=True))
            pairs, at = np.unique(np.concatenate([own for own, _ in counted]), return_inverse=True)
            links = np.zeros(len(pairs), np.int64)
            np.add.at(links, at, np.concatenate([n for _, n in counted]))
            longs = [doc_ids, [len(ids) for ids, _ in found], [len(ids) for _, ids in found], pairs, links]
            doc_id, n_a, n_b, pair, of_pair = (pa.array([values], pa.list_(pa.int64())) for values in longs)
            packed = [pa.array([_packed(ids)], pa.binary()) for ids in (a, b)]
            return pa.RecordBatch.from_arrays(
                [pa.array([first + number], pa.int64()), doc_id, n_a, n_b, *packed, pair, of_pair],
                ["block", "doc_id", "n_a", "n_b", "a", "b", "pair", "links"],
            )

        number, chars = 0, 0
        doc_ids: list = []
        texts: list[str] = []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                doc_ids.append(doc_id.as_py())
                texts.append(text.as_py())
                chars += len(texts[-1])
                if chars >= BLOCK_CHARS:
                    yield block(number, doc_ids, texts)
                    number, chars, doc_ids, texts = number + 1, 0, [], []
        if texts:
            yield block(number, doc_ids, texts)

    return with_text(docs).mapInArrow(encode, _ALIGNED)


def _hashes(pairs: DataFrame) -> DataFrame:
    """(cell, hash, pairs): the hash of each cell's pairs, and these in order of their slots."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        keys = table["pair"].to_numpy()
        own = PerfectHash.of(keys)
        in_order = np.empty(len(keys), "<i8")
        in_order[own.slots(keys)] = keys
        schema = "cell int, hash binary, pairs binary"
        return _rows(schema, cell=[key[0].as_py()], hash=[own.to_bytes()], pairs=[in_order.tobytes()])

    return pairs.groupBy("cell").applyInArrow(build, "cell int, hash binary, pairs binary")


def _summed(dealt: DataFrame, hashes: DataFrame, parts: int) -> DataFrame:
    """(cell, counts): a dense vector for each cell, summed part by part and then in a tree."""
    schema = "cell int, part int, counts binary"

    def count(key: tuple, found: pa.Table, cell: pa.Table) -> pa.Table:
        if not found.num_rows:
            return _rows(schema, cell=[], part=[], counts=[])
        slots = _verified_slots(own := cell.to_pylist()[0], found["pair"].to_numpy())
        counts = np.zeros(len(own["pairs"]) // 8, "<i8")
        np.add.at(counts, slots, found["links"].to_numpy())
        return _rows(schema, cell=[key[0].as_py()], part=[key[1].as_py()], counts=[counts.tobytes()])

    def add(key: tuple, vectors: pa.Table) -> pa.Table:
        counts = np.sum([np.frombuffer(v.as_buffer(), "<i8") for v in vectors["counts"]], axis=0, dtype="<i8")
        return _rows(schema, cell=[key[0].as_py()], part=[key[1].as_py()], counts=[counts.tobytes()])

    everywhere = hashes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    vectors = (
        dealt.select("cell", "part", "pair", "links")
        .groupBy("cell", "part")
        .cogroup(everywhere.groupBy("cell", "part"))
        .applyInArrow(count, schema)
    )
    while parts > 1:
        parts = -(-parts // FAN)
        vectors = vectors.withColumn("part", F.expr(f"part DIV {FAN}").cast("int"))
        vectors = vectors.groupBy("cell", "part").applyInArrow(add, schema)
    return vectors.select("cell", "counts")


def _highest(cells: DataFrame) -> dict[int, int]:
    """The highest count of each id of B."""

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, at = np.unique(np.frombuffer(row["pairs"], "<i8") & 0xFFFFFFFF, return_inverse=True)
                most = np.zeros(len(ids), np.int64)
                np.maximum.at(most, at, np.frombuffer(row["counts"], "<i8"))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(most)], ["b", "most"])

    found = cells.select("pairs", "counts").mapInArrow(highest, "b long, most long")
    return {row.b: row.most for row in found.groupBy("b").agg(F.max("most").alias("most")).collect()}


def align_tokens(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``docs`` is (doc_id, text).  A encodes a space and the text, B the text, to which it adds the space; the
    texts of special tokens are plain text.  A null or empty text, and one whose tokens of A or B do not give
    the text's bytes back, has no tokens: its numbers are 0 and its digest is empty.  ``n_groups`` counts the
    places where tokens of both end, ``n_links`` the pairs of tokens that share a byte; ``n_best`` of them
    have a count that no other pair of their id of B exceeds, and ``count_sum`` is the sum of their counts.
    Rows that repeat, or whose doc_id repeats or is null, are a document each.  An empty table gives no row;
    other columns are not read.
    """
    aligned = written(_first_pass(docs, a_path, b_path), "aligned")
    blocks = aligned.count()
    linked = aligned.select("block", F.explode(F.arrays_zip("pair", "links")).alias("of"))
    linked = linked.select("block", "of.pair", "of.links")
    pairs = written(linked.select("pair").distinct(), "pairs")
    n_cells, parts = max(1, -(-pairs.count() // CELL_PAIRS)), max(1, -(-blocks // BLOCKS_TOGETHER))
    cell = F.pmod(F.xxhash64("pair"), F.lit(n_cells)).cast("int").alias("cell")
    part = F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part")
    dealt = linked.select("*", cell, part)

    hashes = written(_hashes(pairs.select("pair", cell)), "hashes")
    cells = written(hashes.join(_summed(dealt, hashes, parts), "cell"), "pair-counts")
    most = _highest(cells)

    reply_schema = "block long, pair long, count long"

    def look_up(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return _rows(reply_schema, block=[], pair=[], count=[])
        own = known.to_pylist()[0]
        slots = _verified_slots(own, asked["pair"].to_numpy())
        counts = pa.array(np.frombuffer(own["counts"], "<i8")[slots])
        return pa.table({"block": asked["block"], "pair": asked["pair"], "count": counts})

    everywhere = cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    replies = (
        dealt.select("cell", "part", "block", "pair")
        .groupBy("cell", "part")
        .cogroup(everywhere.groupBy("cell", "part"))
        .applyInArrow(look_up, reply_schema)
    )

    def report(key: tuple, own: pa.Table, counted: pa.Table) -> pa.Table:
        both = _tokenizers(a_path, b_path)
        return _report(both, own, counted["pair"].to_numpy(), counted["count"].to_numpy(), most, PORTION)

    documents = aligned.drop("pair", "links")
    return documents.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(report, _REPORT)


@lru_cache(maxsize=1)
def _decimals(n: int) -> list[bytes]:
    return [b"%d%c" % (i, c) for i in range(n) for c in b",|;"]


def _report(
    both: Tokenizers, own: pa.Table, pairs: np.ndarray, counts: np.ndarray, most: dict[int, int], portion: int
) -> pa.Table:
    """The rows of one block, with the counts of its pairs."""
    n_a, n_b = (own[name].combine_chunks().flatten().to_numpy() for name in ("n_a", "n_b"))
    a, b = (_unpacked(own[name][0].as_py(), both.stored) for name in ("a", "b"))
    order = np.argsort(pairs)
    pairs, counts = pairs[order], counts[order]
    highest = np.zeros(len(both.b_bytes), np.int64)
    highest[list(most)] = list(most.values())
    doc_id = own["doc_id"].combine_chunks().flatten()
    tables, a_start, b_start = [], 0, 0
    for start, end in _portions((n_a + n_b).tolist(), portion):
        of_a, of_b = n_a[start:end], n_b[start:end]
        a_end, b_end = a_start + of_a.sum(), b_start + of_b.sum()
        found = Alignment(a[a_start:a_end], b[b_start:b_end], both.a_lengths, both.b_lengths)
        numbers = _portion_report(both, found, of_a, of_b, pairs, counts, highest)
        tables.append(pa.table({"doc_id": doc_id[start:end], **numbers}))
        a_start, b_start = a_end, b_end
    return pa.concat_tables(tables)


def _portion_report(
    both: Tokenizers,
    found: Alignment,
    n_a: np.ndarray,
    n_b: np.ndarray,
    pairs: np.ndarray,
    counts: np.ndarray,
    highest: np.ndarray,
) -> dict:
    """The columns of some documents of a block; its pairs are sorted."""
    keys = found.pairs()
    at = np.searchsorted(pairs, keys)
    of_link = counts[at]
    if not np.array_equal(pairs[at], keys):
        raise ValueError("a pair has no count")

    # Where documents end, among bytes and so among links, groups and codes.
    byte_ends = np.append(0, found.a_ends)[np.cumsum(n_a)]
    link_ends = np.searchsorted(found.ends, byte_ends, "right")
    group_ends = np.searchsorted(found.common, byte_ends, "right")

    def per_document(values: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(values))[link_ends], prepend=0)

    codes, texts = found.group_codes(), _decimals(max(len(both.a_bytes), len(both.b_bytes)))
    code_ends = np.cumsum(n_a + n_b).tolist()
    digests, start = [], 0
    for end in code_ends:
        groups = b"".join(map(texts.__getitem__, codes[start:end].tolist()))[:-1]
        digests.append(hashlib.sha256(groups).hexdigest() if groups else "")
        start = end
    return {
        "n_a": n_a,
        "n_b": n_b,
        "n_groups": np.diff(group_ends, prepend=0),
        "n_links": np.diff(link_ends, prepend=0),
        "n_best": per_document(of_link == highest[keys & 0xFFFFFFFF]),
        "count_sum": per_document(of_link),
        "groups_sha256": digests,
    }
