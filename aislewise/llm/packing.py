"""Packing of documents into windows by the sum-of-squares rule.

A level array counts the open windows of each fill.  A piece goes where the sum of the squared counts comes
out smallest: into an open window of some fill, or into a new one.  Windows that become full are closed.
What is still open at the end of a task, or beyond ``MOST_OPEN`` windows, is laid end to end and cut again at
every full window; the last tokens of a task become windows whose lengths are powers of two, so that no
window needs padding.

Each task packs the rows that it reads: there is no shuffle, and memory holds open windows only.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tokens import encoder
from .work import with_text

MOST_OPEN = 4096
#: Windows of one task; the task's number is above these bits in a sequence id.
WINDOW_BITS = 36
BATCH_PIECES = 20_000

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


@dataclass(slots=True)
class Piece:
    """``ids[start:start + length]`` of a document, four bytes an id; ``ids`` holds this piece only."""

    doc_id: int | None
    start: int
    ids: bytes
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, length: int) -> tuple[Piece, Piece]:
        head = Piece(self.doc_id, self.start, self.ids[: 4 * length], self.doc_tokens)
        return head, Piece(self.doc_id, self.start + length, self.ids[4 * length :], self.doc_tokens)


class SumOfSquares:
    """Online packing into windows of ``capacity`` tokens; ``emit`` gets the pieces of each closed window."""

    def __init__(self, capacity: int, emit: Callable[[list[Piece]], None]) -> None:
        self.capacity = capacity
        self._emit = emit
        self._levels = np.zeros(capacity + 1, np.int64)
        self._open: list[list[list[Piece]]] = [[] for _ in range(capacity + 1)]
        self._n_open = 0

    def level_for(self, size: int) -> int:
        """The fill of the window that a piece of ``size`` goes to; 0 is a new window."""
        levels, top = self._levels, self.capacity
        # Half the change of the sum of squares when a window of fill h becomes one of fill h + size.
        change = levels[size : top + 1] - levels[: top + 1 - size] + 1.0
        change[0] = levels[size] + 0.5  # a new window leaves no level
        if size == top:
            return 0
        change[top - size] = 0.5 - levels[top - size]  # a full window is at no level
        change[1:][levels[1 : top + 1 - size] == 0] = np.inf
        best = change.min()
        return int(np.flatnonzero(change == best)[-1])  # of equal choices, the fullest window

    def add(self, piece: Piece) -> None:
        while len(piece) >= self.capacity:
            window, piece = piece.cut(self.capacity)
            self._emit([window])
        size = len(piece)
        if not size:
            return
        level = self.level_for(size)
        window = []
        if level:
            window = self._open[level].pop()
            self._levels[level] -= 1
            self._n_open -= 1
        window.append(piece)
        if level + size == self.capacity:
            self._emit(window)
            return
        self._open[level + size].append(window)
        self._levels[level + size] += 1
        self._n_open += 1
        if self._n_open > MOST_OPEN:
            self._recut(last=False)

    def finish(self) -> None:
        self._recut(last=True)

    def _recut(self, last: bool) -> None:
        """Closes all open windows but one by moving parts of pieces; with ``last``, that one as well."""
        window: list[Piece] = []
        fill = 0
        # The fullest come first: most of them only take up a part of a later piece.
        for level in range(self.capacity - 1, 0, -1):
            for pieces in self._open[level]:
                for piece in pieces:
                    while fill + len(piece) >= self.capacity:
                        head, piece = piece.cut(self.capacity - fill)
                        self._emit([*window, head])
                        window, fill = [], 0
                    if len(piece):
                        window.append(piece)
                        fill += len(piece)
        self._open = [[] for _ in range(self.capacity + 1)]
        self._levels[:] = 0
        self._n_open = 0
        if not fill:
            return
        if not last:
            self._open[fill].append(window)
            self._levels[fill] = self._n_open = 1
            return
        power = self.capacity if self.capacity & (self.capacity - 1) == 0 else 1 << self.capacity.bit_length()
        while window:
            while power > fill:
                power //= 2
            part, size = [], 0
            while size < power:
                piece = window.pop(0)
                if size + len(piece) > power:
                    piece, rest = piece.cut(power - size)
                    window.insert(0, rest)
                part.append(piece)
                size += len(piece)
            self._emit(part)
            fill -= power


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """One row for each piece: its document, its place there, its sequence and the place in that.

    A document is its text's ids and ``end_id``.  A null text is an empty one, so its document is the end id
    alone; a null ``doc_id`` stays null; rows that repeat are packed each on its own; an empty table gives no
    row.  Columns other than ``doc_id`` and ``text`` are not read.  No sequence is longer than ``capacity``,
    and each is exactly that long or a power of two.
    """
    end = end_id.to_bytes(4, "little")
    arrow_schema = pa.schema([(f.name, pa.int64()) for f in SCHEMA])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode_column
        sequence = TaskContext.get().partitionId() << WINDOW_BITS
        rows: list[tuple] = []

        def emit(window: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for piece in window:
                n = len(piece)
                rows.append(
                    (piece.doc_id, piece.start, n, zlib.crc32(piece.ids), piece.doc_tokens, sequence, offset)
                )
                offset += n
            sequence += 1

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(column, pa.int64()) for column in zip(*rows, strict=True)], schema=arrow_schema
            )
            rows.clear()
            return out

        packer = SumOfSquares(capacity, emit)
        for one in batches:
            ids = one.column("doc_id").to_pylist()
            for doc_id, encoded in zip(ids, encode(one.column("text")), strict=True):
                encoded += end
                packer.add(Piece(doc_id, 0, encoded, len(encoded) // 4))
                if len(rows) >= BATCH_PIECES:
                    yield batch()
        packer.finish()
        if rows:
            yield batch()

    return with_text(docs).mapInArrow(pack, SCHEMA)
