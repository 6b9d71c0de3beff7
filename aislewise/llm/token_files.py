"""Token ids as Arrow files of equal-length sequences.

Documents are dealt out by ranges of doc_id; each task writes one shard of two Arrow IPC files, batch by
batch.  The first has one row a sequence: ``ids``, a fixed-size list (16-bit where the vocabulary allows), and
``mask``, a fixed-size list of booleans that is false on the padding of a shard's last sequence.  The second
lists the shard's documents.  Neither holds nulls or offsets, so a memory-mapped file gives any sequence and
its mask without a copy or a search.

Every attempt of a task writes to names of its own, and only the shards in the manifest count, so a task that
is run again leaves nothing wrong behind.  The manifest is a Parquet table in the same folder.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import encoder
from .work import new_path, with_text

SEQUENCE_TOKENS = 2048
BATCH_SEQUENCES = 128
INDEX_ROWS = 16_384

_MANIFEST = (
    "shard int, ids_path string, index_path string, n_docs long, n_tokens long, n_sequences long, sequence_tokens int"
)
_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _sequences_schema(length: int, wide: bool) -> pa.Schema:
    item = pa.field("item", pa.uint32() if wide else pa.uint16(), nullable=False)
    flag = pa.field("item", pa.bool_(), nullable=False)
    return pa.schema(
        [
            pa.field("ids", pa.list_(item, length), nullable=False),
            pa.field("mask", pa.list_(flag, length), nullable=False),
        ]
    )


class _ShardWriter:
    """Writes tokens as sequences, holding one batch of them."""

    def __init__(self, folder: str, shard: int, length: int, wide: bool) -> None:
        self._files, root = fs.FileSystem.from_uri(folder)
        self._files.create_dir(root, recursive=True)
        name = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}"
        self.ids_path, self.index_path = f"{name}.ids.arrow", f"{name}.index.arrow"
        self._schema = _sequences_schema(length, wide)
        self._dtype = np.dtype("<u4" if wide else "<u2")
        self._length = length
        self._held: list[np.ndarray] = []
        self._n_held = 0
        self._rows: list[tuple[int | None, int, int]] = []
        self.n_docs = self.n_tokens = self.n_sequences = 0
        self._sequences = pa.ipc.new_file(self._files.open_output_stream(self.ids_path), self._schema)
        self._index = pa.ipc.new_file(self._files.open_output_stream(self.index_path), _INDEX)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._rows.append((doc_id, self.n_tokens, len(ids)))
        self.n_docs += 1
        self.n_tokens += len(ids)
        self._held.append(ids.astype(self._dtype))
        self._n_held += len(ids)
        # Every batch but the last is full, so a sequence's number tells its batch.
        full = self._n_held // (BATCH_SEQUENCES * self._length)
        if full:
            self._write(full * BATCH_SEQUENCES)
        if len(self._rows) >= INDEX_ROWS:
            self._write_index()

    def _write(self, n: int, padding: int = 0) -> None:
        flat = np.concatenate(self._held)
        size = n * self._length
        for at in range(0, size, BATCH_SEQUENCES * self._length):
            ids = flat[at : min(size, at + BATCH_SEQUENCES * self._length)]
            mask = np.ones(len(ids), bool)
            if padding and at + len(ids) == size:
                mask[-padding:] = False
            columns = [
                pa.FixedSizeListArray.from_arrays(pa.array(values), type=field.type)
                for values, field in zip((ids, mask), self._schema, strict=True)
            ]
            self._sequences.write_batch(pa.RecordBatch.from_arrays(columns, schema=self._schema))
        self.n_sequences += n
        self._held, self._n_held = [flat[size:].copy()], len(flat) - size

    def _write_index(self) -> None:
        columns = zip(*self._rows, strict=True)
        arrays = [pa.array(c, pa.int64()) for c in columns]
        self._index.write_batch(pa.RecordBatch.from_arrays(arrays, schema=_INDEX))
        self._rows = []

    def close(self) -> None:
        if self._n_held:
            padding = -self._n_held % self._length
            self._held.append(np.zeros(padding, self._dtype))
            self._n_held += padding
            self._write(self._n_held // self._length, padding)
        if self._rows:
            self._write_index()
        self._sequences.close()
        self._index.close()


class Shard:
    """Random access to the sequences of one shard; ids and masks are views of the file where it is mapped."""

    def __init__(self, ids_path: str) -> None:
        self._source = pa.memory_map(ids_path)
        self._reader = pa.ipc.open_file(self._source)
        self._n_batches = self._reader.num_record_batches

    def sequence(self, number: int) -> tuple[np.ndarray, pa.Array]:
        batch = self._reader.get_batch(number // BATCH_SEQUENCES)
        row = number % BATCH_SEQUENCES
        ids, mask = batch.column("ids"), batch.column("mask")
        length = ids.type.list_size
        view = ids.flatten().to_numpy(zero_copy_only=True)[row * length : (row + 1) * length]
        return view, mask.flatten().slice(row * length, length)


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int | None = 2,
    sequence_tokens: int = SEQUENCE_TOKENS,
    wide: bool = False,
) -> DataFrame:
    """Writes ``docs`` in ascending doc_id order below ``folder`` and returns the manifest, read from there.

    A null text is empty, so its document is the end id alone; a null doc_id comes first; rows that repeat are
    written each on its own, in any order among themselves; an empty table gives an empty manifest.  Columns
    other than ``doc_id`` and ``text`` are not read.  ``wide`` writes 32-bit ids, for vocabularies over 65,536.
    """
    end = b"" if end_id is None else end_id.to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode_column
        shard, writer = TaskContext.get().partitionId(), None
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for doc_id, ids in zip(doc_ids, encode(batch.column("text")), strict=True):
                writer = writer or _ShardWriter(folder, shard, sequence_tokens, wide)
                writer.add(doc_id, np.frombuffer(ids + end, "<u4"))
        if writer:
            writer.close()
            row = {
                "shard": [shard],
                "ids_path": [writer.ids_path],
                "index_path": [writer.index_path],
                "n_docs": [writer.n_docs],
                "n_tokens": [writer.n_tokens],
                "n_sequences": [writer.n_sequences],
                "sequence_tokens": [sequence_tokens],
            }
            schema = pa.schema(
                [("shard", pa.int32()), ("ids_path", pa.string()), ("index_path", pa.string())]
                + [(k, pa.int64()) for k in ("n_docs", "n_tokens", "n_sequences")]
                + [("sequence_tokens", pa.int32())]
            )
            yield pa.RecordBatch.from_pydict(row, schema)

    spark = docs.sparkSession
    ordered = with_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(write, _MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row a document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    # One row a shard: the only thing here that is put in one order.
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = manifest.withColumn("first", F.coalesce(before, F.lit(0)))
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input_file(row["ids_path"]) as ids, files.open_input_file(row["index_path"]) as index:
                    yield from _documents(pa.ipc.open_file(ids), pa.ipc.open_file(index), row["first"])

    dealt = shards.select("ids_path", "index_path", "first").repartitionByRange(n, "ids_path")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _documents(ids_file, index_file, first: int) -> Iterator[pa.RecordBatch]:
    """Walks the sequences and the documents of a shard side by side, one batch of each in memory."""

    def flat() -> Iterator[np.ndarray]:
        for i in range(ids_file.num_record_batches):
            yield ids_file.get_batch(i).column("ids").flatten().to_numpy().astype("<u4")

    chunks = flat()
    chunk, at = np.empty(0, "<u4"), 0
    for i in range(index_file.num_record_batches):
        index = index_file.get_batch(i)
        sums = []
        for need in index.column("n_tokens").to_pylist():
            crc = 0
            while need:
                if at == len(chunk):
                    chunk, at = next(chunks), 0
                part = chunk[at : at + need]
                crc = zlib.crc32(part, crc)
                at += len(part)
                need -= len(part)
            sums.append(crc)
        start = pa.array(index.column("start").to_numpy() + first, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [index.column("doc_id"), start, index.column("n_tokens"), pa.array(sums, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def token_files_round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """``docs`` written to the shared folder and read back, one row a document."""
    folder = new_path(docs.sparkSession, "token-files")
    write_token_files(docs, folder, tokenizer_path, end_id)
    return read_token_files(docs.sparkSession, folder)
