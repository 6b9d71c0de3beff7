"""Token counts by a deterministic transducer over bytes, run on all chunks of a batch at once.

The transducer's transitions carry the number of tokens that a byte adds (or takes away, where tokens grow
together).  Its state holds what later tokens can depend on: for every suffix of the input that some token
goes on from, the last token before that suffix and the difference of the counts.  States are made when a
text first reaches them, from the merges alone, and kept as a dense table.

A batch of texts is one run of bytes, cut into chunks of equal length without regard to words.  A chunk maps
the state that it starts in to the state that it ends in and to a count.  At the start of a word every state
goes to the same one, so a chunk with a word start in it has a constant map from there on, which all chunks
compute side by side; the scan over the chunks' maps then hands each its first state, and the parts before
the first word starts run side by side as well.  Only chunks within one long word wait for their neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Merges, Node, byte_characters
from .work import with_text

CHUNK_BYTES = 1024
BATCH_CHARS = 2_000_000
#: States kept before the table is made anew; a table row takes 4 bytes for each byte value.
MOST_STATES = 150_000
#: A transition is the next state above eight bits that hold the tokens added, raised by this.
_ZERO = 128
#: A state that no word has begun in: it stays and counts nothing.
_IDLE, _START = 0, 1

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0
#: What an apostrophe may split off, as in the pre-tokenizer's pattern.
_SHORT, _LONG = "stmd", ("re", "ve", "ll")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """For each code point, whether it is a letter, a number, white space or none of these."""
    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for run in regex.finditer(pattern, every):
            first, last = ord(run[0][0]), ord(run[0][-1])
            table[first : last + 1] = kind
    table[0xD800:0xE000] = _OTHER
    return table


def word_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the byte-level pre-tokenizer starts a word, for code points of texts that begin at ``first``."""
    n = len(codes)
    kind = _classes()[codes]
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    begins[n] = True

    space = kind == _SPACE
    plain = codes == 0x20
    # What the next character is, with the end of a text as white space.
    next_is_space = np.r_[space[1:], True] | begins[1:]
    before = np.r_[np.uint8(255), kind[:-1]]
    before[begins[:n]] = 255
    after_plain = np.r_[False, plain[:-1]] & ~begins[:n]

    starts = (kind != before) & ~(after_plain & ~space)
    # The last of several spaces stands alone or with the word after it, unless the text ends there.
    at_end = np.zeros(n, bool)
    at_end[np.maximum(np.flatnonzero(begins)[1:] - 1, 0)] = True
    starts |= space & (before == _SPACE) & ~next_is_space & ~at_end
    starts |= begins[:n]

    apostrophes = np.flatnonzero((codes == 0x27) & (before != _OTHER) & ~after_plain)
    if len(apostrophes):
        ends = np.append(np.flatnonzero(begins), n)
        limit = ends[np.searchsorted(ends, apostrophes, "right")]
        padded = np.r_[codes, np.zeros(2, codes.dtype)]
        one = np.where(apostrophes + 1 < limit, padded[apostrophes + 1], 0)
        two = np.where(apostrophes + 2 < limit, padded[np.minimum(apostrophes + 2, n)], 0)
        short = np.isin(one, [ord(c) for c in _SHORT])
        long = np.zeros(len(one), bool)
        for pair in _LONG:
            long |= (one == ord(pair[0])) & (two == ord(pair[1]))
        for found, size in ((apostrophes[short], 2), (apostrophes[long & ~short], 3)):
            starts[found + 1] = False
            rest = found + size
            rest = rest[rest < n]
            # A letter after it begins a word of its own; anything else is judged as after a letter.
            starts[rest[kind[rest] == _LETTER]] = True
    return starts


class CountingTransducer:
    def __init__(self, path: str) -> None:
        self._merges = Merges(path)
        self._characters = byte_characters()
        self.special = [t["content"] for t in self._merges.file["added_tokens"]]
        self._reset()

    def _reset(self) -> None:
        self._states: list[tuple] = [(), ((self._merges.root, None, 0),)]
        self._numbers = {self._states[1]: _START}
        self._table = np.full(4096 * 256, -1, np.int32)
        self._table[_IDLE * 256 : _START * 256] = _IDLE << 8 | _ZERO

    @property
    def n_states(self) -> int:
        return len(self._states)

    def _compile(self, state: int, byte: int) -> None:
        """The transition of ``state`` on ``byte``."""
        symbol, may_follow = self._characters[byte], self._merges.may_follow
        token = adds = None
        moved: list[tuple[Node, int | None, int]] = []
        for node, last, count in self._states[state]:
            below = node.below.get(symbol)
            if below is None:
                continue
            if token is None and below.token is not None and may_follow(last, below.token):
                token, adds = below.token, count + 1
            if below.below:
                moved.append((below, last, count))
        goal = (*((node, last, count - adds) for node, last, count in moved), (self._merges.root, token, 0))
        number = self._numbers.get(goal)
        if number is None:
            number = self._numbers[goal] = len(self._states)
            self._states.append(goal)
            if number * 256 >= len(self._table):
                more = np.full(len(self._table) // 4 // 256 * 256, -1, np.int32)
                self._table = np.concatenate([self._table, more])
        self._table[state << 8 | byte] = number << 8 | adds + _ZERO

    def _step(self, states: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and the tokens added with ``_ZERO`` on top."""
        keys = states << 8 | codes
        found = self._table.take(keys)
        if found.min() < 0:
            for key in np.unique(keys[found < 0]).tolist():
                self._compile(key >> 8, key & 255)
            found = self._table.take(keys)
        return found >> 8, found.astype(np.uint8)

    def added(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each byte, the tokens that it adds; ``starts`` marks the first bytes of words."""
        if len(self._states) > MOST_STATES:
            self._reset()
        n = len(codes)
        chunks = -(-n // CHUNK_BYTES)
        size = min(CHUNK_BYTES, n)
        grid = np.zeros(chunks * size, np.uint8)
        grid[:n] = codes
        marks = np.zeros(chunks * size, bool)
        marks[:n] = starts
        marks[n:] = True
        # One row a place in the chunks, so that a step reads one row.
        grid = np.ascontiguousarray(grid.reshape(chunks, size).T)
        marks = np.ascontiguousarray(marks.reshape(chunks, size).T)
        adds = np.full((size, chunks), _ZERO, np.uint8)

        state = np.full(chunks, _IDLE, np.int32)
        for i in range(size):
            state[marks[i]] = _START
            state, adds[i] = self._step(state, grid[i])

        # The scan: a constant map hands its state on; a chunk inside one word first applies its own map.
        entry = np.r_[np.int32(_IDLE), state[:-1]]
        inside = ~marks.any(axis=0)
        for chunk in np.flatnonzero(inside):
            own = entry[chunk : chunk + 1]
            for i in range(size):
                own, adds[i, chunk : chunk + 1] = self._step(own, grid[i, chunk : chunk + 1])
            if chunk + 1 < chunks:
                entry[chunk + 1] = own[0]

        heads = np.where(inside, 0, marks.argmax(axis=0))
        lanes = np.flatnonzero(heads)
        state = entry[lanes]
        at = 0
        while len(lanes):
            state, adds[at, lanes] = self._step(state, grid[at, lanes])
            at += 1
            left = heads[lanes] > at
            lanes, state = lanes[left], state[left]
        return adds.T.reshape(-1)[:n].astype(np.int16) - _ZERO

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        sizes = np.array([len(t) for t in texts], np.int64)
        out = np.zeros(len(texts), np.int64)
        filled = np.flatnonzero(sizes)
        if not len(filled):
            return out
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        first = (np.cumsum(sizes) - sizes)[filled]
        starts = word_starts(codes, first)
        widths = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        place = np.cumsum(widths) - widths
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        marks = np.zeros(len(data), bool)
        marks[place[starts]] = True
        adds = self.added(data, marks)
        out[filled] = np.add.reduceat(adds, place[first], dtype=np.int64)
        return out


@lru_cache(maxsize=1)
def transducer(path: str) -> CountingTransducer:
    """One transducer for each Python worker; its states are kept between batches."""
    return CountingTransducer(path)


def _counted(machine: CountingTransducer, texts: list[str]) -> list[int]:
    """Counts of texts in which added tokens are tokens of their own, as the library has them."""
    if not machine.special:
        return machine.count(texts).tolist()
    cut = regex.compile("|".join(map(regex.escape, machine.special)))
    parts: list[str] = []
    n_parts, n_special = [], []
    for text in texts:
        own = cut.split(text)
        parts += own
        n_parts.append(len(own))
        n_special.append(len(own) - 1)
    first = np.cumsum(n_parts) - n_parts
    return (np.add.reduceat(machine.count(parts), first) + n_special).tolist()


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    A null text counts as empty, with no token; a null doc_id stays null; rows that repeat are counted each on
    its own; an empty table gives no row.  Columns other than ``doc_id`` and ``text`` are not read.  For files
    with the byte-level pre-tokenizer, without a normalizer or a prefix space.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer_path)
        for batch in batches:
            counts: list[int] = []
            waiting: list[str] = []
            chars = 0
            for value in batch.column("text"):
                waiting.append(value.as_py())
                chars += len(waiting[-1])
                if chars >= BATCH_CHARS:
                    counts += _counted(machine, waiting)
                    waiting, chars = [], 0
            if waiting:
                counts += _counted(machine, waiting)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    texts = with_text(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = texts.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
