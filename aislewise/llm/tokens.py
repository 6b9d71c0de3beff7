"""Whole texts to token ids by the ``tokenizers`` library, with a memo of space-separated pieces.

A byte-level pre-tokenizer never joins characters across a single space or a single line break, except that
the space belongs to the word after it.  Where a text's white space is of that kind only, its ids are those
of its pieces, one after the other, and each piece meets the library once per memo.  Every other text goes
to the library whole.  Both ways give the library's ids; the tests compare them on random texts.

New pieces are learnt many at a time, as one text that is cut at the pieces' ends in bytes; where a token
crosses one, they are learnt one by one.

Texts are cut, and their pieces numbered, by Arrow, a slice of texts at a time; the memo meets each distinct
piece of a slice once, and the ids of all texts are then gathered by number.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bpe import byte_characters
from .work import kept_by_worker

#: Pieces of a generation of the memo (there are two), and the length up to which one is kept.
MEMO_PIECES = 250_000
MEMO_PIECE_CHARS = 64
#: Bytes of text that are cut into pieces at a time, and pieces that are learnt as one text.
SLICE_CHARS = 4_000_000
LEARNT_TOGETHER = 50
#: Texts of one call of the library.
TEXTS_TOGETHER = 100

_LINE_BREAK = (198).to_bytes(4, "little")
#: What Python's ``isspace`` knows, all of it below U+3001; the pattern is for Arrow's expressions, whose own
#: class for white space is that of ASCII.
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: White space that pieces do not know: more than one in a row, or another than a space or a line break.
IRREGULAR = f"[{_SPACES}][{_SPACES}]|[{_SPACES.translate({ord(' '): None, ord(chr(10)): None})}]"


def pieces_of(texts: pa.Array) -> pa.Array:
    """The pieces of regular texts behind a line break: each behind a space, or with its line break."""
    line_break, nothing = (pa.scalar(c, texts.type) for c in ("\n", ""))
    return pc.split_pattern(pc.binary_join_element_wise(line_break, pc.replace_substring(texts, "\n", " \n"), nothing), " ")


def piece_texts(pieces: Iterable[str]) -> list[str]:
    return [p if p[:1] == "\n" else " " + p for p in pieces]


def gathered(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``ids[start:start + count]`` for all starts and counts, one after the other."""
    ends = np.cumsum(counts)
    at = np.repeat(starts - (ends - counts), counts)
    at += np.arange(len(at))
    return ids[at]


class _Known:
    """Numbers of pieces, and the ids of all of them one after the other."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.ids = np.empty(0, "<u4")
        self.starts = self.counts = np.empty(0, np.int64)

    def find(self, pieces: np.ndarray) -> np.ndarray:
        """Their numbers, -1 for those that are not known."""
        return np.fromiter(map(self.numbers.get, pieces.tolist(), repeat(-1)), np.int64, len(pieces))

    def add(self, pieces: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        numbers = range(len(self.numbers), len(self.numbers) + len(pieces))
        self.numbers.update(zip(pieces.tolist(), numbers, strict=True))
        self.starts = np.r_[self.starts, len(self.ids) + np.cumsum(counts) - counts]
        self.counts = np.r_[self.counts, counts]
        self.ids = np.r_[self.ids, ids]
        return np.arange(numbers.start, numbers.stop)


class Memo:
    """What is known of pieces, in two generations: the older half goes when the younger one is full."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int | None = None) -> None:
        self._learn = learn
        self._most = most
        self.young, self._old = _Known(), _Known()

    def know(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Some ids, and for each of these distinct pieces, where its own start there and how many they are."""
        if len(self.young.numbers) > (MEMO_PIECES if self._most is None else self._most):
            self.young, self._old = _Known(), self.young
        young, old = self.young, self._old
        number = young.find(pieces)
        missing = np.flatnonzero(number < 0)
        older = old.find(pieces[missing])
        again, older, new = missing[older >= 0], older[older >= 0], missing[older < 0]
        counts = old.counts[older]
        number[again] = young.add(pieces[again], gathered(old.ids, old.starts[older], counts), counts)
        ids, counts = self._learn(pieces[new].tolist())
        starts = np.cumsum(counts) - counts
        long = np.fromiter(map(len, pieces[new].tolist()), np.int64, len(new)) > MEMO_PIECE_CHARS
        kept, kept_counts = new[~long], counts[~long]
        number[kept] = young.add(pieces[kept], gathered(ids, starts[~long], kept_counts) if long.any() else ids, kept_counts)
        if not long.any():
            return young.ids, young.starts[number], young.counts[number]
        # Long pieces are not kept, so their ids stand behind the memo's for this once.
        number[new[long]] = len(young.numbers) + np.arange(long.sum())
        starts = np.r_[young.starts, len(young.ids) + starts[long]]
        return np.r_[young.ids, ids], starts[number], np.r_[young.counts, counts[long]][number]


def cut_counts(groups: list[np.ndarray], lengths: np.ndarray, ends: np.ndarray, last: np.ndarray) -> np.ndarray | None:
    """How many ids each piece has, whose end counts bytes of all groups; None where a token crosses one.

    ``last`` are the numbers of the last pieces of the groups.
    """
    ids = np.concatenate(groups)
    reached = np.cumsum(lengths[ids])
    at = np.searchsorted(reached, ends) + 1
    if not len(reached) or at[-1] != len(ids) or not np.array_equal(reached[at - 1], ends):
        return None
    if not np.array_equal(at[last], np.cumsum([len(group) for group in groups])):
        return None
    return np.diff(at, prepend=0)


def entry_bytes(path: str, entries: dict[str, int]) -> list[bytes]:
    """The bytes of each token of a byte-level file; those of added tokens are their text."""
    byte_of = {c: bytes([i]) for i, c in enumerate(byte_characters())}
    with open(path, encoding="utf-8") as file:
        added = {t["content"] for t in json.load(file)["added_tokens"]}
    found = [b""] * (max(entries.values(), default=-1) + 1)
    for entry, token in entries.items():
        plain = entry in added or any(c not in byte_of for c in entry)
        found[token] = entry.encode() if plain else b"".join(map(byte_of.__getitem__, entry))
    return found


class PieceEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    With ``specials_as_text``, special strings in a text are plain text.
    """

    def __init__(self, path: str, specials_as_text: bool = False, memo_pieces: int | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._tokenizer.encode_special_tokens = specials_as_text
        self._memo = Memo(self._learn, memo_pieces)
        added = self._tokenizer.get_added_tokens_decoder().values()
        special = "|".join(re.escape(t.content) for t in added if not (specials_as_text and t.special))
        self._irregular = IRREGULAR + (f"|{special}" if special else "")
        self.entries = entry_bytes(path, self._tokenizer.get_vocab())
        self._lengths = np.array([len(b) for b in self.entries])
        self._by_pieces = self._whole(["\n"]) == [_LINE_BREAK]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        # What the library returns takes some hundred bytes a token, so it is asked for a part at a time.
        for at in range(0, len(texts), TEXTS_TOGETHER):
            found = self._tokenizer.encode_batch_fast(texts[at : at + TEXTS_TOGETHER], add_special_tokens=False)
            out += [np.array(one.ids, "<u4") for one in found]
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [ids.tobytes() for ids in self._ids(texts)]

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and how many each has."""
        if not pieces:
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        texts = piece_texts(pieces)
        # White space alone would run together with that of the next piece, so it is a group of its own.
        alone = [at for at, text in enumerate(texts) if len(text) == 1]
        cuts = sorted({*range(0, len(texts), LEARNT_TOGETHER), len(texts), *alone, *(at + 1 for at in alone)})
        groups = self._ids(["".join(texts[start:end]) for start, end in zip(cuts, cuts[1:])])
        ends = np.cumsum([len(text.encode()) for text in texts])
        counts = cut_counts(groups, self._lengths, ends, np.array(cuts[1:]) - 1)
        if counts is not None:
            return np.concatenate(groups), counts
        found: list[np.ndarray] = []
        of_pieces = []
        for own, start, end in zip(groups, cuts, cuts[1:]):
            before = ends[start - 1] if start else 0
            counts = cut_counts([own], self._lengths, ends[start:end] - before, np.array([end - start - 1]))
            each = [own] if counts is not None else self._ids(texts[start:end])
            found += each
            of_pieces.append(np.array([len(ids) for ids in each]) if counts is None else counts)
        return np.concatenate(found), np.concatenate(of_pieces)

    def _by_piece(self, texts: pa.Array) -> list[bytes]:
        if not len(texts):
            return []
        pieces = pieces_of(texts)
        numbered = pieces.flatten().dictionary_encode()
        ids, starts, counts = self._memo.know(numbered.dictionary.to_numpy(zero_copy_only=False))
        number = numbered.indices.to_numpy()
        n_ids = counts[number]
        data = gathered(ids, starts[number], n_ids).tobytes()
        bounds = (4 * np.r_[0, np.cumsum(n_ids)][pieces.offsets.to_numpy()]).tolist()
        # The line break put before a text marks its first piece, and is cut off again.
        return [data[start + 4 : end] for start, end in zip(bounds, bounds[1:])]

    def _slice(self, texts: pa.Array) -> list[bytes]:
        if not self._by_pieces:
            return self._whole(texts.to_pylist())
        whole = pc.match_substring_regex(texts, self._irregular)
        ids = iter(self._by_piece(texts.filter(pc.invert(whole))))
        rest = iter(self._whole(texts.filter(whole).to_pylist()))
        return [next(rest if one else ids) for one in whole.to_pylist()]

    def encode_column(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text of a column without nulls."""
        texts = texts.cast(pa.large_string())
        slices = np.cumsum(pc.binary_length(texts).to_numpy()) // SLICE_CHARS
        cuts = np.flatnonzero(np.diff(slices)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(texts)], strict=True):
            yield from self._slice(texts.slice(start, end - start))

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        waiting: list[str] = []
        chars = 0
        for text in texts:
            waiting.append(text)
            chars += len(text)
            if chars >= SLICE_CHARS:
                yield from self.encode_column(pa.array(waiting, pa.large_string()))
                waiting, chars = [], 0
        if waiting:
            yield from self.encode_column(pa.array(waiting, pa.large_string()))


def encoder(path: str) -> PieceEncoder:
    """One encoder, and so one memo, for each Python worker."""
    return kept_by_worker(("encoder", path), lambda: PieceEncoder(path))
