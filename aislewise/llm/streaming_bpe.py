"""BPE encoding with bounded lookahead, and decoding by a state machine.

The encoder reads a word symbol by symbol and keeps, for each of the last symbols, the token that the
encoding of the prefix up to there ends in.  The merge list fixes how many symbols after a token's end it can
still change (``Merges.sufficient_lookahead``); what is further back is stable and is emitted, so memory does
not depend on the length of a word.  The tokens that a prefix may end in come from the trie of tokens, whose
places are linked to their longest endings: one step a symbol, whatever the number of tokens under way.

Words are cut out of pieces between white space.  Words and pieces that have been encoded before come from two
bounded memos.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import Merges, byte_characters
from .work import with_text

MEMO_WORDS = 600_000
MEMO_WORD_CHARS = 64
#: Symbols of a word that are pushed at a time, and pieces whose ids are joined.
SYMBOLS_TOGETHER = 4096
PIECES_TOGETHER = 8192
#: Characters of text whose new words are learnt together.
SLICE_CHARS = 2_000_000
#: What the pre-tokenizer's pattern takes as white space, but for the space; all of it is below U+3001.
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c != " " and regex.match(r"\s", c))


class StreamingEncoder:
    """Tokens of one word, symbol by symbol; ``push`` and ``close`` return what has become stable."""

    def __init__(self, merges: Merges, lookahead: int) -> None:
        self._merges = merges
        self._keep = lookahead + merges.longest
        # Of each prefix since the last emission: its last token and that token's length.
        self._tokens: list[int | None] = [None]
        self._sizes: list[int] = [0]
        # The place in the trie of the longest ending that is there; of each prefix, as above.
        self._place = merges.link()
        self._places = [self._place]

    @property
    def held(self) -> int:
        return len(self._tokens)

    def push(self, *symbols: str) -> list[int]:
        merges, place = self._merges, self._place
        tokens, sizes, places = self._tokens, self._sizes, self._places
        root, known, end, most = merges.root, merges.followers, len(tokens), 2 * self._keep
        out: list[int] = []
        for symbol in symbols:
            below = place.below.get(symbol)
            while below is None and place is not root:
                place = place.ending
                below = place.below.get(symbol)
            place = below or root
            ends = place.ends
            for token, size in ends:
                # The prefix has an encoding, so it ends in the shortest one if in none of the others.
                if size == 1:
                    break
                key = tokens[end - size], token
                may = known.get(key)
                if may or (may is None and merges.may_follow(*key)):
                    break
            if ends:
                tokens.append(token)
                sizes.append(size)
                places.append(place)
                end += 1
            if end > most:
                self._place = place
                out += self._stable()
                tokens, sizes, places = self._tokens, self._sizes, self._places
                end = len(tokens)
        self._place = place
        return out

    def _path(self, end: int) -> list[int]:
        """The prefixes at which the tokens up to ``end`` end, from the first kept one on."""
        ends = []
        while end > 0:
            ends.append(end)
            end -= self._sizes[end]
        return ends[::-1]

    def _stable(self) -> list[int]:
        end = len(self._tokens) - 1
        path = [at for at in self._path(end) if at <= end - self._keep]
        if not path:
            return []
        cut = path[-1]
        out = [self._tokens[at] for at in path]
        # Every place that a token may go on from goes back through the cut: that is what the lookahead says.
        place = self._place
        while place is not self._merges.root:
            start = end - place.depth
            if place.below and (start < cut or cut not in self._path(start)):
                return []
            place = place.ending
        self._tokens, self._sizes = self._tokens[cut:], [0, *self._sizes[cut + 1 :]]
        self._places = self._places[cut:]
        return out

    def back_to(self, prefix: int) -> None:
        """Forgets all but the first ``prefix`` symbols, before anything has been emitted."""
        del self._tokens[prefix + 1 :], self._sizes[prefix + 1 :], self._places[prefix + 1 :]
        self._place = self._places[prefix]

    def close(self) -> list[int]:
        return [self._tokens[at] for at in self._path(len(self._tokens) - 1)]


class StreamingDecoder:
    """Token texts to text: byte-level tokens go through a UTF-8 state machine, others are joined by a space."""

    def __init__(self, codec: TextCodec) -> None:
        self._codec = codec
        self._utf8 = codecs.getincrementaldecoder("utf-8")("replace") if codec.byte_level else None
        self._first = True

    def push(self, ids: Iterable[int]) -> str:
        texts = self._codec.texts
        if self._utf8 is None:
            out = " ".join(map(texts.__getitem__, ids))
            if out and not self._first:
                out = " " + out
            self._first &= not out
            return out
        return self._utf8.decode(b"".join(map(self._codec.bytes_of.__getitem__, ids)))

    def close(self) -> str:
        return self._utf8.decode(b"", final=True) if self._utf8 else ""


class TextCodec:
    """Whole texts to ids and back, for the word-level pre-tokenizer that lower-cases and drops white space."""

    #: The pre-tokenizer's pattern.
    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str) -> None:
        self.merges = Merges(path)
        self.lookahead = self.merges.sufficient_lookahead()
        added = {t["content"]: t["id"] for t in self.merges.file["added_tokens"]}
        self._added = added
        self._cut = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self._words = regex.compile(self.WORDS)
        self._characters = byte_characters()
        self._printable = dict(enumerate(self._characters))
        self._memo: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {"": b""}
        self.texts = {token: text for text, token in (self.merges.ids | added).items()}
        decoder = self.merges.file["decoder"]
        self.byte_level = bool(decoder) and decoder["type"] == "ByteLevel"
        if self.byte_level:
            code = {c: bytes([b]) for b, c in enumerate(self._characters)}
            self.bytes_of = {
                token: text.encode() if text in added else b"".join(code[c] for c in text)
                for token, text in self.texts.items()
            }

    @staticmethod
    def pieces(text: str) -> list[str]:
        """What lies between white space, in NFC and with each character lower-cased on its own; some are empty."""
        text = unicodedata.normalize("NFC", text)
        for space in _SPACES:
            text = text.replace(space, " ")
        # As a whole, only a final sigma would come out differently.
        return ("".join(map(str.lower, text)) if "Σ" in text else text.lower()).split(" ")

    def _symbols(self, word: str) -> str:
        """The word's symbols, of which the last one lacks its suffix."""
        return word.encode().decode("latin-1").translate(self._printable)

    def stream(self, word: str) -> Iterator[list[int]]:
        """Ids of one word, with memory that does not depend on its length."""
        encoder = StreamingEncoder(self.merges, self.lookahead)
        symbols = self._symbols(word)
        last = len(symbols) - 1
        for at in range(0, last, SYMBOLS_TOGETHER):
            yield encoder.push(*symbols[at : min(at + SYMBOLS_TOGETHER, last)])
        yield encoder.push(symbols[last] + self.merges.suffix)
        yield encoder.close()

    def _word(self, word: str) -> bytes:
        ids = self._memo.get(word)
        return b"".join(map(_packed, self.stream(word))) if ids is None else ids

    def _piece(self, piece: str) -> bytes:
        ids = b"".join(map(self._word, self._words.findall(piece)))
        if len(piece) <= MEMO_WORD_CHARS:
            if len(self._pieces) >= MEMO_WORDS:
                self._pieces.clear()
            self._pieces[piece] = ids
        return ids

    def learn(self, texts: list[list[int | list[str]]]) -> None:
        """Has the memo know the words of these texts, given as ``parts``.

        New words are taken in order, so that the encoder goes on from the prefix that a word shares with the
        one before it.
        """
        pieces: set[str] = set()
        for parts in texts:
            pieces.update(*(part for part in parts if isinstance(part, list)))
        words = {
            word
            for piece in pieces - self._pieces.keys()
            for word in self._words.findall(piece)
            if len(word) <= MEMO_WORD_CHARS and word not in self._memo
        }
        if len(self._memo) + len(words) > MEMO_WORDS:
            self._memo.clear()
        encoder, before = StreamingEncoder(self.merges, self.lookahead), ""
        for word in sorted(words):
            symbols = self._symbols(word)
            last = len(symbols) - 1
            shared = 0
            for one, other in zip(symbols[:last], before):
                if one != other:
                    break
                shared += 1
            # One that has emitted tokens, or met a symbol without a token, cannot go back.
            if encoder.held == len(before) + 1:
                encoder.back_to(shared)
            else:
                encoder, shared = StreamingEncoder(self.merges, self.lookahead), 0
            ids = encoder.push(*symbols[shared:last])
            before = symbols[:last]
            if encoder.held == len(before) + 1:
                ids += encoder.push(symbols[last] + self.merges.suffix)
                self._memo[word] = _packed([*ids, *encoder.close()])
                encoder.back_to(last)

    def parts(self, text: str) -> list[int | list[str]]:
        """The text's added tokens, and the pieces between them."""
        special = self._cut and any(map(text.__contains__, self._added))
        cut = self._cut.split(text) if special else [text]
        return [self._added[part] if i % 2 else self.pieces(part) for i, part in enumerate(cut)]

    def encode_parts(self, parts: list[int | list[str]]) -> Iterator[bytes]:
        """Ids as little-endian 32-bit integers, in order, of some pieces or an added token at a time."""
        known = self._pieces
        for part in parts:
            if not isinstance(part, list):
                yield _packed([part])
                continue
            for at in range(0, len(part), PIECES_TOGETHER):
                some = part[at : at + PIECES_TOGETHER]
                found = list(map(known.get, some))
                if None in found:
                    # One that was new a moment ago may be known by now.
                    found = [
                        (known.get(piece) or self._piece(piece)) if ids is None else ids
                        for piece, ids in zip(some, found, strict=True)
                    ]
                yield b"".join(found)

    def encode(self, text: str) -> Iterator[bytes]:
        return self.encode_parts(self.parts(text))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=1)
def codec(path: str) -> TextCodec:
    """One for each Python worker, with its memo."""
    own = TextCodec(path)
    own.merges.link()
    # The trie stays as long as the worker, so no garbage collection need walk through it.
    gc.freeze()
    return own


def _slices(texts: pa.Array) -> Iterator[list[str]]:
    held: list[str] = []
    chars = 0
    for text in texts:
        held.append(text.as_py())
        chars += len(held[-1])
        if chars >= SLICE_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def encode_and_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text is an empty one: no ids, and an empty decoded text.  A null doc_id stays null; rows that
    repeat are encoded each on its own; an empty table gives no row.  Columns other than ``doc_id`` and
    ``text`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path)
        for batch in batches:
            counts, ids_hashes, text_hashes = [], [], []
            for texts in _slices(batch.column("text")):
                held = [own.parts(text) for text in texts]
                own.learn(held)
                for parts in held:
                    ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0
                    decoder = StreamingDecoder(own)
                    for ids in own.encode_parts(parts):
                        ids_hash.update(ids)
                        n += len(ids) // 4
                        text_hash.update(decoder.push(memoryview(ids).cast("I")).encode())
                    text_hash.update(decoder.close().encode())
                    counts.append(n)
                    ids_hashes.append(ids_hash.hexdigest())
                    text_hashes.append(text_hash.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hashes, pa.string()), pa.array(text_hashes, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return with_text(docs).mapInArrow(run, schema)
