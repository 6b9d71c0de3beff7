"""Word-shingle sets of whole texts as sorted 128-bit hashes, and HyperMinHash registers of such sets.

A word's hash is a sum of its bytes, each times a number drawn for its place in the word, in two lanes of 64 bits
whose numbers are drawn apart.  Such a sum has no texts that collide by their form, as a polynomial has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that separate words: space and U+0009 to U+000D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text that are hashed at a time.
_CHUNK = 1 << 20

_U = np.uint64
_STEP, _JOIN = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


#: Where the numbers of each lane begin in the sequence they are drawn from, and what joins words in it.
_LANES = (_U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB))
_JOINS = (_JOIN, _U(0x8EBC6AF09C88C6E3))
_BYTE = mixed(np.arange(1, 257, dtype=_U) * _STEP) | _U(1)
_drawn = np.empty((len(_LANES), 0), _U)


def _places_to(n: int) -> np.ndarray:
    """The number of each place in a word, for words of up to ``n`` bytes; one row a lane."""
    global _drawn
    if _drawn.shape[1] < n:
        with np.errstate(over="ignore"):
            places = np.arange(2 * n, dtype=_U) * _STEP
            _drawn = np.stack([mixed(places + lane) for lane in _LANES])
    return _drawn


def _pieces(text: bytes) -> Iterator[bytes]:
    """``text`` in pieces of about ``_CHUNK`` bytes that end at white space."""
    at = 0
    while len(text) - at > _CHUNK:
        space = np.frombuffer(text, np.uint8, _CHUNK, at)
        ends = np.flatnonzero(_SPACE[space])
        size = _CHUNK
        if len(ends):
            size = int(ends[-1]) + 1
        else:  # one word longer than a piece: it ends at the next white space
            rest = np.flatnonzero(_SPACE[np.frombuffer(text, np.uint8, offset=at)])
            size = int(rest[0]) + 1 if len(rest) else len(text) - at
        yield text[at : at + size]
        at += size
    yield text[at:]


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word, in order, one row a lane; A-Z count as a-z."""
    found = []
    for piece in _pieces(text.encode().lower()):
        codes = np.frombuffer(piece, np.uint8)
        inside = ~_SPACE[codes]
        starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
        if not len(starts):
            continue
        ends = np.flatnonzero(inside & ~np.r_[inside[1:], False]) + 1
        sizes = ends - starts
        first = np.cumsum(sizes) - sizes
        within = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        values = _BYTE[codes[inside]]
        with np.errstate(over="ignore"):
            found.append(
                np.stack([
                    mixed(np.add.reduceat(values * places[within], first) + sizes.astype(_U))
                    for places in _places_to(int(sizes.max()))
                ])
            )
    return np.concatenate(found, axis=1) if found else np.empty((len(_LANES), 0), _U)


def shingle_set(text: str, words: int) -> np.ndarray:
    """Distinct ``words``-word shingles, one a column, sorted; with fewer words, the whole sequence as one.

    The first lane alone, ``[0]``, is a sorted set of 64-bit hashes, in which two shingles may meet.
    """
    hashes = word_hashes(text)
    if not hashes.shape[1]:
        return hashes
    size = min(words, hashes.shape[1])
    n = hashes.shape[1] - size + 1
    lanes = []
    with np.errstate(over="ignore"):
        for own, join in zip(hashes, _JOINS, strict=True):
            joined = np.full(n, size, _U)
            for i in range(size):
                joined = joined * join + own[i : i + n]
            lanes.append(mixed(joined))
    return _distinct(*lanes)


def _distinct(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    order = np.argsort(one)
    one, two = one[order], two[order]
    again = one[1:] == one[:-1]
    if (two[1:][again] != two[:-1][again]).any():
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        again = one[1:] == one[:-1]
    new = np.r_[True, ~again | (two[1:] != two[:-1])]
    return np.stack([one[new], two[new]])


def shared(one: np.ndarray, two: np.ndarray) -> int:
    """Shingles that two sets have in common."""
    if one.shape[1] > two.shape[1]:
        one, two = two, one
    if not one.shape[1]:
        return 0
    if any((own[0, 1:] == own[0, :-1]).any() for own in (one, two)):
        return len(set(zip(*one.tolist())) & set(zip(*two.tolist())))
    at = np.minimum(np.searchsorted(two[0], one[0]), two.shape[1] - 1)
    return int(((two[0, at] == one[0]) & (two[1, at] == one[1])).sum())


def lanes(own: memoryview | bytes) -> np.ndarray:
    """A set as :func:`shingle_set` gives it, from its bytes."""
    return np.frombuffer(own, np.uint64).reshape(len(_LANES), -1)


# --- HyperMinHash ---------------------------------------------------------------------------------------------

BUCKET_BITS = 8
BUCKETS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
EMPTY = np.uint16(0xFFFF)
#: For each bucket, the others in the order in which an empty one borrows from them.
_LENDERS = np.argsort(mixed(np.arange(BUCKETS * BUCKETS, dtype=_U) + _STEP).reshape(BUCKETS, BUCKETS), axis=1)


def registers(shingles: np.ndarray, bits: int = BUCKET_BITS) -> np.ndarray:
    """Of each bucket's smallest hash, the count of leading zeros and the ten bits after the first one bit.

    The top ``bits`` of a hash choose its bucket, so a sorted set has each bucket's smallest hash first.
    """
    out = np.full(1 << bits, EMPTY)
    bucket = (shingles >> _U(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
    # 52 bits are whole numbers to a double, whose exponent and mantissa are then the parts wanted.
    rest = (((shingles[first] << _U(bits)) >> _U(12)).astype(np.float64)).view(np.int64)
    zeros = np.minimum(1074 - (rest >> 52), 52)
    mantissa = (rest >> (52 - MANTISSA_BITS)) & ((1 << MANTISSA_BITS) - 1)
    out[bucket[first]] = (zeros << MANTISSA_BITS | mantissa).astype(np.uint16)
    return out


def filled(own: np.ndarray) -> np.ndarray:
    """``own`` with each empty register lent the value of the first filled one in its fixed order."""
    empty = np.flatnonzero(own == EMPTY)
    if not len(empty) or len(empty) == BUCKETS:
        return own
    own = own.copy()
    lenders = _LENDERS[empty]
    own[empty] = own[lenders[np.arange(len(empty)), (own != EMPTY)[lenders].argmax(axis=1)]]
    return own


def band_keys(own: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` registers."""
    bands = BUCKETS // rows
    values = filled(own)[: bands * rows].reshape(bands, rows).astype(_U)
    keys = np.arange(1, bands + 1, dtype=_U) * _STEP
    with np.errstate(over="ignore"):
        for i in range(rows):
            keys = mixed(keys * _JOIN + values[:, i])
    return keys.view(np.int64)


def expected_collisions(n: np.ndarray, m: np.ndarray, buckets: int) -> np.ndarray:
    """Registers of two sets of ``n`` and ``m`` that agree by chance (after Yu and Weber, HyperMinHash)."""
    ratio = np.minimum(n, m) / np.maximum(np.maximum(n, m), 1)
    return 0.169919487 * buckets / 2.0**MANTISSA_BITS * 4 * ratio / (1 + ratio) ** 2


def jaccard_estimates(one: np.ndarray, n: int, others: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected estimates of one set against others, and the registers that each rests on."""
    either = (one != EMPTY) | (others != EMPTY)
    used = either.sum(axis=1)
    equal = ((one == others) & (one != EMPTY)).sum(axis=1)
    by_chance = expected_collisions(np.full(len(m), n), m, len(one))
    return np.maximum(equal - by_chance, 0) / np.maximum(used, 1), used
