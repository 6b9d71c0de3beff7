"""The merges of a BPE file: which tokens may stand next to each other, and the tokens of every prefix.

A sequence of tokens is the encoding of its text exactly if each token is the encoding of its own text and
every two neighbours are the encoding of theirs.  So the encoding of a prefix ends in the one token, of those
that the prefix ends in, that may follow the last token of what is before it; no other merge is replayed.

A word is a sequence of symbols: for most files, the 256 bytes as printable characters; where a file has an
end-of-word suffix, the last symbol of a word carries it.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The printable character that a byte-level vocabulary writes for each byte (fixed values).

    Bytes that are printable in Latin-1 stand for themselves, the others for U+0100 onwards, in order.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class Node:
    """A place in the trie of tokens; ``token`` is the id of the one that ends there.

    ``Merges.link`` adds the place's depth, the place of its longest proper ending that is in the trie, and the
    tokens that end here, longest first, with their lengths.
    """

    __slots__ = ("below", "depth", "ending", "ends", "token")

    def __init__(self) -> None:
        self.below: dict[str, Node] = {}
        self.token: int | None = None


class Merges:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            self.file = json.load(file)
        model = self.file["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.rank = {pair: i for i, pair in enumerate(pairs)}
        special = {t["content"] for t in self.file["added_tokens"]}
        made = {a + b for a, b in pairs}
        self.symbols_of: dict[int, tuple[str, ...]] = {}
        self.root = Node()
        for text, token in self.ids.items():
            if text in special:
                continue
            symbols = self.split(text)
            if len(symbols) > 1 and text not in made:
                continue
            self.symbols_of[token] = symbols
            node = self.root
            for symbol in symbols:
                node = node.below.setdefault(symbol, Node())
            node.token = token
        self.longest = max(map(len, self.symbols_of.values()))
        self._linked = False
        # The pair that makes a text, with its rank; nothing where some text is made by more than one.
        self._made = {a + b: (a, b, i) for (a, b), i in self.rank.items()} if len(made) == len(pairs) else {}
        self._whole: dict[int, bool] = {}
        #: Answers of ``may_follow`` so far.
        self.followers: dict[tuple[int | None, int], bool] = {}

    def split(self, text: str) -> tuple[str, ...]:
        """The symbols of a token's text; the suffix belongs to the last one."""
        if self.suffix and text.endswith(self.suffix) and text != self.suffix:
            body = text[: -len(self.suffix)]
            return (*body[:-1], body[-1] + self.suffix)
        return tuple(text)

    def merged(self, symbols: tuple[str, ...]) -> list[str]:
        """The encoding by replaying merges, lowest rank first and leftmost of equal ones."""
        parts: list[str | None] = list(symbols)
        after = [*range(1, len(parts)), -1]
        before = [*range(-1, len(parts) - 1)]
        rank = self.rank
        waiting = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := rank.get((a, b))) is not None]
        heapq.heapify(waiting)
        while waiting:
            _, i, a, b = heapq.heappop(waiting)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := rank.get((parts[left], parts[right]))) is not None:
                    heapq.heappush(waiting, (r, left, parts[left], parts[right]))
        return [p for p in parts if p is not None]

    def link(self) -> Node:
        """The trie's root, with every place linked to its longest ending."""
        root = self.root
        if self._linked:
            return root
        root.depth, root.ending, root.ends = 0, root, ()
        level = [root]
        while level:
            following = []
            for node in level:
                for symbol, below in node.below.items():
                    ending = node.ending
                    while symbol not in ending.below and ending is not root:
                        ending = ending.ending
                    below.depth = node.depth + 1
                    below.ending = ending.below.get(symbol, root) if node is not root else root
                    below.ends = below.ending.ends
                    if below.token is not None:
                        below.ends = ((below.token, below.depth), *below.ends)
                    following.append(below)
            level = following
        self._linked = True
        return root

    def _is_whole(self, token: int) -> bool:
        """Whether the encoding of a token's text is the token."""
        known = self._whole.get(token)
        if known is None:
            symbols = self.symbols_of[token]
            known = self._whole[token] = self.merged(symbols) == ["".join(symbols)]
        return known

    def _stay_apart(self, left: str, right: str) -> bool:
        """Whether no merge takes in both the end of one whole token and the start of the next.

        Their merges are undone, the last one first: a merge across the border that comes before the one undone
        would have been made in its place.  Of equal rank, the left one is made first.
        """
        rank, made = self.rank, self._made
        limit = len(rank)
        while True:
            if rank.get((left, right), limit) < limit:
                return False
            of_left, of_right = made.get(left), made.get(right)
            if of_left and (not of_right or of_left[2] > of_right[2]):
                _, left, limit = of_left
            elif of_right:
                right, _, before = of_right
                limit = before + 1
            else:
                return True

    def may_follow(self, last: int | None, token: int) -> bool:
        """Whether ``token`` can stand after ``last`` in an encoding; None is the start of a word."""
        key = (last, token)
        known = self.followers.get(key)
        if known is None:
            left = () if last is None else self.symbols_of[last]
            right = self.symbols_of[token]
            if self._made:
                known = self._is_whole(token) and (
                    last is None or (self._is_whole(last) and self._stay_apart("".join(left), "".join(right)))
                )
            else:
                known = self.merged(left + right) == ["".join(part) for part in (left, right) if part]
            self.followers[key] = known
        return known

    def sufficient_lookahead(self) -> int:
        """Symbols after a token's end beyond which nothing can change it any more.

        A merge that was made in a prefix is only undone by one of lower rank that overlaps it on the right,
        and that one by another of still lower rank.  So tokens are taken in order of rank; the reach of one
        is its own length, or further by the reach of an earlier one that starts inside it.
        """
        reach: dict[tuple[str, ...], int] = {}  # of the earlier tokens that begin with these symbols
        furthest = 1
        for a, b in self.rank:
            symbols = self.split(a + b)
            n = len(symbols)
            own = max([n, *(at + reach.get(symbols[at:], 0) for at in range(1, n))])
            for end in range(1, n + 1):
                start = symbols[:end]
                reach[start] = max(reach.get(start, 0), own)
            furthest = max(furthest, own)
        return furthest
