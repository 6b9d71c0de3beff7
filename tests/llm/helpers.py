"""Brute-force versions of the operators, and small tables with every awkward row."""

from __future__ import annotations

import collections
import random
import re
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = {i: i + 32 for i in range(65, 91)}

WORDS = "the of and tion ing rest Über naïve cat's we'll 42 3.5 % -- <|endoftext|> 中文  x y".split(" ")


def awkward_documents(seed: int = 1, n: int = 120) -> list[tuple]:
    """Nulls in every column, empty and long texts, exact and near copies, and repeated rows."""
    rnd = random.Random(seed)
    base = [rnd.choice(WORDS) + rnd.choice(["", "er", "s"]) for _ in range(70)]
    texts: list[str | None] = [None, "", " ", "\n", "\n\n a", "A", "a", "one two", "ONE two", "x" * 5000, "word " * 4000]
    while len(texts) < n:
        words = list(base)
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 9])):
            words[rnd.randrange(len(words))] = rnd.choice(WORDS)
        lines = rnd.choice([1, 3])
        cut = len(words) // lines
        texts.append("\n".join(" ".join(words[i : i + cut]) for i in range(0, len(words), cut)))
    rows = [
        (i * 7 % n, text, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", None]), None)
        for i, text in enumerate(texts)
    ]
    return rows


def crc(ids: list[int]) -> int:
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def shingles(text: str | None, words: int) -> set:
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(found) < words:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)}


def near_components(docs: list[tuple], words: int, percent: int) -> set[tuple]:
    """(doc_id, n_shingles, component, kept), by counting the shared shingles of all pairs."""
    sets = [shingles(text, words) for _, text in docs]
    parent = list(range(len(docs)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i, own in enumerate(sets):
        shared = collections.Counter(j for s in own for j in holders[s])
        for j, both in shared.items():
            if 100 * both >= percent * (len(own) + len(sets[j]) - both):
                a, b = find(i), find(j)
                # The root is the one of the smallest doc_id.
                low, high = sorted((a, b), key=lambda k: docs[k][0])
                parent[high] = low
        for s in own:
            holders[s].append(i)
    roots = [docs[find(i)][0] for i in range(len(docs))]
    return {(d, len(s), root, d == root) for (d, _), s, root in zip(docs, sets, roots, strict=True)}


def matched_lines(docs: list[tuple]) -> set[tuple]:
    """(doc_id, n_lines, removed) with docs in ascending order of doc_id."""
    seen: list[frozenset] = []
    out = set()
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        gone = []
        for number, line in enumerate(lines):
            own = frozenset(w for w in re.split(r"[ \t\x0b\x0c\r]+", line.lower()) if w)
            if own and any(5 * len(own & other) >= 4 * len(own | other) for other in seen):
                gone.append(number)
            if own:
                seen.append(own)
        out.add((doc_id, len(lines), ",".join(map(str, gone))))
    return out
