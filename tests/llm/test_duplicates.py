"""Exact, near and line deduplication against brute force."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest
from helpers import LOWER, matched_lines, near_components
from pyspark.sql import DataFrame

from aislewise.llm import components, exact_dedup, line_dedup, near_dedup, queries, shingles


def exact_groups(docs):
    groups = collections.defaultdict(list)
    for doc_id, text in docs:
        groups[(text or "").translate(LOWER)].append(doc_id)
    return {
        (d, max(ids), len(ids), d == max(ids), hashlib.sha256(text.encode()).hexdigest())
        for text, ids in groups.items()
        for d in ids
    }


@pytest.mark.parametrize("counters", [2, 1024])
def test_exact_groups(awkward, awkward_rows, counters):
    found = {tuple(r) for r in exact_dedup.duplicate_groups(awkward, counters).collect()}
    assert found == exact_groups([r[:2] for r in awkward_rows])


def test_misra_gries_names_every_frequent_key():
    rnd = random.Random(1)
    rows = ["hot"] * 400 + ["warm"] * 200 + [str(rnd.random()) for _ in range(400)]
    rnd.shuffle(rows)
    summary = collections.Counter()
    for i in range(0, 1000, 50):
        summary = exact_dedup.misra_gries(summary + collections.Counter(rows[i : i + 50]), 9)
    assert {"hot", "warm"} <= set(summary) and len(summary) <= 9
    assert 400 - 100 <= summary["hot"] <= 400


def test_drop_copies_keeps_one_row_of_each_text(spark, make_docs, awkward, awkward_rows):
    kept = exact_dedup.drop_copies(awkward)
    assert kept.schema == awkward.schema
    wanted = {g[0] for g in exact_groups([r[:2] for r in awkward_rows]) if g[3]}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(wanted)
    repeated = make_docs([(1, "a", "en", "s", 1), (1, "a", "en", "s", 1), (None, "A", None, None, None), (1, "b", None, None, None)])
    assert sorted((r.doc_id, r.text) for r in exact_dedup.drop_copies(repeated).collect()) == [(1, "a"), (1, "b")]
    assert sum(r.kept for r in exact_dedup.duplicate_groups(repeated).collect()) == 2
    nulls = make_docs([(None, None, None, None, None), (None, "", None, None, None)])
    assert exact_dedup.drop_copies(nulls).count() == 1
    assert exact_dedup.drop_copies(make_docs([])).count() == 0
    assert exact_dedup.duplicate_groups(make_docs([])).count() == 0


def with_ids(rows):
    return sorted((r[0], r[1]) for r in rows)


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_groups(awkward, awkward_rows, words, percent):
    found = {tuple(r) for r in near_dedup.near_duplicates(awkward, words, percent).collect()}
    assert found == near_components(with_ids(awkward_rows), words, percent)


def test_near_groups_of_all_documents(spark, sf_dir, documents):
    found = {tuple(r) for r in queries.op8_near_dedup(spark, sf_dir).collect()}
    assert found == near_components(documents, 3, 85)


def test_near_groups_in_blocks(make_docs, monkeypatch):
    """Many copies of one text, near the threshold, with blocks so small that every bucket is cut."""
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rnd.randint(1, 5)):
            words[rnd.randrange(90)] = f"x{rnd.randrange(10_000)}"
        rows.append((i, " ".join(words), None, None, None))
    found = {tuple(r) for r in near_dedup.near_duplicates(make_docs(rows), 3, 85).collect()}
    assert found == near_components(with_ids(rows), 3, 85)


def test_near_groups_of_no_or_null_rows(make_docs):
    assert near_dedup.near_duplicates(make_docs([])).count() == 0
    rows = [(None, "a b c d e f", None, None, None), (7, "a b c d e f", None, None, None), (9, None, None, None, None)]
    found = sorted(near_dedup.near_duplicates(make_docs(rows)).collect(), key=str)
    assert {(r.doc_id, r.component_id, r.kept) for r in found} == {(None, None, True), (7, 7, True), (9, 9, True)}
    assert near_dedup.drop_near_copies(make_docs(rows)).count() == 3
    twice = make_docs([rows[1], rows[1]])
    assert [tuple(r)[2:] for r in near_dedup.near_duplicates(twice).collect()] == [(7, True)] * 2


def test_components(spark):
    rnd = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(rnd.randint(100, 160), rnd.randint(100, 160)) for _ in range(40)]
    found = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(found[i] == 0 for i in range(61))
    assert all(found[a] == found[b] for a, b in links if a != b)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingle_sets_do_not_depend_on_pieces(monkeypatch):
    text = " ".join(f"Word{i % 50}\t{i}" for i in range(300)) + " " + "y" * 500
    whole = shingles.shingle_set(text, 3)
    monkeypatch.setattr(shingles, "_CHUNK", 37)
    assert np.array_equal(whole, shingles.shingle_set(text.lower(), 3))
    assert whole.shape == (2, 599)


def test_words_of_one_polynomial_hash_are_told_apart(make_docs):
    """Thue-Morse words over a, b and over b, a collide under every polynomial modulo 2^64."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    two = "".join("ba"[i.bit_count() % 2] for i in range(1024))
    rest = " ".join(f"w{i}" for i in range(3))
    rows = [(1, f"{one} {rest}", None, None, None), (2, f"{two} {rest}", None, None, None), (3, one, None, None, None), (4, two, None, None, None)]
    found = {tuple(r) for r in near_dedup.near_duplicates(make_docs(rows), 3, 85).collect()}
    assert found == near_components(with_ids(rows), 3, 85)
    assert len({r[2] for r in found}) == 4


def test_sets_whose_first_lane_collides():
    one = shingles._distinct(np.array([5, 1, 5, 5, 9], np.uint64), np.array([2, 1, 1, 2, 7], np.uint64))
    assert one.tolist() == [[1, 5, 5, 9], [1, 1, 2, 7]]
    two = np.array([[1, 5, 9, 11], [1, 2, 8, 1]], np.uint64)
    assert shingles.shared(one, two) == shingles.shared(two, one) == 2
    assert shingles.shared(one[:, :0], two) == 0
    plain = np.array([[1, 9, 11], [1, 8, 1]], np.uint64)
    assert shingles.shared(plain, two) == 3 and shingles.shared(plain, one[:, [0, 3]]) == 1
    assert np.array_equal(shingles.lanes(one.tobytes()), one)


@pytest.mark.parametrize("block", [2, 512])
def test_rows_that_repeat_a_doc_id(make_docs, monkeypatch, block):
    """One document with several texts joins what each of them is linked with."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rnd = random.Random(12)

    def text(topic: int, changes: int) -> str:
        words = [f"t{topic}w{i}" for i in range(80)]
        for _ in range(changes):
            words[rnd.randrange(80)] = f"x{rnd.randrange(10**6)}"
        return " ".join(words)

    rows = [(3, text(1, 0)), (5, text(1, 1)), (5, text(2, 0)), (5, text(2, 0)), (6, text(2, 1)), (6, text(3, 0)), (9, text(3, 1))]
    rows += [(20, text(4, 0)), (21, text(4, 1)), (21, text(5, 0)), (21, text(4, 1)), (30, text(6, 0)), (31, "")]
    rows = [(*row, None, None, None) for row in rows]
    found = collections.defaultdict(set)
    for row in near_dedup.near_duplicates(make_docs(rows), 3, 85).collect():
        found[row.doc_id].add((row.component_id, row.kept))
    wanted = {3: (3, True), 5: (3, False), 6: (3, False), 9: (3, False), 20: (20, True), 21: (20, False), 30: (30, True), 31: (31, True)}
    assert found == {doc_id: {result} for doc_id, result in wanted.items()}


def test_register_estimates():
    rng = np.random.default_rng(1)
    for same in (100, 900, 3000):
        a, b = (rng.integers(0, 2**64, n, np.uint64) for n in (same, same // 5))
        one = np.unique(a)
        two = np.unique(np.r_[a[: same - same // 10], b])
        truth = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
        estimate, used = shingles.jaccard_estimates(
            shingles.registers(one), len(one), shingles.registers(two)[None, :], np.array([len(two)])
        )
        assert abs(estimate[0] - truth) < 5 * np.sqrt(truth * (1 - truth) / used[0])


def line_rows(frame):
    return {(r.doc_id, r.n_lines, r.removed_lines) for r in frame.collect()}


def test_line_matches(awkward, awkward_rows):
    assert line_rows(line_dedup.line_report(awkward)) == matched_lines(with_ids(awkward_rows))


def test_line_matches_of_all_documents(spark, sf_dir, documents):
    assert line_rows(queries.op6_line_dedup(spark, sf_dir)) == matched_lines(documents)


@pytest.mark.parametrize("hot", [2, 64])
def test_line_matches_under_frequent_words(make_docs, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT_LINES", hot)
    monkeypatch.setattr(line_dedup, "FREQUENCY_BUCKETS", 256)
    rnd = random.Random(6)
    base = [[f"w{k}_{i}" for i in range(20)] for k in range(3)]
    rows = []
    for i in range(160):
        lines = []
        for words in base:
            own = list(words)
            for _ in range(rnd.randint(0, 6)):
                own[rnd.randrange(20)] = f"x{rnd.randrange(60)}"
            lines.append(" ".join(own))
        rows.append((i, "\n".join(lines), None, None, None))
    assert line_rows(line_dedup.line_report(make_docs(rows).repartition(4))) == matched_lines(with_ids(rows))


@pytest.mark.parametrize("hot", [2, 64])
def test_lines_of_four_words_match_those_of_five(make_docs, monkeypatch, hot):
    """A word left out of five or added to four, at each place of the order of rarity; three of four are too few."""
    monkeypatch.setattr(line_dedup, "HOT_LINES", hot)
    rows = []
    for k in range(5):
        five = [f"w{k}_{i}" for i in range(5)]
        four = five[:k] + five[k + 1 :]
        other = [w.replace("w", "v") for w in five]
        fewer = other[:k] + other[k + 1 :]
        rows.append((10 * k, " ".join(four), None, None, None))
        rows.append((10 * k + 1, " ".join(five) + "\n" + " ".join(four[:3]), None, None, None))
        rows.append((10 * k + 2, " ".join(other), None, None, None))
        rows.append((10 * k + 3, " ".join(fewer) + "\n" + " ".join(fewer[1:]), None, None, None))
    # One word in more lines than any HOT_LINES.
    rows += [(100 + i, f"common p{i} q{i} r{i}" + (" s" if i % 2 else ""), None, None, None) for i in range(80)]
    rows += [(200 + i, f"common p{i} q{i} r{i}" + ("" if i % 2 else " s"), None, None, None) for i in range(80)]
    wanted = matched_lines(with_ids(rows))
    assert sum(removed != "" for _, _, removed in wanted) == 10 + 80
    assert line_rows(line_dedup.line_report(make_docs(rows).repartition(4))) == wanted


def test_nothing_of_the_line_join_reaches_the_driver(make_docs, monkeypatch):
    """No table is collected, and no plan holds one as a literal, however many words there are."""
    collected, plans = [], []
    write = line_dedup.written
    monkeypatch.setattr(DataFrame, "collect", lambda frame: collected.append(frame) or [])

    def written(frame, name):
        plans.append(frame._jdf.queryExecution().toString())
        return write(frame, name)

    monkeypatch.setattr(line_dedup, "written", written)
    rows = [(i, " ".join(f"w{i * j}" for j in range(12)), None, None, None) for i in range(300)]
    line_dedup.matched_lines(make_docs(rows).repartition(4)).schema
    assert not collected
    assert max(map(len, plans)) < 200_000


def test_pairs_under_many_frequent_keys_are_made_once(spark, monkeypatch):
    """Lines with many frequent keys in common make one pair, not one for every two of these."""
    monkeypatch.setattr(line_dedup, "_places", lambda pairs: pairs.select("a.doc_id", "b.doc_id"))
    keys = list(range(8))
    frequent = spark.createDataFrame([(key, d, 0) for d in (1, 2, 3) for key in keys], "key long, doc_id long, line int")
    signs = spark.createDataFrame(
        [(d, 0, 20, 0, 0, 0) for d in (1, 2, 3)], "doc_id long, line int, n int, low long, high long, every long"
    )
    matched = spark.createDataFrame([(2, 0)], "doc_id long, line int")
    met = line_dedup._meetings(frequent, matched, signs)
    assert sorted(map(tuple, met.collect())) == [(1, 3), (2, 3)]


def test_lines_under_a_key_of_a_hundred_lines_meet_there(make_docs, monkeypatch):
    """Such a key is not frequent, so no rows are made of its pairs with other keys."""
    counted = []
    meetings = line_dedup._meetings
    monkeypatch.setattr(line_dedup, "_meetings", lambda frequent, *more: counted.append(frequent.count()) or meetings(frequent, *more))
    # All lines post the key of their longest words; the words after these differ, but for every tenth line.
    tails = [" ".join(f"{'abcdefghij'[k]}{i - (i % 10 == 9)}" for k in range(8)) for i in range(100)]
    rows = [(i, f"longestwordofall longestwordbutone {tail}", None, None, None) for i, tail in enumerate(tails)]
    rows = [(i, f"{text} x{i}" if i % 10 == 9 else text, *more) for i, text, *more in rows]
    wanted = matched_lines(with_ids(rows))
    assert sum(removed != "" for _, _, removed in wanted) == 10
    assert line_rows(line_dedup.line_report(make_docs(rows).repartition(4))) == wanted
    assert counted == [0]


def test_lines_verified_are_looked_up_in_every_row_of_a_doc_id(make_docs):
    """Of rows that repeat a doc_id or have none, one may have fewer lines than another's match is at."""
    five, four = "q w e r t", "q w e r"
    rows = [(1, f"a\n{five}", None, None, None), (2, "b", None, None, None), (2, f"c\n\n{four}", None, None, None)]
    rows += [(None, f"d\n{four} z", None, None, None), (None, None, None, None, None), (3, f"{five}\n\n", None, None, None)]
    found = sorted((r.doc_id or 0, r.n_lines, r.removed_lines) for r in line_dedup.line_report(make_docs(rows)).collect())
    # 4/6 of the words are too few for the line of the null doc_id and that of document 1, but four of five are not.
    assert found == [(0, 1, ""), (0, 2, ""), (1, 2, ""), (2, 1, "2"), (2, 3, "2"), (3, 3, "0")]


def test_lines_are_cut_out(make_docs):
    rows = [
        (1, "a b c d e\nkeep me here", "en", None, None),
        (2, "other words\nE D C B A\n\n", None, None, None),
        (3, None, None, None, None),
        (None, "q r s", None, None, None),
        (4, "q r s", None, None, None),
    ]
    found = {r.doc_id: r.text for r in line_dedup.drop_matched_lines(make_docs(rows)).collect()}
    assert found == {1: "a b c d e\nkeep me here", 2: "other words\n\n", 3: None, None: "q r s", 4: ""}
    assert line_dedup.line_report(make_docs([])).count() == 0
    assert line_dedup.drop_matched_lines(make_docs([])).count() == 0


def test_line_join_runs_no_python(make_docs):
    plan = line_dedup.line_report(make_docs([(1, "a b\nc", None, None, None)]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_rows_of_the_largest_component_are_dealt_once_for_each_block_of_others(spark, monkeypatch):
    """All pairs across components meet in one run, and rows do not grow with the square of a bucket."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rows = [(7, i, 0 if i >= 20 else i + 1, 1000) for i in range(1000)] + [(8, i, i % 2, 3) for i in range(3)]
    bucket = spark.createDataFrame(rows, "key long, class_id long, component long, members long")
    largest = spark.createDataFrame([(7, 980, 0), (8, 2, 0)], "key long, n_largest long, largest long")
    dealt = near_dedup._dealt(bucket.join(largest, "key"), best_only=False).collect()
    assert len(dealt) <= 4 * 1000
    runs = collections.defaultdict(list)
    for row in dealt:
        runs[row.key, row.low, row.high].append(row)
    met = collections.Counter()
    for (key, low, high), own in runs.items():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                if a.component != b.component and (low == high or a.block != b.block):
                    met[key, *sorted((a.class_id, b.class_id))] += 1
    component = {(key, i): c for key, i, c, _ in rows}
    wanted = {(key, i, j) for key, i in component for at, j in component if at == key and i < j and component[key, i] != component[key, j]}
    assert set(met) == wanted and set(met.values()) == {1}
    assert near_dedup._dealt(bucket.join(largest, "key"), best_only=True).count() == len(rows)
