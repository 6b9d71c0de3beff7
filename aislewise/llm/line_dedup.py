"""Removal of lines that are near-duplicates of an earlier line, by an exact set-similarity join.

A line is the set of its words, as hashes in an order that puts long words first, as those are rare.  A key is a
pair of words that are neighbours in this order.  Where two lines have a Jaccard similarity of 4/5, with ``o`` words
in both and ``d`` in one of them only, ``o`` is 4 * ``d`` or more, and each of the ``d`` words parts at most one pair
of common words that follow each other.  So of the first d + 2 such pairs at least two are keys of both lines, and
they stand among the first 2 * floor(n / 5) + 2 keys of a line of n words (one more where n % 5 is 4), which are the
keys it posts.

Only whether a line has an earlier match matters, so groups of near copies need not become pairs.  Under a key that
``HOT_LINES`` lines or fewer hold, every line meets all earlier ones.  Under a more frequent key it meets the earliest
line first; lines that this does not remove meet all earlier lines with which they share two such keys, as they do
with every similar line that they have not met.  Pairs pass filters on length and on the parities of their words in
64 groups (128 for long lines); what is left is verified on the whole sets.

All of it is DataFrame functions; nothing is sent to the driver or comes back to the tasks as a literal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import removed, with_text, written

#: Classes of words by their length in bytes, which stands for their frequency.
FREQUENCY_BUCKETS = 32
HOT_LINES = 128
#: The keys are dealt out in so many rounds, each of which holds the shuffle files of its part only.
_ROUNDS = 2
#: Words from which a line has the parities of 128 groups.
LONG_LINE = 48
#: Jaccard similarity of at least 4/5.  With both sizes known, that is an overlap of 4/9 of their sum.
_SIMILAR, _OF = 4, 5
_SPACES = "\t\x0b\x0c\r"


def _lines(docs: DataFrame) -> DataFrame:
    return with_text(docs).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "words"))


def _split(line: Column) -> Column:
    """Words of a line, with empty ones; white space separates them and case does not count."""
    lower = F.lower(line)
    # Most lines have blanks only, and to replace characters takes longer than to look for them.
    other = F.lit(False)
    for space in _SPACES:
        other = other | F.contains(line, F.lit(space))
    return F.split(F.when(other, F.translate(lower, _SPACES, " " * len(_SPACES))).otherwise(lower), " ")


def _words(line: Column) -> Column:
    """Distinct words of a line as 64-bit hashes."""
    hashes = F.transform(_split(line), lambda w: F.xxhash64(w))
    return F.array_distinct(F.array_remove(hashes, F.xxhash64(F.lit(""))))


def _ordered(line: Column) -> Column:
    """Distinct words of a line, long ones first: the class of the length in the upper bits, a hash below."""
    bits = (FREQUENCY_BUCKETS - 1).bit_length()

    def ordered(word: Column) -> Column:
        length = F.least(F.octet_length(word), F.lit(FREQUENCY_BUCKETS - 1)).cast("long")
        return F.shiftrightunsigned(F.xxhash64(word), bits + 1) - F.shiftleft(length, 63 - bits)

    # Only the empty word has a number from 0 on.
    words = F.array_distinct(F.transform(_split(line), ordered))
    return F.sort_array(F.array_remove(words, ordered(F.lit(""))))


def _keys(ordered: Column, n: Column) -> Column:
    """Hashes of the neighbours that a line of n words posts; sets of up to three words are similar only when equal."""
    most = 2 * F.floor(n / _OF).cast("int") + 2 + F.when(n % _OF == _SIMILAR, 1).otherwise(0)
    first = F.least(most, n - 1)
    pairs = F.zip_with(F.slice(ordered, F.lit(1), first), F.slice(ordered, F.lit(2), first), lambda a, b: F.xxhash64(a, b))
    return F.when(n >= _SIMILAR, pairs)


def _parity(words: Column) -> Column:
    one = F.lit(1).cast("long")

    def flipped(acc: Column, word: Column) -> Column:
        group = word.bitwiseAND(F.lit(63).cast("long")).cast("int")
        return acc.bitwiseXOR(F.call_function("shiftleft", one, group))

    return F.aggregate(words, F.lit(0).cast("long"), flipped)


def _earlier(a: str, b: str) -> Column:
    """Whether line a comes before line b; a null doc_id comes first, as in every order here."""
    same = F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))
    before = (F.col(f"{a}.doc_id").isNull() & F.col(f"{b}.doc_id").isNotNull()) | F.coalesce(
        F.col(f"{a}.doc_id") < F.col(f"{b}.doc_id"), F.lit(False)
    )
    return before | (same & (F.col(f"{a}.line") < F.col(f"{b}.line")))


def _same_place(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.line") == F.col(f"{b}.line"))


def _near(a: Column | dict[str, Column], b: Column | dict[str, Column]) -> Column:
    """Length and parity filters let the two lines pass: sets that differ in d words differ in the parities of d groups at most."""
    length = (_OF * a["n"] >= _SIMILAR * b["n"]) & (_OF * b["n"] >= _SIMILAR * a["n"])
    differ = F.bit_count(a["every"].bitwiseXOR(b["every"]))
    return length & ((_OF + _SIMILAR) * differ <= (_OF - _SIMILAR) * (a["n"] + b["n"]))


def _candidate(a: str, b: str) -> Column:
    """Line a is earlier, and length and parity filters let the pair pass, those of long lines too."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    low, high = (F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")) for c in ("low", "high"))
    in_all = (_OF + _SIMILAR) * (F.bit_count(low) + F.bit_count(high)) <= (_OF - _SIMILAR) * (na + nb)
    short = (na <= LONG_LINE) | (nb <= LONG_LINE)
    left, right = ({c: F.col(f"{row}.{c}") for c in ("n", "every")} for row in (a, b))
    return _near(left, right) & (short | in_all) & _earlier(a, b)


def _places(pairs: DataFrame) -> DataFrame:
    """The places of the lines ``a`` (the earlier one) and ``b``."""
    return pairs.select(F.struct("a.doc_id", "a.line").alias("a"), F.struct("b.doc_id", "b.line").alias("b")).distinct()


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The later places of the pairs that are similar; the texts are read again, and sets made of the lines named."""
    places = pairs.select(F.explode(F.array("a", "b")).alias("place")).distinct().select("place.*")
    named = places.groupBy("doc_id").agg(F.collect_list("line").alias("lines"))
    texts = with_text(docs).alias("t").join(named.alias("p"), F.col("t.doc_id").eqNullSafe(F.col("p.doc_id")))
    # Of rows that repeat a doc_id, one may have fewer lines than a place names.
    split = texts.select("t.doc_id", "lines", F.split("text", "\n").alias("words"))
    at = F.explode(F.filter("lines", lambda line: line < F.size("words"))).alias("line")
    chosen = split.select("doc_id", "words", at).select("doc_id", "line", F.get("words", F.col("line")).alias("words"))
    sets = written(chosen.select(F.struct("doc_id", "line").alias("place"), _words(F.col("words")).alias("set")), "line-sets")
    left = sets.select(F.col("place").alias("a"), F.col("set").alias("left"))
    right = sets.select(F.col("place").alias("b"), F.col("set").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    similar = (_OF + _SIMILAR) * both >= _SIMILAR * (F.size("left") + F.size("right"))
    found = written(pairs.join(left, "a").join(right, "b").where(similar).select("b.*").distinct(), "matched")
    removed(sets)
    return found


def _firsts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first line of each set of words, with n, parities and keys, and the places of all other lines that have words."""
    n, ordered = F.size("set"), F.col("set")
    # Of a long line, the words with a certain bit are in groups of their own.
    upper = F.filter(ordered, lambda w: w.bitwiseAND(F.lit(64).cast("long")) != 0)
    high = F.when(n > LONG_LINE, _parity(upper)).otherwise(F.lit(0).cast("long"))
    sets = _lines(docs).select("doc_id", "line", _ordered(F.col("words")).alias("set"))
    lines = written(
        sets.select(
            "doc_id", "line", F.xxhash64("set", n).alias("same"), F.hash("set").alias("check"),
            n.alias("n"), _parity(ordered).alias("every"), high.alias("high"), _keys(ordered, n).alias("keys"),
        ).withColumn("low", F.col("every").bitwiseXOR(F.col("high"))).drop("every"),
        "lines",
    )
    worded = lines.where("n > 0")
    # Lines of one set have the same numbers and keys, so that these come along with the first place.
    first = F.min(F.struct("doc_id", "line", "low", "high", "keys")).alias("first")
    firsts = written(worded.groupBy("same", "check", "n").agg(first).select("same", "check", "n", "first.*"), "first-lines")
    at = _same_place("l", "f") & (F.col("l.same") == F.col("f.same")) & (F.col("l.check") == F.col("f.check"))
    copies = written(worded.alias("l").join(firsts.alias("f"), at, "left_anti").select("doc_id", "line"), "copied-lines")
    removed(lines)
    return firsts.drop("same", "check"), copies


def _shared_keys(posted: DataFrame) -> DataFrame:
    """Of postings: the lines that others have a key in common with, and the earlier ones among these that pass the filters.

    Under a frequent key only the earliest line is looked at, and every line is named.
    """
    by_place = Window.partitionBy("key").orderBy("doc_id", "line")
    group = by_place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    line = F.struct("doc_id", "line", "n", "every")
    # Most postings are alone under their key; they are sorted by it only, which takes less than an order of places.
    held = posted.select("*", F.count(F.lit(1)).over(Window.partitionBy("key")).alias("held"))
    frequent = F.col("held") > HOT_LINES
    few = held.where("held > 1").select(
        "*", line.alias("own"), F.row_number().over(by_place).alias("at"), F.first(line).over(group).alias("first"),
        F.collect_list(F.when(~frequent, line)).over(group).alias("lines"),
    )
    earlier = F.when(~frequent, F.slice("lines", F.lit(1), F.col("at") - 1)).when(F.col("at") > 1, F.array("first"))
    near = F.filter(F.coalesce(earlier, F.array().cast(few.schema["lines"].dataType)), lambda a: _near(a, F.col("own")))
    found = few.select("key", "doc_id", "line", frequent.alias("frequent"), near.alias("near"))
    return found.where(F.col("frequent") | (F.size("near") > 0))


def _meetings(frequent: DataFrame, matched: DataFrame, signs: DataFrame) -> DataFrame:
    """Candidates (a, b) with two frequent keys in common, of lines b that are not matched yet."""
    unmatched = frequent.alias("p").join(matched.alias("f"), _same_place("p", "f"), "left_anti")
    live = frequent.join(unmatched.select("key").distinct(), "key", "left_semi")
    lines = live.groupBy("doc_id", "line").agg(F.sort_array(F.collect_set("key")).alias("keys")).where(F.size("keys") > 1)
    lines = lines.alias("p").join(signs.alias("s"), _same_place("p", "s")).select("s.*", "keys")
    lines = lines.select("*", F.explode("keys").alias("one"))
    others = F.filter("keys", lambda key: key > F.col("one"))
    lines = lines.select(*signs.columns, "keys", "one", F.explode(others).alias("two"))
    later = lines.alias("p").join(matched.alias("f"), _same_place("p", "f"), "left_anti")
    both = (F.col("a.one") == F.col("b.one")) & (F.col("a.two") == F.col("b.two"))
    # Of all keys in common the first two make a pair, so that it is made once.
    once = F.slice(F.array_intersect("a.keys", "b.keys"), 1, 2) == F.array("a.one", "a.two")
    return _places(lines.alias("a").join(later.alias("b"), both & _candidate("a", "b") & once))


def matched_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line) of every line with a Jaccard similarity of 4/5 or more to an earlier one.

    Lines are numbered from 0 in each text and ordered by (doc_id, line), a null doc_id first; an earlier line
    counts whether or not it is removed itself.  Lines without words match nothing.  Rows that repeat a doc_id
    share their places: such a line goes where it goes in one of them.
    """
    lines, copies = _firsts(docs)
    every = F.col("low").bitwiseXOR(F.col("high")).alias("every")
    posted = lines.select("doc_id", "line", "n", every, F.explode("keys").alias("key"))
    turns = [F.pmod("key", F.lit(_ROUNDS)) == turn for turn in range(_ROUNDS)]
    rounds = [written(_shared_keys(posted.where(turn)), "shared-keys") for turn in turns]
    shared = reduce(DataFrame.unionByName, rounds)
    signs = lines.where(F.col("n") >= _SIMILAR).select("doc_id", "line", "n", "low", "high", every)
    signs = written(signs, "line-signs")
    removed(lines)

    met = _places(shared.select(F.explode("near").alias("a"), F.struct("doc_id", "line").alias("b")))
    a = met.alias("p").join(signs.alias("s"), _same_place("p.a", "s")).select(F.struct("s.*").alias("a"), "b")
    first_pairs = a.alias("p").join(signs.alias("s"), _same_place("p.b", "s")).select("a", F.struct("s.*").alias("b"))
    matched = _verified(docs, written(_places(first_pairs.where(_candidate("a", "b"))), "line-pairs"))
    frequent = shared.where("frequent").select("key", "doc_id", "line")
    more = _verified(docs, written(_meetings(frequent, matched, signs), "line-pairs"))
    return copies.unionByName(matched).unionByName(more).distinct()


def line_report(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_lines, n_removed, removed_lines (numbers, joined by commas).

    A null text is one empty line; a null doc_id stays null; an empty table gives no row; columns other than
    ``doc_id`` and ``text`` are not read.
    """
    gone = matched_lines(docs).groupBy("doc_id").agg(F.sort_array(F.collect_list("line")).alias("gone"))
    ends = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    counted = with_text(docs).select("doc_id", (ends + 1).alias("n_lines"))
    joined = counted.alias("d").join(gone.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")), "left")
    lines = F.coalesce("gone", F.array().cast("array<int>"))
    return joined.select(
        "d.doc_id", "n_lines", F.size(lines).alias("n_removed"), F.array_join(lines, ",").alias("removed_lines")
    )


def drop_matched_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the matched lines cut out of their texts; rows, columns and null texts stay."""
    gone = matched_lines(docs).groupBy(F.col("doc_id").alias("_llm_doc")).agg(F.collect_set("line").alias("_llm_gone"))
    joined = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("_llm_doc")), "left")
    numbered = F.transform(F.split("text", "\n"), lambda line, i: F.struct(line.alias("line"), i.alias("i")))
    kept = F.filter(numbered, lambda x: ~F.array_contains(F.col("_llm_gone"), x["i"]))
    text = F.when(F.col("_llm_gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda x: x["line"]), "\n")
    )
    return joined.withColumn("text", text).select(*docs.columns)
