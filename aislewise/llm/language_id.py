"""Language identification by interpolated Kneser-Ney models over characters, one for each language.

Text is folded to 64 symbols: one for any run of non-letters, 26 for a-z, and the other letters hashed to the
rest.  A model counts ``ORDER``-symbol sequences, so whatever the corpus it has at most 64 ** ORDER entries
(262,144 for three symbols, 2 MB): that is the bound of what reaches the driver and is sent to the tasks.
Counting is a grouped aggregation over all training rows, summed up in each task first.

A model is a sorted array of hashed sequences for each order beside their log probabilities, and one of
contexts beside their back-off weights.  A batch looks up its distinct sequences by binary search.

The language is that of the lowest cross-entropy a symbol.  Its score is the chance of being right as a
function of the lead over the second best, fitted on a sample of about ``CALIBRATION_ROWS`` training rows.
The rejection comes from all training rows: a text whose cross-entropy is further above its language's mean
than those of all but ``REJECTED_SHARE`` of that language's texts, with ``SLACK``, is in none of the languages.
A few sums and a histogram of fixed width for each language reach the driver.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .work import kept_by_worker, removed, written

BITS = 6
SYMBOLS = 1 << BITS
ORDER = 3
CALIBRATION_ROWS = 20_000
REJECTED_SHARE = 0.001
SLACK = 1.5
#: Rows from which a language's own texts tell its limit.
LIMIT_ROWS = 1_000
#: Bins of a bit of excess.
EXCESS_BINS = 256
UNDETERMINED = "und"
#: Characters of text that are scored at a time; they take some hundred bytes each.
SLICE_CHARS = 250_000
#: Texts longer than this are no more certain than those of this many symbols.
_STEADY_SYMBOLS = 400


def _symbols() -> np.ndarray:
    """The symbol of each code point; 0 for all but letters."""
    return kept_by_worker("symbols", _symbol_table)


def _symbol_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        letter = chr(code)
        if letter.isalpha():
            folded = letter.lower()[0]
            table[code] = ord(folded) - 96 if "a" <= folded <= "z" else 27 + ord(folded) % (SYMBOLS - 27)
    return table


def sequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed ``ORDER``-symbol sequence that ends at each symbol, and the number of symbols of each text.

    A text begins with its first letter, after as many non-letters as a context needs.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    symbols = _symbols()[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
    owner = np.repeat(np.arange(len(texts)), sizes)
    before = np.r_[np.uint8(0), symbols[:-1]]
    before[np.r_[True, owner[1:] != owner[:-1]]] = 0
    keep = (symbols != 0) | (before != 0)
    symbols, owner = symbols[keep].astype(np.int64), owner[keep]
    counts = np.bincount(owner, minlength=len(texts))
    within = np.arange(len(symbols)) - np.repeat(np.cumsum(counts) - counts, counts)
    codes = symbols.copy()
    for back in range(1, ORDER):
        earlier = np.r_[np.zeros(back, np.int64), symbols[:-back]][: len(symbols)]
        codes |= np.where(within >= back, earlier, 0) << (BITS * back)
    return codes, counts


@dataclass
class KneserNey:
    """log2 probabilities by sorted hashed sequence, for each order from 1 up."""

    codes: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    backoffs: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def of(cls, codes: np.ndarray, counts: np.ndarray) -> KneserNey:
        """From the counts of the highest order; below it, a sequence counts once for each symbol before it."""
        by_order = {ORDER: (codes, counts.astype(np.float64))}
        for order in range(ORDER - 1, 0, -1):
            above = by_order[order + 1][0]
            own, types = np.unique(above & ((1 << (BITS * order)) - 1), return_counts=True)
            by_order[order] = own, types.astype(np.float64)
        model = cls()
        for order in range(1, ORDER + 1):
            own, n = by_order[order]
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.75
            contexts, place = np.unique(own >> BITS, return_inverse=True)
            total = np.bincount(place, n)
            backoff = discount * np.bincount(place) / total
            lower = 2.0 ** model.log_probabilities(own & ((1 << (BITS * (order - 1))) - 1), order - 1)
            p = np.maximum(n - discount, 0) / total[place] + backoff[place] * lower
            model.codes.append(own)
            model.logs.append(np.log2(p))
            model.contexts.append(contexts)
            model.backoffs.append(np.log2(backoff))
        return model

    def log_probabilities(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """log2 of the interpolated probability of each sequence's last symbol after the others."""
        if order == 0:
            return np.full(len(codes), -float(BITS))
        known = self.codes[order - 1]
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        out = self.logs[order - 1][at]
        missing = np.flatnonzero(known[at] != codes)
        if len(missing):
            new = codes[missing]
            contexts = self.contexts[order - 1]
            place = np.minimum(np.searchsorted(contexts, new >> BITS), len(contexts) - 1)
            weight = np.where(contexts[place] == new >> BITS, self.backoffs[order - 1][place], 0.0)
            out[missing] = weight + self.log_probabilities(new & ((1 << (BITS * (order - 1))) - 1), order - 1)
        return out


def _slices(texts: Iterator[str]) -> Iterator[list[str]]:
    held: list[str] = []
    chars = 0
    for text in texts:
        held.append(text)
        chars += len(text)
        if chars >= SLICE_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def sequence_counts(training: DataFrame) -> DataFrame:
    """(lang, code, n) over all rows of ``training(text, lang)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs):
                own = sums.setdefault(lang, np.zeros(1 << (BITS * ORDER), np.int64))
                texts = batch.column("text").filter(pa.array(langs == lang))
                for some in _slices(t.as_py() for t in texts):
                    own += np.bincount(sequences(some)[0], minlength=len(own))
        for lang, own in sums.items():
            codes = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(own[codes])], ["lang", "code", "n"]
            )

    counted = training.select("text", "lang").mapInArrow(count, "lang string, code long, n long")
    return counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))


@dataclass
class Identifier:
    """The models and what they were calibrated to."""

    models: dict[str, KneserNey]
    # log-odds of being right: constant, and weight of log(1 + lead in bits).
    certainty: tuple[float, float] = (0.0, 1.0)
    # For each language, the mean cross-entropy and how far above it a text may be, in standard units.
    limits: dict[str, tuple[float, float]] = field(default_factory=dict)

    def scored(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text its symbols, the place of the best language, its cross-entropy and its lead in bits."""
        codes, counts = sequences(texts)
        filled = np.flatnonzero(counts)
        best = np.zeros(len(texts), np.int64)
        entropy = np.zeros(len(texts))
        lead = np.zeros(len(texts))
        if len(filled):
            present = np.flatnonzero(np.bincount(codes, minlength=1 << (BITS * ORDER)))
            first = (np.cumsum(counts) - counts)[filled]
            sums = []
            for model in self.models.values():
                logs = np.zeros(1 << (BITS * ORDER), np.float32)
                logs[present] = model.log_probabilities(present)
                sums.append(-np.add.reduceat(logs[codes], first, dtype=np.float64))
            bits = np.stack(sums)
            order = np.sort(bits, axis=0)
            best[filled] = bits.argmin(axis=0)
            entropy[filled] = order[0] / counts[filled]
            lead[filled] = (order[1] - order[0]) if len(order) > 1 else np.inf
        return counts, best, entropy, lead

    def score(self, lead: np.ndarray) -> np.ndarray:
        constant, weight = self.certainty
        return 1 / (1 + np.exp(-np.clip(constant + weight * np.log1p(np.minimum(lead, 1e9)), -30, 30)))

    def excess(self, names: np.ndarray, entropy: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Cross-entropy above the language's mean; short texts vary more and count less."""
        means = np.array([self.limits.get(name, (0.0, np.inf))[0] for name in names])
        return (entropy - means) * np.sqrt(np.minimum(counts, _STEADY_SYMBOLS) / _STEADY_SYMBOLS)


def _calibrated(models: dict[str, KneserNey], training: DataFrame, drawn: Column) -> Identifier:
    identifier = Identifier(models)
    names = np.array(list(models), object)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, picked = iter(batch.column("lang").to_pylist()), iter(batch.column("drawn").to_pylist())
            for some in _slices(t.as_py() for t in batch.column("text")):
                counts, best, entropy, lead = identifier.scored(some)
                right = [names[b] == next(langs) for b in best]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names[best], pa.string()), pa.array(counts), pa.array(entropy), pa.array(lead),
                        pa.array(right), pa.array([next(picked) for _ in some], pa.bool_()),
                    ],
                    ["lang", "symbols", "entropy", "lead", "right", "drawn"],
                )

    schema = "lang string, symbols long, entropy double, lead double, right boolean, drawn boolean"
    every = training.select("text", "lang", drawn.alias("drawn")).mapInArrow(score, schema).where("symbols > 0")
    every = written(every, "language-scores")
    rows = every.where("drawn").select("lead", "right").toPandas()
    if len(rows):
        identifier.certainty = _certainty(rows["lead"].to_numpy(), rows["right"].to_numpy(float))
    identifier.limits = _limits(every.where("right").select("lang", "symbols", "entropy"))
    removed(every)
    return identifier


def _certainty(lead: np.ndarray, right: np.ndarray) -> tuple[float, float]:
    """Logistic regression with one feature; the ridge keeps it finite where every answer is right."""
    x = np.stack([np.ones(len(lead)), np.log1p(np.minimum(lead, 1e9))], axis=1)
    w = np.array([0.0, 1.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.eye(2), x.T @ (right - p) - (w - [0.0, 1.0]))
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(max(w[1], 0.0))


def _limits(right: DataFrame) -> dict[str, tuple[float, float]]:
    """Each language's mean and limit, from all rows of ``right(lang, symbols, entropy)``.

    A language of fewer than ``LIMIT_ROWS`` rows has the limit of all languages' rows around their own means if
    that is wider, and wider still as its own mean is uncertain.
    """
    steady = F.least("symbols", F.lit(_STEADY_SYMBOLS)) / _STEADY_SYMBOLS
    means = right.groupBy("lang").agg(
        (F.sum(F.col("entropy") * F.col("symbols")) / F.sum("symbols")).alias("mean"),
        F.count("*").alias("n"),
        F.sum(steady).alias("weight"),
    ).collect()
    if not means:
        return {}
    table = right.sparkSession.createDataFrame([(r["lang"], r["mean"]) for r in means], "lang string, mean double")
    above = (F.col("entropy") - F.col("mean")) * F.sqrt(steady)
    binned = right.join(F.broadcast(table), "lang").groupBy("lang", F.floor(above * EXCESS_BINS).alias("bin")).count()
    histograms: dict[str, Counter] = defaultdict(Counter)
    for lang, at, n in binned.collect():
        histograms[lang][at] += n

    def widest(histogram: Counter) -> float:
        """The upper end of the bin that the quantile falls in."""
        allowed = REJECTED_SHARE * sum(histogram.values())
        beyond = 0
        for at in sorted(histogram, reverse=True):
            beyond += histogram[at]
            if beyond > allowed:
                return SLACK * (at + 1) / EXCESS_BINS

    pooled = widest(sum(histograms.values(), Counter()))
    limits = {}
    for lang, mean, n, weight in means:
        limit = widest(histograms[lang])
        if n < LIMIT_ROWS:
            limit = max(limit, pooled * (1 + 1 / weight) ** 0.5)
        limits[lang] = mean, limit
    return limits


def fit(training: DataFrame) -> Identifier:
    """Models of all languages in ``training(doc_id, text, lang)``; rows with a null in any of them are left out."""
    training = training.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
    counted = sequence_counts(training).toPandas()
    models = {}
    for lang, own in sorted(counted.groupby("lang"), key=lambda g: g[0]):
        own = own.sort_values("code")
        models[lang] = KneserNey.of(own["code"].to_numpy(), own["n"].to_numpy())
    if not models:
        return Identifier({})
    rows = training.count()
    share = min(1.0, CALIBRATION_ROWS / rows)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))
    return _calibrated(models, training, drawn)


def identify(docs: DataFrame, identifier: Identifier) -> DataFrame:
    """``docs`` with four more columns: lang_pred, score, cross_entropy and rejected.

    A text that is null or has no letter is ``und`` with score 0, and is rejected.  Without any model every text is
    ``und`` with score 0, and none is rejected, as nothing is known of any language.
    """
    names = np.array([*identifier.models, UNDETERMINED], object)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for some in _slices(t.as_py() or "" for t in batch.column("text")):
                if len(names) == 1:
                    parts.append((names[np.zeros(len(some), int)], np.zeros(len(some)), np.zeros(len(some)), np.zeros(len(some), bool)))
                    continue
                counts, best, entropy, lead = identifier.scored(some)
                found = np.where(counts > 0, names[best], UNDETERMINED)
                limits = np.array([identifier.limits.get(n, (0.0, np.inf))[1] for n in found])
                rejected = (counts == 0) | (identifier.excess(found, entropy, counts) > limits)
                parts.append((found, np.where(counts > 0, identifier.score(lead), 0.0), entropy, rejected))
            if not parts:
                continue
            found, scores, entropy, rejected = (np.concatenate(c) for c in zip(*parts, strict=True))
            for name, values in (
                ("lang_pred", pa.array(found, pa.string())),
                ("score", pa.array(scores)),
                ("cross_entropy", pa.array(entropy)),
                ("rejected", pa.array(rejected)),
            ):
                batch = batch.append_column(name, values)
            yield batch

    added = "lang_pred string, score double, cross_entropy double, rejected boolean"
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(added).fields])
    return docs.mapInArrow(score, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the crc32 of a doc_id's text leaves the remainder 1 when divided by 3; false for a null one."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def predict_languages(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score, cross_entropy, rejected.

    Models learn from text and lang of the rows that are not held out; predictions see the text alone.  A null
    lang or doc_id is not learned from; rows that repeat count each; an empty table gives no row; columns other
    than ``doc_id``, ``text`` and ``lang`` are not read.
    """
    identifier = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    found = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), identifier)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def drop_rejected(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that no language's model accepts; models learn from all rows with a lang."""
    identifier = fit(docs.select("doc_id", "text", "lang"))
    renamed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).withColumn("text", F.col(f"c{docs.columns.index('text')}"))
    kept = identify(renamed, identifier).where("NOT rejected")
    return kept.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)])
