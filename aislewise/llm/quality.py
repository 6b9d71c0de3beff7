"""Document quality by hierarchical empirical Bayes.

A logistic regression on the shape of a text gives each document a probability of being good.  These are
summed up by host, and by path within a host, for all documents; a labelled document counts with its label.
The rates of hosts are shrunk towards the global rate, and those of paths towards their host's, as strongly as
the spread between them says (method of moments), so a site with few documents has its parent's rate.  The
path's rate, without the document itself, is the prior to which the document's own evidence is added.

Only (doc_id, probability, host, path) is shuffled.  The regression is fitted on about ``FITTED_ROWS`` of the
labelled documents; everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .language_id import _slices
from .work import written

FITTED_ROWS = 20_000
KEPT_FROM = 0.5
_DIGEST = "_llm_digest"
_OTHER, _LOWER, _UPPER, _LETTER, _DIGIT, _SPACE, _COMMON = range(7)
#: Punctuation of ordinary prose; all other characters that are no letter, digit or space are symbols.
_PROSE = ".,;:'\"?()-’“”«»¿¡"


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            table[code] = _LOWER if c.islower() else _UPPER if c.isupper() else _LETTER
        elif c.isnumeric():
            table[code] = _DIGIT
        elif c.isspace():
            table[code] = _SPACE
    table[[ord(c) for c in _PROSE]] = _COMMON
    return table


def features(texts: list[str]) -> np.ndarray:
    """One row a text: shares of kinds of characters, and how words and lines repeat."""
    n = np.array([len(t) for t in texts], np.int64)
    kinds = np.zeros((len(texts), 7))
    filled = np.flatnonzero(n)
    if len(filled):
        own = _kinds()[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
        first = (np.cumsum(n) - n)[filled]
        for kind in range(7):
            kinds[filled, kind] = np.add.reduceat(own == kind, first, dtype=np.int64)
    words = np.zeros((len(texts), 4))
    for i, text in enumerate(texts):
        found = text.split()
        if found:
            lines = text.split("\n")
            repeats = sum(map(str.__eq__, found, found[1:]))
            words[i] = len(found), len(set(found)), repeats, 1 - len(set(lines)) / len(lines)
    chars, n_words = np.maximum(n, 1), np.maximum(words[:, 0], 1)
    letters = np.maximum(kinds[:, [_LOWER, _UPPER, _LETTER]].sum(axis=1), 1)
    return np.stack(
        [
            np.log1p(words[:, 0]),
            kinds[:, _OTHER] / chars,
            np.log1p(100 * kinds[:, _OTHER] / n_words),
            kinds[:, _UPPER] / letters,
            kinds[:, _DIGIT] / chars,
            kinds[:, _COMMON] / chars,
            letters / chars,
            chars / n_words / 10,
            # A long text repeats common words: its distinct words are measured against the square root.
            np.log1p(words[:, 1]) - 0.5 * np.log1p(words[:, 0]),
            words[:, 2] / n_words,
            words[:, 3],
        ],
        axis=1,
    )


N_FEATURES = 11


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Classifier:
        """Newton's method; with one class only, the ridge leaves a constant."""
        mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = np.c_[np.ones(len(x)), (x - mean) / scale]
        w = np.zeros(z.shape[1])
        penalty = ridge * np.eye(z.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z.T * (p * (1 - p))) @ z + penalty, z.T @ (y - p) - ridge * w)
            # Newton's step, halved until it no longer overshoots.
            w = w + step / max(1.0, np.abs(step).max() / 3)
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.scale]
        return 1 / (1 + np.exp(-np.clip(z @ self.weights, -12, 12)))


def _fitted(docs: DataFrame, labels: DataFrame) -> Classifier | None:
    share = min(1.0, FITTED_ROWS / max(1, labels.count()))
    drawn = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(some) for some in _slices(t.as_py() or "" for t in batch.column("text"))]
            if found:
                x = pa.array(list(np.concatenate(found)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([x, batch.column("good")], ["x", "good"])

    # About FITTED_ROWS rows of two numbers: small whatever the number of labels.
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "good")
    table = rows.mapInArrow(shapes, "x array<double>, good double").toArrow()
    if not table.num_rows:
        return None
    x = table["x"].combine_chunks().flatten().to_numpy().reshape(-1, N_FEATURES)
    return Classifier.fit(x, table["good"].to_numpy())


def _strength(groups: DataFrame, total: str, good: str, parent: Column) -> float:
    """How many documents a parent's rate is worth, from the spread of the groups' rates around it."""
    rate = F.col(good) / F.col(total)
    row = groups.where(F.col(total) > 1).agg(
        F.sum(F.col(total) * (rate - parent) ** 2).alias("spread"),
        F.sum(parent * (1 - parent)).alias("chance"),
        F.sum(F.col(total) * parent * (1 - parent)).alias("whole"),
    ).first()
    if row["spread"] is None or not row["whole"]:
        return 1e6
    # spread = chance + (whole - chance) / (strength + 1) in expectation.
    between = (row["spread"] - row["chance"]) / max(row["whole"] - row["chance"], 1e-9)
    return 1e6 if between <= 1e-6 else max(1.0, 1 / between - 1)


def score_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, kept_from: float = KEPT_FROM) -> DataFrame:
    """One row for each row of ``docs``: doc_id, doc_prob, host_posterior, path_posterior, quality, kept.

    ``labels`` is (doc_id, quality 0 or 1); rows with a null are left out, repeated ones averaged.  A null text
    counts as empty, a null host or path as a site of its own.  A null doc_id is no label's.  Without labels
    doc_prob is 0.5 throughout and all rows are kept.  Rows that repeat are scored each on its own; an empty
    table gives no row; columns other than those named are not read.
    """
    return _scores(_base(docs, host, path), labels, kept_from)


def _base(docs: DataFrame, host: Column, path: Column, *more: str) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text"),
        F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"),
        *more,
    )


def _scores(base: DataFrame, labels: DataFrame, kept_from: float, *more: str) -> DataFrame:
    """``score_quality``, with the binary columns of ``base`` that ``more`` names passed on."""
    labels = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.avg("quality").cast("double").alias("good"))
    )
    classifier = _fitted(base, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.empty(0)]
            for some in _slices(t.as_py() or "" for t in batch.column("text")):
                found.append(classifier.probabilities(features(some)) if classifier else np.full(len(some), 0.5))
            columns = [batch.column("doc_id"), pa.array(np.concatenate(found))]
            columns += [batch.column(c) for c in ("host", "path", *more)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "p", "host", "path", *more])

    schema = ", ".join(["doc_id long, p double, host string, path string", *(f"{c} binary" for c in more)])
    scored = base.mapInArrow(score, schema)
    evidence = written(
        scored.join(labels, "doc_id", "left").withColumn("e", F.coalesce("good", "p")).drop("good"), "evidence"
    )

    paths = written(
        evidence.groupBy("host", "path").agg(F.count("*").alias("n_path"), F.sum("e").alias("s_path")), "paths"
    )
    whole = paths.agg(F.sum("n_path").alias("n"), F.sum("s_path").alias("s")).first()
    if not whole["n"]:
        rate = 0.5
    else:
        rate = min(max(whole["s"] / whole["n"], 1e-3), 1 - 1e-3)
    hosts = paths.groupBy("host").agg(F.sum("n_path").alias("n_host"), F.sum("s_path").alias("s_host"))
    host_strength = _strength(hosts, "n_host", "s_host", F.lit(rate))
    host_rate = (F.col("s_host") + host_strength * rate) / (F.col("n_host") + host_strength)
    nested = paths.join(hosts, "host").withColumn("host_posterior", host_rate)
    path_strength = _strength(nested, "n_path", "s_path", F.col("host_posterior"))

    # Each document's prior leaves the document itself out.
    own_host = (F.col("s_host") - F.col("e") + host_strength * rate) / (F.col("n_host") - 1 + host_strength)
    own_path = (F.col("s_path") - F.col("e") + path_strength * F.col("host_posterior")) / (
        F.col("n_path") - 1 + path_strength
    )

    def odds(p: Column) -> Column:
        safe = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.log(safe / (1 - safe))

    together = odds(F.col("doc_prob")) - odds(F.lit(rate)) + odds(F.col("path_posterior"))
    kept = F.lit(True) if classifier is None else F.col("quality") >= kept_from
    return (
        evidence.join(nested.drop("host_posterior"), ["host", "path"])
        .withColumn("host_posterior", own_host)
        .withColumn("path_posterior", own_path)
        .withColumnRenamed("p", "doc_prob")
        .withColumn("quality", 1 / (1 + F.exp(-together)))
        .withColumn("kept", kept)
        .select("doc_id", "doc_prob", "host_posterior", "path_posterior", "quality", "kept", *more)
    )


def _row_digest(host: Column, path: Column) -> Column:
    """Of all that a row's score depends on but the doc_id; null counts as empty, as in the score."""
    text, host, path = (F.coalesce(c.cast("string"), F.lit("")) for c in (F.col("text"), host, path))
    return F.unhex(F.md5(F.concat(F.md5(text), F.md5(host), path)))


def drop_poor(docs: DataFrame, labels: DataFrame, host: Column, path: Column, kept_from: float = KEPT_FROM) -> DataFrame:
    """``docs`` without the rows whose quality is below ``kept_from``; all columns stay as they are.

    Rows that repeat a doc_id, or have a null one, stay or go each on its own.
    """
    base = _base(docs.withColumn(_DIGEST, _row_digest(host, path)), host, path, _DIGEST)
    poor = _scores(base, labels, kept_from, _DIGEST).where("NOT kept")
    poor = poor.select(F.col("doc_id").alias("_llm_poor"), F.col(_DIGEST).alias("_llm_poor_row")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_llm_poor")) & (_row_digest(host, path) == F.col("_llm_poor_row"))
    return docs.join(poor, same, "left_anti")
