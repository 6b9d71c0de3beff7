"""Toxic documents, by a bidirectional gated recurrent network over all overlapping windows of a text.

A word enters the network by itself (an embedding, and how often it is in toxic documents) and by its
characters (embeddings of its short character sequences, and how often the most and the average telling of
them are in toxic documents), so inflected and new words of a toxic stem are known.  Windows of ``WINDOW``
words begin every ``STRIDE`` words; the highest logit of a document's windows, with their number, is calibrated
to a probability on documents that the network was not trained on.

The network is fitted on the driver, on at most about ``TOXIC_ROWS`` toxic and ``CLEAN_ROWS`` clean labelled
documents of up to ``FITTED_BYTES`` bytes each, drawn by a hash of the doc_id; a toxic document is learnt by
the window that the network finds worst so far.  Rates of words in a training document come from documents of
other folds.  Every window of every document is scored; words are the terms of ``lexical_search``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gated_network import Adam, backward, forward, new_parameters, projected
from .lexical_search import terms_in_slices
from .quality import Classifier

WINDOW, STRIDE = 24, 12
TOXIC_ROWS, CLEAN_ROWS, FITTED_BYTES = 1500, 3000, 8_000
PREDICTED_FROM = 0.7
#: Training: documents a step, passes over them, steps at least, and the step size.
BATCH, EPOCHS, STEPS, RATE = 128, 5, 200, 0.01
#: Words whose windows are scored together, and windows that go through the network together.
WORDS_TOGETHER = 200_000
WINDOWS_TOGETHER = 4096

#: Distinct words that are hashed together.
HASHED_TOGETHER = 20_000

#: Lengths of character sequences, in bytes of UTF-8; buckets of their rates, of word rates, and of embeddings.
_SEQUENCES = (3, 4, 5, 6)
_RATE_BUCKETS = 1 << 18
_EMBEDDINGS, _EMBEDDED = 1 << 12, 6
_FOLDS = 4
#: Documents that a rate's prior is worth.
_PRIOR_ROWS = 4.0
_INPUTS = 4 + 2 * _EMBEDDED


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(29))


class Words:
    """Buckets of some words, and of all their character sequences, as numbers of 32 bits."""

    def __init__(self, words: list[bytes]) -> None:
        parts = [_hashed(words[at : at + HASHED_TOGETHER]) for at in range(0, len(words), HASHED_TOGETHER)]
        self.count = len(words)

        def column(k: int) -> np.ndarray:
            return np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int32)

        #: Of each word: its rate, behind those of sequences, and its embedding.
        self.rate_bucket, self.embedding_bucket = column(0) + _RATE_BUCKETS, column(1)
        #: The rates of all its sequences and the embeddings of the shortest, from ``first[i]`` to ``first[i + 1]``.
        self.sequences, self.first = column(2), np.append(0, np.cumsum(column(3)))
        self.short, self.short_first = column(4), np.append(0, np.cumsum(column(5)))


def _hashed(words: list[bytes]) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(b"\x02%b\x03" % w for w in words), np.uint8).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    begins = np.cumsum(lengths) - lengths
    of_byte = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    place = np.arange(len(data)) - begins[of_byte]
    left = lengths[of_byte] - place
    rates, embeddings = np.uint64(_RATE_BUCKETS), np.uint64(_EMBEDDINGS)

    def buckets(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (hashes % rates).astype(np.int32), ((hashes >> np.uint64(40)) % embeddings).astype(np.int32)

    sums = np.zeros(len(data), np.uint64)
    found, owners, short, short_owner = [], [], np.empty(0, np.int32), np.empty(0, np.int32)
    with np.errstate(over="ignore"):
        for n in range(1, min(max(_SEQUENCES), len(data)) + 1):
            # The sequence of n bytes from each place, of the places that have as many left in their word.
            reach = len(data) - n + 1
            sums = sums[:reach] * np.uint64(0x100000001B3) + data[n - 1 :]
            if n in _SEQUENCES:
                fits = left[:reach] >= n
                rate, embedding = buckets(_mixed(sums[fits] + np.uint64(n)))
                found.append(rate)
                owners.append(of_byte[:reach][fits])
                if n == _SEQUENCES[0]:
                    short, short_owner = embedding, owners[-1]
        powers = np.cumprod(np.full(lengths.max(), 0x9E3779B97F4A7C15, np.uint64))
        of_word = buckets(_mixed(np.add.reduceat(data * powers[place], begins)))
    # Every word has a sequence: with its marks even a word of one byte has three.
    owner = np.concatenate(owners)
    sequences = np.concatenate(found)[np.argsort(owner, kind="stable")]
    counts, short_counts = (np.bincount(own, minlength=len(words)) for own in (owner, short_owner))
    return *of_word, sequences, counts, short, short_counts


def inputs_of(words: Words, rates: np.ndarray, embeddings: dict[str, np.ndarray]) -> np.ndarray:
    """One input vector a word; the last row is the blank word."""
    word_rate, sequence_rate = rates[words.rate_bucket], rates[words.sequences]
    out = np.zeros((words.count + 1, _INPUTS), np.float32)
    if words.count:
        first, short_first = words.first[:-1], words.short_first[:-1]
        out[:-1, 0] = word_rate
        out[:-1, 1] = np.maximum.reduceat(sequence_rate, first)
        out[:-1, 2] = np.add.reduceat(sequence_rate, first) / np.diff(words.first)
        out[:-1, 3] = 1
        out[:-1, 4 : 4 + _EMBEDDED] = embeddings["word"][words.embedding_bucket]
        sums = np.add.reduceat(embeddings["sequence"][words.short], short_first, axis=0)
        out[:-1, 4 + _EMBEDDED :] = sums / np.diff(words.short_first)[:, None]
    return out


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and document of each window, for documents of so many words one after the other.

    Windows begin every ``STRIDE`` words until one reaches the end; a document without words has one too.
    """
    per_document = 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE))
    document = np.repeat(np.arange(len(counts)), per_document)
    number = np.arange(len(document)) - (np.cumsum(per_document) - per_document)[document]
    return (np.cumsum(counts) - counts)[document] + STRIDE * number, document


def window_words(ids: np.ndarray, counts: np.ndarray, starts: np.ndarray, document: np.ndarray, blank: int):
    """Word numbers and mask of windows; the blank word of a document without words is not masked."""
    places = starts[:, None] + np.arange(WINDOW)
    mask = places < np.cumsum(counts)[document][:, None]
    words = np.append(ids, blank)[np.minimum(places, len(ids))]
    words[~mask] = blank
    mask[:, 0] = True
    return words, mask.astype(np.float32)


@dataclass
class Network:
    parameters: dict[str, np.ndarray]
    embeddings: dict[str, np.ndarray]
    rates: np.ndarray
    calibration: Classifier | None = None
    #: What the sample's share of toxic documents has to be corrected by, as log odds.
    offset: float = 0.0

    def worst(self, texts: Iterable[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The highest logit of each text's windows, and their number; texts come as lists of words."""
        logits, numbers = [np.empty(0)], [np.empty(0, np.int64)]
        waiting: list[list[bytes]] = []
        for text in [*texts, None]:
            if text is not None:
                waiting.append(text)
            if waiting and (text is None or sum(map(len, waiting)) >= WORDS_TOGETHER):
                found = self._worst(waiting)
                logits.append(found[0])
                numbers.append(found[1])
                waiting = []
        return np.concatenate(logits), np.concatenate(numbers)

    def _worst(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        number_of: dict[bytes, int] = {}
        ids = np.array([number_of.setdefault(w, len(number_of)) for text in texts for w in text], np.int64)
        counts = np.array([len(t) for t in texts], np.int64)
        gates = projected(self.parameters, inputs_of(Words(list(number_of)), self.rates, self.embeddings))
        starts, document = windows_of(counts)
        logits = np.empty(len(starts), np.float32)
        for at in range(0, len(starts), WINDOWS_TOGETHER):
            some = slice(at, at + WINDOWS_TOGETHER)
            words, mask = window_words(ids, counts, starts[some], document[some], len(number_of))
            logits[some] = forward(self.parameters, gates, words, mask)[0]
        first = np.searchsorted(document, np.arange(len(texts)))
        return np.maximum.reduceat(logits, first), np.bincount(document, minlength=len(texts))

    def probabilities(self, logits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        p = np.clip(self.calibration.probabilities(np.stack([logits, np.log(numbers)], axis=1)), 1e-9, 1 - 1e-9)
        return 1 / (1 + np.exp(-(np.log(p / (1 - p)) + self.offset)))

    def scores(self, texts: Iterable[list[bytes]]) -> np.ndarray:
        logits, numbers = self.worst(texts)
        return self.probabilities(logits, numbers) if len(logits) else logits


def _rates(keys: list[np.ndarray], toxic: np.ndarray, left_out: np.ndarray) -> np.ndarray:
    """Log odds of a toxic document with a word or sequence, less those of any, of documents not left out."""
    held = np.zeros((2, 2 * _RATE_BUCKETS))
    for own, label, out in zip(keys, toxic, left_out, strict=True):
        if not out:
            held[int(label)][own] += 1
    share = np.clip(toxic[~left_out].mean() if (~left_out).any() else 0.5, 1e-3, 1 - 1e-3)
    rate = (held[1] + _PRIOR_ROWS * share) / (held.sum(axis=0) + _PRIOR_ROWS)
    return (np.log(rate / (1 - rate)) - np.log(share / (1 - share))).astype(np.float32) / 2


def train(texts: list[list[bytes]], toxic: np.ndarray, folds: np.ndarray, seed: int = 5) -> Network:
    """A network from texts as lists of words; documents of fold 0 only calibrate it."""
    rng = np.random.default_rng(seed)
    number_of: dict[bytes, int] = {}
    ids = [np.array([number_of.setdefault(w, len(number_of)) for w in text], np.int64) for text in texts]
    words = Words(list(number_of))

    def keys(own: np.ndarray) -> np.ndarray:
        own = np.unique(own)
        return np.unique(np.concatenate([words.rate_bucket[own], words.sequences[_ranges(words.first, own)]]))

    held = [keys(own) for own in ids]
    by_fold = {fold: _rates(held, toxic, folds == fold) for fold in range(_FOLDS)}
    embeddings = {
        name: (0.1 * rng.standard_normal((_EMBEDDINGS, _EMBEDDED))).astype(np.float32) for name in ("word", "sequence")
    }
    network = Network(new_parameters(_INPUTS, rng), embeddings, _rates(held, toxic, np.zeros(len(toxic), bool)))
    _learn(network, words, ids, toxic, folds, by_fold, rng)

    calibrating = np.flatnonzero(folds == 0)
    if len(np.unique(toxic[calibrating])) < 2:
        calibrating = np.arange(len(toxic))
    unseen = Network(network.parameters, embeddings, by_fold[0])
    logits, numbers = unseen.worst([texts[i] for i in calibrating])
    network.calibration = Classifier.fit(np.stack([logits, np.log(numbers)], axis=1), toxic[calibrating])
    return network


def _ranges(first: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The places from first[c] up to first[c + 1], for each of the chosen one after the other."""
    lengths = first[chosen + 1] - first[chosen]
    return np.arange(lengths.sum()) + np.repeat(first[chosen] - (np.cumsum(lengths) - lengths), lengths)


def _summed(keys: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of values summed by key, 0 to n - 1."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(keys):
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        out[keys[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def _learn(network: Network, words: Words, ids, toxic, folds, by_fold, rng) -> None:
    """Adam over the windows of most evidence, and one at random, of each document."""
    parts = []
    base = np.stack([inputs_of(words, by_fold[fold], network.embeddings) for fold in range(_FOLDS)])
    for i in np.flatnonzero(folds != 0) if (folds != 0).any() else range(len(ids)):
        counts = np.array([len(ids[i])])
        starts, document = windows_of(counts)
        own, mask = window_words(ids[i], counts, starts, document, words.count)
        evidence = (base[folds[i], own, :2].max(axis=2) * mask).max(axis=1)
        chosen = np.unique(np.append(np.argsort(-evidence, kind="stable")[:2], rng.integers(len(starts))))
        parts.append((folds[i], i, own[chosen], mask[chosen]))
    by_word, by_sequence = words.embedding_bucket, words.short
    embedded = slice(4, 4 + _EMBEDDED), slice(4 + _EMBEDDED, None)
    steps = Adam(network.parameters | {f"embedding_{k}": v for k, v in network.embeddings.items()}, RATE)
    share = np.clip(toxic.mean(), 0.05, 0.95)
    for _ in range(max(EPOCHS, STEPS * BATCH // len(parts))):
        order = rng.permutation(len(parts))
        for at in range(0, len(order), BATCH):
            batch = [parts[j] for j in order[at : at + BATCH]]
            windows, mask = (np.concatenate([p[k] for p in batch]) for k in (2, 3))
            sizes = [len(p[2]) for p in batch]
            document = np.repeat(np.arange(len(batch)), sizes)
            label = toxic[[p[1] for p in batch]][document]
            # The batch's own words, once a fold, as rows of one input table.
            numbers = np.repeat([p[0] for p in batch], sizes)[:, None] * (words.count + 1) + windows
            used, local = np.unique(numbers, return_inverse=True)
            local = local.reshape(windows.shape)
            of_fold, of_word = np.divmod(used, words.count + 1)
            inputs = base[of_fold, of_word]
            real = np.flatnonzero(of_word < words.count)
            own = of_word[real]
            sequences = by_sequence[_ranges(words.short_first, own)]
            n_sequences = np.diff(words.short_first)[own]
            owner = np.repeat(real, n_sequences)
            inputs[real, embedded[0]] = network.embeddings["word"][by_word[own]]
            inputs[:, embedded[1]] = _summed(owner, network.embeddings["sequence"][sequences], len(used))
            inputs[real, embedded[1]] /= n_sequences[:, None]
            # Without the embeddings of half of its words the network learns from rates, which new words have too.
            shown = np.zeros((len(used), 1), np.float32)
            shown[real, 0] = rng.random(len(real)) < 0.5
            inputs[:, 4:] *= shown

            logits, found = forward(network.parameters, projected(network.parameters, inputs), local, mask, keep=True)
            # Of a toxic document the worst window counts, of a clean one all do.
            first = np.cumsum(sizes) - sizes
            worst = logits == np.maximum.reduceat(logits, first)[document]
            weight = np.where(label == 1, worst / share, 1 / (1 - share) / np.array(sizes)[document])
            slope = (1 / (1 + np.exp(-logits)) - label) * weight / len(batch) / 2
            grown, d_gates = backward(network.parameters, local, mask, found, slope.astype(np.float32))
            d_inputs = np.zeros_like(inputs)
            for way, places in d_gates.items():
                by_input = _summed(local.T.ravel(), places.reshape(-1, places.shape[2]), len(used))
                grown[f"{way}_input"] = inputs.T @ by_input
                d_inputs += by_input @ network.parameters[f"{way}_input"].T
            d_inputs[:, 4:] *= shown
            grown["embedding_word"] = _summed(by_word[own], d_inputs[real, embedded[0]], _EMBEDDINGS)
            d_inputs[real, embedded[1]] /= n_sequences[:, None]
            grown["embedding_sequence"] = _summed(sequences, d_inputs[owner, embedded[1]], _EMBEDDINGS)
            steps.step(grown)


def _words(text: bytes | None) -> list[bytes]:
    return [w for some in terms_in_slices(text or b"") for w in some]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text"))


def fit(docs: DataFrame, labels: DataFrame) -> Network | float:
    """A network from labelled documents; the share of toxic ones (0 without any) where one class is missing."""
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    )
    found = {row.toxic: row["count"] for row in known.groupBy("toxic").count().collect()}
    n_toxic, n_clean = found.get(1, 0), found.get(0, 0)
    share = n_toxic / max(1, n_toxic + n_clean)
    bounds = {1: min(1.0, TOXIC_ROWS / max(1, n_toxic)), 0: min(1.0, CLEAN_ROWS / max(1, n_clean))}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    drawn = known.where(draw < F.when(F.col("toxic") == 1, int(bounds[1] * (1 << 20))).otherwise(int(bounds[0] * (1 << 20))))
    # Both sides of the join are small: some thousand labels, and the documents that have them.
    rows = _texts(docs).where(F.octet_length("text") <= FITTED_BYTES).join(F.broadcast(drawn), "doc_id").toArrow()
    toxic = rows["toxic"].to_numpy().astype(np.int64)
    if len(np.unique(toxic)) < 2:
        return share
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    texts = [_words(text) for text in rows["text"].to_pylist()]
    # Every fold has its part of both classes.
    folds = np.zeros(len(toxic), np.int64)
    for label in (0, 1):
        own = order[toxic[order] == label]
        folds[own] = np.arange(len(own)) % _FOLDS
    network = train(texts, toxic, folds)
    drawn_share = toxic.mean()
    network.offset = float(np.log(share / (1 - share)) - np.log(drawn_share / (1 - drawn_share)))
    return network


def score_toxicity(docs: DataFrame, network: Network | float, predicted_from: float = PREDICTED_FROM) -> DataFrame:
    """One row for each row of ``docs``: doc_id, score from 0 to 1, predicted 0 or 1.

    A null text counts as empty; a text without words is one window of a blank word.  Rows that repeat are
    scored each on its own, a null doc_id stays; an empty table gives no row; other columns are not read.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if isinstance(network, Network):
                texts = (_words(t.as_buffer().to_pybytes() if t.is_valid else None) for t in batch.column("text"))
                scores = network.scores(texts)
            else:
                scores = np.full(batch.num_rows, float(network))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = _texts(docs).mapInArrow(score, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= predicted_from).cast("int"))


def predict_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learnt from rows whose crc32 of the doc_id, modulo 3, is not 1.

    ``labels`` is (doc_id, toxic 0 or 1); rows with a null are left out, repeated ones averaged.  Without labels
    of both classes every score is the share of toxic ones.  A null doc_id is held out from nothing.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % 3 == 1, F.lit(False))
    network = fit(docs, labels.where(~held_out))
    return score_toxicity(docs, network).withColumn("held_out", held_out).select("doc_id", "held_out", "score", "predicted")
