"""Toxicity by logistic regression, learned with FTRL-proximal.

Features are hashed word n-grams (1 and 2 words) and skip-grams (two words with
one left out between them), present or not, of the whole text in lower case.  So
that inflected forms of a word share a weight, the one-word grams also stand for
the word's stems: its first 4 to 7 bytes.
FTRL keeps a learning rate of its own for each coordinate, and its L1 penalty
leaves most weights at exactly zero: what is broadcast is a sorted array of the
rest, which the hash space bounds.  The penalty is high: a long text has thousands
of features that occur in it alone, and their small weights would outvote the few
that tell.

Learning sees at most `most` labelled documents (a documented bound on the
labels alone); their features are made on the executors.  Scoring is one pass
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import integral, labelled_sample, mapped, remainder
from .flat import LOWER, Words, buffer, mix, prefix, prefix_hash, slices, span_hash, trim

#: Features are hashed to so many bits.
BITS = 22
#: Labelled documents that are used for learning, at most.
MOST = 8_000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 1.0
#: A toxic document counts as so many when learning.
POSITIVE = 4.0
THRESHOLD = 0.3
#: Bytes of the stems.
STEMS = (4, 5, 6, 7)
#: Signs that are taken off a word's edges before hashing (fixed values).
_EDGE = np.zeros(256, bool)
_EDGE[list(b".,;:!?\"'()[]{}<>*#$%&|-_")] = True


def grams(texts: pa.Array, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed features and their rows, kind by kind, with repeats."""
    words = Words(*buffer(texts))
    data, start, end, row = words.data, words.start.copy(), words.end.copy(), words.row
    if not len(start):
        return
    for _ in range(4):  # up to four signs on either edge; a word of signs alone keeps one
        start += _EDGE[data[start]] & (end - start > 1)
        end -= _EDGE[data[end - 1]] & (end - start > 1)
    low, mask = LOWER[data], np.uint64((1 << bits) - 1)
    h = span_hash(low, start, end)
    yield (h & mask).astype(np.int64), row
    sums = prefix(low)
    for n in STEMS:
        at = np.flatnonzero(end - start >= n)
        yield ((prefix_hash(sums, start[at], start[at] + n) + np.uint64(n)) & mask).astype(np.int64), row[at]
    for gap in (1, 2):
        at = np.flatnonzero(row[:-gap] == row[gap:])
        yield (mix(h[at] * np.uint64(0x9E3779B97F4A7C15 + 2 * gap) + h[at + gap]) & mask).astype(np.int64), row[at]


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and their rows; each at most once in a row, sorted by row."""
    return _distinct(list(grams(texts, bits)), bits)


def _distinct(parts: list[tuple[np.ndarray, np.ndarray]], bits: int) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, row = (np.concatenate(x) for x in zip(*parts, strict=True))
    both = np.unique((row << bits) | key)
    return both & ((1 << bits) - 1), both >> bits


class Ftrl:
    """FTRL-proximal for logistic loss over present-or-absent features."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int, weight: float = 1.0) -> float:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = (p - label) * weight
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] += g * g
        return float(p)


class Model:
    """The weights that are not zero, by feature, and the bias.

    Sent as two arrays of that many entries; a process that scores spreads them
    over the hash space once.
    """

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float, bits: int = BITS):
        self.keys, self.weights, self.bias, self.bits = keys.astype(np.int32), weights, bias, bits
        self._table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}

    def score(self, texts: pa.Array) -> np.ndarray:
        if self._table is None:
            self._table = np.zeros(1 << self.bits, np.float32)
            self._table[self.keys] = self.weights
        parts = []
        for key, row in grams(texts, self.bits):
            some = np.flatnonzero(self._table[key])
            parts.append((key[some], row[some]))
        key, row = _distinct(parts, self.bits)
        total = np.bincount(row, self._table[key], len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def fit(rows: list[tuple[int, np.ndarray]], bits: int = BITS, epochs: int = EPOCHS) -> Model:
    """A model from (label, features); without rows it scores 0.5 everywhere.

    The bias is the last coordinate and learns as any other.
    """
    size = 1 << bits
    model = Ftrl(size + 1)
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            label, at = rows[i]
            model.learn(np.append(at, size), label, POSITIVE if label else 1.0)
    at = np.flatnonzero(np.abs(model.z[:size]) > model.l1)
    return Model(at, model.weights(at), float(model.weights(np.array([size]))[0]), bits)


def learn(docs: DataFrame, marks: DataFrame, most: int = MOST, bits: int = BITS) -> Model:
    """A model from labels.toxic of at most `most` documents with crc32(doc_id) mod 4 <> 2."""
    sample = labelled_sample(docs, marks, "toxic", 4, 2, most)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            key, row = features(batch["text"], bits)
            off = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), batch["_label"].cast(pa.int32()), pa.ListArray.from_arrays(pa.array(off), pa.array(key.astype(np.int32)))], ["doc_id", "label", "keys"])

    # Each row's features stay where they came, as views: sorting the table would hold it several times.
    rows = []
    for batch in sample.mapInArrow(extract, "doc_id long, label int, keys array<int>").toArrow().to_batches():
        flat, off = np.asarray(batch["keys"].flatten()), np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(batch["keys"]), np.int64))))
        rows += [(i, label, flat[off[k] : off[k + 1]]) for k, (i, label) in enumerate(zip(batch["doc_id"].to_pylist(), batch["label"].to_pylist(), strict=True))]
    model = fit([x[1:] for x in sorted(rows, key=lambda x: x[0])], bits)
    del rows
    trim()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score for each row of docs (doc_id, text).

    A null or empty text, or one of white space, gets the score of the bias alone.
    Equal texts get equal scores; very long texts are scored whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(shared.value.score(batch["text"]))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def clean(docs: DataFrame, marks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold, with the columns of docs.

    The score is computed beside the row in one pass: no join, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, marks))
    text = f"c{docs.columns.index('text')}"

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            yield batch.filter(pa.array(shared.value.score(batch[text]) < threshold))

    return mapped(docs, keep)


def op8(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The contract's result: doc_id, held_out, score, predicted for every document."""
    out = score(integral(docs), learn(docs, marks))
    return out.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
