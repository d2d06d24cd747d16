"""Language identification with n-gram filters that hold a bit mask of languages.

A bit-sliced Bloom filter has in each slot one bit per language instead of one
bit.  Looking an n-gram up in a few slots and and-ing what they hold yields at
once every language whose filter contains it.  A document's n-grams are counted
per language in this way; from each count the number that the filter's false
positives explain is taken off, and the largest rest decides.

A language has an n-gram when the n-gram's share of all that language's n-grams reaches
`share`.  The share belongs to the method: what occurs at all in a language grows
with the corpus until each language has nearly everything, what has a share does
not.  So a language has at most 1/share entries, and the broadcast filter has a fixed
size for each 64 languages, whatever the corpus.  `Filters.covered` says which part of each
language's n-grams are entries.

Scale: learning shuffles one row for each task, language and distinct n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import integral, remainder, written
from .flat import LOWER, Tally, buffer, mix, slices

N = 4
SLOTS = 1 << 20
HASHES = 3
SHARE = 2e-5
#: Languages in a word of a mask; more of them take more words.
WIDE = 64


def grams(data: np.ndarray, off: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of lower-cased bytes and their rows.

    Digits, signs and white space all count as one space, so an n-gram tells
    letters and word ends only.  The packed value is exact, not a hash.
    """
    low = LOWER[data]
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    low = np.where(letter, low, 32).astype(np.uint64)
    if len(low) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    packed = np.zeros(len(low) - n + 1, np.uint64)
    for k in range(n):
        packed = (packed << np.uint64(8)) | low[k : len(low) - n + 1 + k]
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    some = letter[: len(packed)] | letter[n - 1 :]
    some &= row[: len(packed)] == row[n - 1 :]
    at = np.flatnonzero(some)
    return packed[at], row[at]


def _slots(packed: np.ndarray, slots: int, hashes: int) -> list[np.ndarray]:
    h = mix(packed)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(k) * step) % np.uint64(slots)).astype(np.int64) for k in range(hashes)]


class Filters:
    """Bloom filters of any number of languages, sliced by bit: a slot has a word for each 64 of them."""

    def __init__(self, names: list[str], entries: list[np.ndarray], slots: int = SLOTS, hashes: int = HASHES, usual: int = 0, covered: list[float] | None = None):
        """usual: the language of a text that has a letter but no known n-gram; covered: the part of each language's n-grams that are entries."""
        self.names, self.slots, self.hashes, self.usual, self.covered = names, slots, hashes, usual, covered
        kind = np.uint8 if len(names) <= 8 else np.uint64
        self.masks = [np.zeros(slots, kind) for _ in range(max(1, -(-len(names) // WIDE)))]
        for k, packed in enumerate(entries):
            for at in _slots(packed, slots, hashes):
                self.masks[k // WIDE][at] |= kind(1 << k % WIDE)
        fill = np.array([self._bit(self.masks[k // WIDE], k).mean() for k in range(len(names))]) if names else np.zeros(0)
        self.false = np.minimum(fill**hashes, 0.99)

    @staticmethod
    def _bit(mask: np.ndarray, k: int) -> np.ndarray:
        return (mask >> mask.dtype.type(k % WIDE)) & mask.dtype.type(1)

    def hits(self, packed: np.ndarray) -> list[np.ndarray]:
        """The masks of languages that contain each n-gram, word by word."""
        first, *rest = _slots(packed, self.slots, self.hashes)
        out = [m[first] for m in self.masks]
        for at in rest:
            out = [x & m[at] for x, m in zip(out, self.masks, strict=True)]
        return out

    def score(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row: the number of n-grams, and the corrected count by language."""
        packed, row = grams(data, off)
        rows, hits = len(off) - 1, self.hits(packed)
        total = np.bincount(row, minlength=rows).astype(float)
        counts = np.empty((rows, len(self.names)))
        for k, false in enumerate(self.false):
            n = np.bincount(row, self._bit(hits[k // WIDE], k).astype(float), rows)
            counts[:, k] = np.maximum(0, n - false * total) / (1 - false)
        return total, counts


def learn(docs: DataFrame, share: float = SHARE, slots: int = SLOTS, hashes: int = HASHES) -> Filters:
    """Filters from the rows (text, lang) of docs, all of them.

    Null texts and null languages teach nothing.
    """
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Tally] = {}

        def out(lang: str) -> pa.RecordBatch:
            keys, n = held[lang].take()
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], schema=schema)

        for batch in slices(batches):
            packed, row = grams(*_padded(batch["text"]))
            names = batch["lang"].to_pylist()
            kinds = {x: i for i, x in enumerate(dict.fromkeys(names))}
            kind = np.array([kinds[x] for x in names])[row] if len(row) else row
            for lang, i in kinds.items():
                tally = held.setdefault(lang, Tally())
                tally.add(packed[kind == i])
                if tally.full():
                    yield out(lang)
        for lang in held:
            yield out(lang)

    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = written(counts)
    totals = {r["lang"]: r["t"] for r in counts.groupBy("lang").agg(F.sum("n").alias("t")).collect()}
    names = sorted(totals)
    if not names:
        return Filters([], [], slots, hashes)
    least = F.create_map([x for lang in names for x in (F.lit(lang), F.lit(max(1.0, share * totals[lang])))])
    frequent = counts.where(F.col("n") >= least[F.col("lang")]).toPandas()
    own = [frequent.loc[frequent["lang"] == x] for x in names]
    covered = [float(x["n"].sum()) / totals[lang] for x, lang in zip(own, names, strict=True)]
    return Filters(names, [x["gram"].to_numpy(np.uint64) for x in own], slots, hashes, names.index(max(names, key=totals.get)), covered)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred string and score double for each row of docs (doc_id, text).

    score is the winner's share of the corrected counts, 0 to 1.  `und` with score
    0 stands for a null text, one without a letter, or any text if no language was
    learned.  A text whose letters form no known n-gram gets the language with the
    most n-grams, with score 0.  Ties go to the first name by code point.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        names = np.array([*f.names, "und"], object)
        for batch in slices(batches):
            _, counts = f.score(*_padded(batch["text"]))
            total, letters = counts.sum(1), batch["letters"].to_numpy(zero_copy_only=False).astype(bool)
            if f.names:
                known = letters & (total > 0)
                best = np.where(letters, np.where(known, counts.argmax(1), f.usual), len(f.names))
                score = np.where(known, counts.max(1) / np.where(known, total, 1), 0.0)
            else:
                best, score = np.zeros(len(total), int), np.zeros(len(total))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(names[best], pa.string()), pa.array(score)], schema=schema)

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    return docs.select("doc_id", "text", letters).mapInArrow(predict, "doc_id long, lang_pred string, score double")


def _padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts with three spaces after each, so that a single letter has an n-gram."""
    data, off = buffer(texts)
    out = np.full(len(data) + 3 * (len(off) - 1), 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(3 * np.arange(len(off) - 1), np.diff(off))] = data
    return out, off + 3 * np.arange(len(off))


def op3(docs: DataFrame) -> DataFrame:
    """The contract's result: doc_id, held_out, lang_pred, score for every document."""
    filters = learn(integral(docs).where(remainder("doc_id", 5) != 0))
    out = identify(docs, filters)
    return out.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
