"""Quality rules: counts of a text, and an n-gram perplexity between two bands.

The language model is modified Kneser-Ney over bytes, of order 4.  Spark counts
the n-grams of all documents; from that table come the contexts' totals, the
continuation counts of the lower orders, the discounts, and the probability of every
n-gram, order by order.  The most frequent `MOST` of an order at most are
broadcast in sorted hash arrays (packed bytes, log probability); an n-gram of a text that is
not among them meets the table of all in a join, after which its part is a sum by
document.  So each text is measured by the whole model.

`Model` alone, without the table, backs off to the order below where an n-gram is not in the
arrays; a context's weight of backing off is what its n-grams in the arrays leave, so that it
sums to 1 whatever is left out.

Per language, the median of the documents' log perplexities and their median
absolute deviation give an upper and a lower bound: text that is too strange and
text that is too predictable are both rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import integral, written
from .flat import _SPACE, Tally, Words, buffer, mix, runs, slices, span_hash

ORDER = 4
#: N-grams of an order that are broadcast, at most, 8 bytes each.
MOST = 2_000_000
#: Width of the bands, in deviations, chosen on labelled rows outside the held-out fifth; the least deviation, in bits a byte.
UPPER, LOWER_BAND, LEAST_DEVIATION = 5.0, 5.0, 0.02
#: Rules that need no model.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def packed(data: np.ndarray, off: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each byte its n-gram, the byte last, packed into an integer; zeros stand before a text.

    Also the offsets of the rows among them.
    """
    front = order - 1
    out = np.zeros(len(data) + front * (len(off) - 1), np.uint8)
    to = np.arange(len(data)) + np.repeat(front * np.arange(1, len(off)), np.diff(off))
    out[to] = data
    code = np.zeros(len(to), np.uint32)
    for k in range(front, -1, -1):
        code = (code << np.uint32(8)) | out[to - k]
    return code, off


class Model:
    """Interpolated modified Kneser-Ney: by order the n-grams' log2 probabilities and the contexts' log2 weights of backing off."""

    def __init__(self, first: np.ndarray):
        self.first = first  # by byte
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.back: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def missing(self, code: np.ndarray) -> np.ndarray:
        """Places of the n-grams of the highest order that the arrays lack."""
        keys = self.grams[ORDER][0]
        return np.flatnonzero(keys[np.minimum(np.searchsorted(keys, code), len(keys) - 1)] != code)

    def logs(self, code: np.ndarray, order: int = ORDER) -> np.ndarray:
        """log2 of the probability of each n-gram's last byte after the others."""
        if order == 1:
            return self.first[code]
        keys, values = self.grams[order]
        at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
        out = values[at]
        missing = np.flatnonzero(keys[at] != code)
        if len(missing):
            rest = code[missing]
            contexts, weights = self.back[order]
            context = rest >> np.uint32(8)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            weight = np.where(contexts[at] == context, weights[at], np.float32(0))
            out[missing] = weight + self.logs(rest & _mask(order - 1), order - 1)
        return out


def _mask(order: int) -> np.uint32:
    return np.uint32((1 << 8 * order) - 1)


def _low(order: int) -> Column:
    """The last bytes of an n-gram."""
    return F.col("gram").bitwiseAND((1 << 8 * order) - 1)


def _discounts(n: list[int]) -> np.ndarray:
    """Discounts of the counts 0 to 3 and more, from the numbers of n-grams that occur 1 to 4 times."""
    n1, n2, n3, n4 = n
    if not (n1 and n2):
        return np.array([0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = [0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, (3 - 4 * y * n4 / n3) if n3 else 0.9]
    return np.array([0, *(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d[1:], 1))])


def count(docs: DataFrame) -> DataFrame:
    """gram long and n long over all texts; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in slices(batches):
            tally.add(packed(*buffer(batch["text"]))[0].astype(np.uint64))
            if tally.full():
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in tally.take()], ["gram", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in tally.take()], ["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _frequent(own: DataFrame, most: int) -> Column:
    """The most frequent n-grams of a table, by quarters of powers of two, as many of them as are `most` at most."""
    power = F.floor(F.log2("n") * 4)
    least, so_far = None, 0
    for r in sorted(own.groupBy(power.alias("power")).count().collect(), reverse=True):  # a row for each quarter: 252 at most
        so_far += r["count"]
        if so_far > most:
            break
        least = r["power"]
    return F.lit(False) if least is None else power >= least


def learned(docs: DataFrame, share: float | None = None) -> tuple[Model, DataFrame, bool]:
    """The model of all texts of docs, the written table of all n-grams (gram long, bits float: log2 of the probability), and whether the model has them all.

    share: the n-grams of the model are those with this share of their order, not the `MOST` most frequent.
    Without any text every byte has probability 1/256.
    """
    tables = {ORDER: written(count(docs))}
    for order in range(ORDER - 1, 0, -1):  # continuation counts: how many n-grams of the order above end so
        tables[order] = written(tables[order + 1].select(_low(order).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")))
    model, lower = Model(np.full(256, -8, np.float32)), None
    for order in range(1, ORDER + 1):
        own = tables[order]
        sums = own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("grams"), *(F.count_if(F.col("n") == k).alias(f"n{k}") for k in range(1, 5))).first()
        discount = _discounts([sums[f"n{k}"] for k in range(1, 5)])
        off = F.when(F.col("n") == 1, float(discount[1])).when(F.col("n") == 2, float(discount[2])).otherwise(float(discount[3]))
        if order == 1:
            rows = own.select("gram", "n", F.greatest(F.col("n") - off, F.lit(0.0)).alias("p"), F.least(off, F.col("n")).alias("off")).collect()  # 256 at most
            if rows:
                first = np.full(256, sum(r["off"] for r in rows) / sums["total"] / 256)
                first[[r["gram"] for r in rows]] += np.array([r["p"] for r in rows]) / sums["total"]
                model.first = np.log2(first / first.sum()).astype(np.float32)
            lower = docs.sparkSession.createDataFrame([(k, float(x)) for k, x in enumerate(np.exp2(model.first.astype(float)))], "low long, below double")
            continue
        context = Window.partitionBy(F.shiftright("gram", 8))
        total = F.sum("n").over(context)
        of_own = own.select("gram", "n", (F.greatest(F.col("n") - off, F.lit(0.0)) / total).alias("own"), (F.sum(off).over(context) / total).alias("back"), _low(order - 1).alias("low"))
        every = written(of_own.join(lower, "low").select("gram", "n", (F.col("own") + F.col("back") * F.col("below")).alias("p")))
        lower = every.select(F.col("gram").alias("low"), F.col("p").alias("below"))
        frequent = _frequent(own, MOST) if share is None else F.col("n") >= max(1, int(share * sums["total"]))
        kept = every.where(frequent).select("gram", "p").toPandas().sort_values("gram")
        key, whole = kept["gram"].to_numpy(np.uint32), kept["p"].to_numpy(float)
        if not len(key):
            model.grams[order] = np.full(1, 0xFFFFFFFF, np.uint32), model.logs(np.full(1, 0xFFFFFFFF, np.uint32) & _mask(order - 1), order - 1)
            model.back[order] = np.zeros(1, np.uint32), np.zeros(1, np.float32)
            continue
        model.grams[order] = key, np.log2(whole).astype(np.float32)
        contexts, at = np.unique(key >> np.uint32(8), return_inverse=True)
        below = np.exp2(model.logs(key & _mask(order - 1), order - 1).astype(float))
        rest, below = (1 - np.bincount(at, x, len(contexts)) for x in (whole, below))
        # Where all that the order below can say is in the arrays, nothing backs off.
        weight = np.where(below > 1e-6, np.maximum(rest, 1e-9) / np.maximum(below, 1e-6), 1.0)
        model.back[order] = contexts, np.log2(weight).astype(np.float32)
    return model, every.select("gram", F.log2("p").cast("float").alias("bits")), len(key) == sums["grams"]


def learn(docs: DataFrame, share: float | None = None) -> Model:
    """The model of `learned` alone."""
    return learned(docs, share)[0]


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The rules' counts of each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data, off = buffer(texts)
    n = len(off) - 1
    words = Words(data, off)

    def by_row(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return sums[off[1:]] - sums[off[:-1]]

    window, at = runs(words.hashes(), words.row, 3)
    _, place, times = np.unique(window ^ mix(words.row[at].astype(np.uint64)), return_inverse=True, return_counts=True)
    twice = at[times[place] >= 2]
    repeated = np.zeros(len(words.start), bool)
    for k in range(3):
        repeated[twice + k] = True
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    edge[:-1] |= data == 10
    cut = np.flatnonzero(edge)
    start = np.concatenate(([0], cut[:-1])) if len(cut) else cut
    start = start + (data[np.minimum(start, max(0, len(data) - 1))] == 10 if len(data) else 0) * 1
    start, end = np.minimum(start, cut), cut
    some = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[some], end[some]
    row = np.searchsorted(off, start, "right") - 1
    _, head = np.unique(span_hash(data, start, end) ^ mix(row.astype(np.uint64)), return_index=True)
    lines = np.bincount(row, minlength=n) - np.bincount(row[head], minlength=n)
    return {
        "n_words": words.count,
        "word_chars": by_row(~_SPACE[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": by_row(_SYMBOL[data]),
        "n_dup_lines": lines,
        "n_repeat_words": np.bincount(words.row[repeated], minlength=n),
    }


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, model: Model, every: DataFrame | None = None) -> DataFrame:
    """doc_id, lang, the counts, and bits double: the text's log2 perplexity by byte, null without a byte.

    every: the table of all n-grams, for those that the model lacks; if it is left out, or lacks them too, they back off.
    """
    shared, join = docs.sparkSession.sparkContext.broadcast(model), every is not None
    schema = pa.schema([("_row", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), *((k, pa.int64()) for k in _COUNTS), ("size", pa.int64()), ("sum", pa.float64()), ("gram", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, own = batch.num_rows, counts(batch["text"])
            code, off = packed(*buffer(batch["text"]))
            logs, size = shared.value.logs(code).astype(float), np.diff(off)
            out = shared.value.missing(code) if join else np.zeros(0, np.int64)
            rest = logs[out]
            logs[out] = 0
            sums = np.concatenate(([0.0], np.cumsum(logs)))
            yield pa.RecordBatch.from_arrays(
                [batch["_row"], batch["doc_id"].cast(pa.int64()), batch["lang"].cast(pa.string()), *(pa.array(own[k].astype(np.int64)) for k in _COUNTS), pa.array(size), pa.array(sums[off[1:]] - sums[off[:-1]]), pa.nulls(n, pa.int64())], schema=schema
            )
            if len(out):  # each such n-gram of a row once, with its number as size and what it has by backing off
                row = np.searchsorted(off, out, "right") - 1
                _, first, times = np.unique(row << 32 | code[out].astype(np.int64), return_index=True, return_counts=True)
                none = [pa.nulls(len(first), schema.field(k).type) for k in ("doc_id", "lang", *_COUNTS)]
                yield pa.RecordBatch.from_arrays([batch["_row"].take(pa.array(row[first])), *none, pa.array(times), pa.array(rest[first]), pa.array(code[out[first]].astype(np.int64))], schema=schema)

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "lang", "text")
    found = rows.mapInArrow(run, f"_row long, doc_id long, lang string, {', '.join(f'{k} long' for k in _COUNTS)}, size long, sum double, gram long")
    if join:
        found = written(found)
        rest = found.where(F.col("gram").isNotNull()).select("_row", "size", "sum", "gram").join(every, "gram", "left")
        rest = rest.groupBy("_row").agg(F.sum(F.col("size") * F.coalesce("bits", "sum")).alias("_more"))
        found = found.where(F.col("gram").isNull()).join(rest, "_row", "left").withColumn("sum", F.col("sum") + F.coalesce("_more", F.lit(0.0)))
    return found.select("doc_id", "lang", *_COUNTS, F.when(F.col("size") > 0, -F.col("sum") / F.col("size")).alias("bits"))


def bands(measured: DataFrame) -> DataFrame:
    """lang, lower and upper of the documents that pass the plain rules; a null lang is one of its own."""
    usual = measured.where(~F.col("base_failed") & F.col("bits").isNotNull())
    middle = usual.groupBy("lang").agg(F.percentile_approx("bits", 0.5, 10_000).alias("middle"))
    off = usual.join(middle.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang"))).groupBy("lang", "middle").agg(F.percentile_approx(F.abs(F.col("bits") - F.col("middle")), 0.5, 10_000).alias("off"))
    deviation = F.greatest(1.4826 * F.col("off"), F.lit(LEAST_DEVIATION))
    return off.select(F.col("lang").alias("_lang"), (F.col("middle") - LOWER_BAND * deviation).alias("lower"), (F.col("middle") + UPPER * deviation).alias("upper"))


def op7(docs: DataFrame) -> DataFrame:
    """The contract's result for every document, with lang, bits (log2 perplexity by byte), lower and upper.

    Null, empty and blank texts have no words and fail the plain rules; a language
    without a document that passes them has no bands and rejects no more.
    """
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    model, every, whole = learned(integral(docs))
    measured = written(measure(docs, model, None if whole else every).withColumn("base_failed", failed))
    inside = F.col("bits").between(F.coalesce("lower", "bits"), F.coalesce("upper", "bits"))
    return (
        measured.join(written(bands(measured)), F.col("lang").eqNullSafe(F.col("_lang")), "left")
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "bits", "lower", "upper")
    )
