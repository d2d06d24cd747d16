"""Sequence alignment: edit counts, dynamic time warping, ABX scores, sentence search in word tiers.

Alignments of a batch of pairs run together, one anti-diagonal after another: the
state is two diagonals per pair, never a matrix, and what a path would be asked
for (its length, sums of squared errors, kinds of edits) is carried along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, LongType, StringType, StructField, StructType

from .ranking import meet

#: Pairs that are aligned together, and cells of a diagonal over them, at most.
PAIRS, CELLS = 512, 1 << 20
#: Elements of lists that are worked on at once, or those of one row.
TOKENS = 1 << 18
FLOOR = 1e-8


def _append(df: DataFrame, fields: list[tuple[str, DataType]], fn: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """df with new columns that fn makes of each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *fn(batch)], [*batch.schema.names, *(n for n, _ in fields)])

    return df.mapInArrow(run, StructType([*df.schema.fields, *(StructField(n, t) for n, t in fields)]))


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths and flat values of a list column; null is empty."""
    return np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64), column.flatten()


def _padded(flat: np.ndarray, size: np.ndarray, fill: float) -> np.ndarray:
    out = np.full((len(size), max(1, int(size.max(initial=0))), *flat.shape[1:]), fill, flat.dtype)
    at = np.arange(len(flat)) - np.repeat(np.concatenate(([0], np.cumsum(size)))[:-1], size)
    out[np.repeat(np.arange(len(size)), size), at] = flat
    return out


def _parts(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Indexes of pairs of similar size, few enough to be aligned together."""
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        n = PAIRS
        while n > 1 and n * int(sizes[order[min(len(order), at + n) - 1]] + 1) > CELLS:
            n //= 2
        yield order[at : at + n]
        at += n


def _edits(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(pairs, 3): substitutions, deletions and insertions that turn x into y; of equal costs a match or substitution is taken before a deletion, that before an insertion.

    The counts are carried in one integer, 20 bits each.
    """
    pairs, wide, high = len(n), x.shape[1] + 1, y.shape[1] + 1
    far, bits = np.int32(1 << 30), 20
    first = lambda v, fill: np.concatenate([np.full((pairs, 1), fill), v], 1).astype(np.int32)
    x, y = first(x, -3), first(y, -4)
    # Place i of a diagonal is kept at i + 1, so that place -1 is there and far away.
    costs = [np.full((pairs, wide + 1), far, np.int32) for _ in range(3)]
    kinds = [np.zeros((pairs, wide + 1), np.int64) for _ in range(3)]
    costs[0][:, 1] = 0
    out = np.zeros((pairs, 3), np.int64)
    for d in range(1, int((n + m).max(initial=0)) + 1):
        last, before, now = costs[(d - 1) % 3], costs[(d - 2) % 3], costs[d % 3]
        lo, hi = max(0, d - high + 1), min(d, wide - 1)
        at, above, own = slice(lo + 1, hi + 2), slice(lo, hi + 1), slice(lo, hi + 1)
        differ = x[:, own] != y[:, d - hi : d - lo + 1][:, ::-1]
        diag, up, left = before[:, above] + differ, last[:, above] + 1, last[:, at] + 1
        up_first = up <= left
        side = np.where(up_first, up, left)
        straight = diag <= side
        was, mine = kinds[(d - 2) % 3], kinds[(d - 1) % 3]
        carried = np.where(straight, was[:, above] + differ * np.int64(1 << 2 * bits), np.where(up_first, mine[:, above] + (1 << bits), mine[:, at] + 1))
        now.fill(far)
        now[:, at] = np.where(straight, diag, side)
        kinds[d % 3][:, at] = carried
        done = np.flatnonzero(n + m == d)
        total = kinds[d % 3][done, n[done] + 1]
        out[done] = np.stack([total >> 2 * bits, (total >> bits) & ((1 << bits) - 1), total & ((1 << bits) - 1)], 1)
    return out


def _cut(batch: pa.RecordBatch, columns: list[str], most: int = TOKENS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many elements of list columns, or one row."""
    ends = np.cumsum(sum(np.asarray(pc.fill_null(pc.list_value_length(batch[c]), 0), np.int64) for c in columns))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def edit_counts(df: DataFrame, reference: str, hypothesis: str, prefix: str = "", keep: list[str] | None = None) -> DataFrame:
    """df with s, d, i and n_ref of two arrays of strings; null arrays are empty.

    keep: the columns of df that are wanted, all of them where it is absent.  A batch is worked on in parts of a bounded number of tokens.
    """
    names = [f"{prefix}{k}" for k in ("s", "d", "i", "n_ref")]
    keep = df.columns if keep is None else keep

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        (n, a), (m, b) = _lists(batch[reference]), _lists(batch[hypothesis])
        codes = np.asarray(pc.dictionary_encode(pa.concat_arrays([a.cast(pa.string()), b.cast(pa.string())]), null_encoding="encode").indices, np.int64)
        x, y = codes[: len(a)], codes[len(a) :]
        fx, fy = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(m)))
        out = np.zeros((len(n), 3), np.int64)
        for part in _parts(np.maximum(n, m)):
            take = lambda v, f, part=part: np.concatenate([v[f[k] : f[k + 1]] for k in part]) if len(part) else v[:0]
            out[part] = _edits(_padded(take(x, fx), n[part], -1), _padded(take(y, fy), m[part], -2), n[part], m[part])
        return [pa.array(out[:, 0]), pa.array(out[:, 1]), pa.array(out[:, 2]), pa.array(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _cut(batch, [reference, hypothesis]):
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), *fn(part)], [*keep, *names])

    return df.mapInArrow(run, StructType([*(df.schema[c] for c in keep), *(StructField(k, LongType()) for k in names)]))


def error_rate(df: DataFrame, by: list[str], prefix: str = "", out: str = "rate") -> DataFrame:
    """Sums of edit counts by group and the ratio of the sums; null without a reference token."""
    sums = df.groupBy(*by).agg(*(F.sum(f"{prefix}{k}").alias(k) for k in ("s", "d", "i", "n_ref")))
    errors = F.col("s") + F.col("d") + F.col("i")
    return sums.withColumn("errors", errors).withColumn(out, F.when(F.col("n_ref") > 0, errors.cast("double") / F.col("n_ref")))


def _scaled(x: np.ndarray, how: str) -> np.ndarray:
    """Frames of one track, scaled for the alignment only."""
    if how == "zscore":
        sd = x.std(0)
        return (x - x.mean(0)) / np.where(sd == 0, 1.0, sd)
    if how == "log":
        return np.log(np.maximum(x, 1.0))
    if how == "none":
        return x
    raise ValueError(f"unknown scale {how!r}")


def _euclid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(-1))


def _kl(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Half the sum of both Kullback-Leibler divergences of distributions."""
    return 0.5 * ((a - b) * (np.log(a) - np.log(b))).sum(-1)


def _warp(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, cost: Callable, raw: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cost and length of each pair's best path, and sums over it of squared differences of raw.

    Steps (1,1), (0,1), (1,0); of equal costs the first of them.
    """
    pairs, wide, high = len(n), x.shape[1], y.shape[1]
    k = raw[0].shape[2] if raw else 0
    far = np.inf
    before = np.full((pairs, wide + 1, 2 + k), 0.0)
    before[..., 0] = far
    last = before.copy()
    out = np.zeros((pairs, 2 + k))
    for d in range(int((n + m).max(initial=0)) - 1):
        i = np.arange(max(0, d - high + 1), min(d, wide - 1) + 1)
        j = d - i
        own = cost(x[:, i], y[:, j])
        # State of place i is kept at i + 1, so that place -1 is there.
        diag, left, up = before[:, i], last[:, i + 1], last[:, i]
        if d == 0:
            new = np.zeros((pairs, 1, 2 + k))
        else:
            take_diag = (diag[..., 0] <= left[..., 0]) & (diag[..., 0] <= up[..., 0])
            take_left = ~take_diag & (left[..., 0] <= up[..., 0])
            new = np.where(take_diag[..., None], diag, np.where(take_left[..., None], left, up))
        new = new.copy()
        new[..., 0] += own
        new[..., 1] += 1
        if raw:
            new[..., 2:] += (raw[0][:, i] - raw[1][:, j]) ** 2
        now = np.zeros_like(last)
        now[..., 0] = far
        now[:, i + 1] = new
        done = np.flatnonzero(n + m - 2 == d)
        out[done] = now[done, n[done]]
        before, last = last, now
    return out[:, 0], out[:, 1], out[:, 2:]


def _frames(column: pa.Array, fields: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, offsets and values (frames x fields) of a column of tracks: arrays of structs or of arrays."""
    size, flat = _lists(column)
    if pa.types.is_struct(flat.type):
        values = np.stack([np.asarray(pc.cast(flat.field(f), pa.float64())) for f in fields], 1) if len(flat) else np.zeros((0, len(fields)))
    else:
        values = np.asarray(pc.cast(flat.flatten(), pa.float64())).reshape(-1, len(fields))
    return size, np.concatenate(([0], np.cumsum(size))), values


def _warped(batch: pa.RecordBatch, a: str, b: str, fields: list[str], prepare: Callable, cost: Callable, errors: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    (n, fa, va), (m, fb, vb) = _frames(batch[a], fields), _frames(batch[b], fields)
    k = len(fields) if errors else 0
    total, length, sums = np.full(len(n), np.nan), np.zeros(len(n)), np.zeros((len(n), k))
    for part in _parts(np.where((n > 0) & (m > 0), np.maximum(n, m), 0)):
        part = part[(n[part] > 0) & (m[part] > 0)]
        if not len(part):
            continue
        rows = [np.concatenate([f(v[o[p] : o[p + 1]]) for p in part]) for v, o, f in ((va, fa, prepare), (vb, fb, prepare), (va, fa, np.asarray), (vb, fb, np.asarray))]
        x, y, rx, ry = (_padded(r, s, 1.0) for r, s in zip(rows, (n[part], m[part], n[part], m[part]), strict=True))
        total[part], length[part], sums[part] = _warp(x, y, n[part], m[part], cost, (rx, ry) if errors else None)
    return total, length, sums


def warped_rmse(df: DataFrame, reference: str, hypothesis: str, fields: list[str], scale: str = "zscore") -> DataFrame:
    """df with rmse_<field>: along the best alignment of two tracks, the root of the mean squared difference of raw values.

    The alignment sees frames scaled track by track (zscore, log or none).  Empty tracks give null.
    """

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        _, length, sums = _warped(batch, reference, hypothesis, fields, lambda v: _scaled(v, scale), _euclid, True)
        none = length == 0
        return [pa.array(np.sqrt(sums[:, k] / np.where(none, 1, length)), mask=none) for k in range(len(fields))]

    return _append(df, [(f"rmse_{f}", DoubleType()) for f in fields], fn)


def _distribution(v: np.ndarray) -> np.ndarray:
    v = np.maximum(v, FLOOR)
    return v / v.sum(1, keepdims=True)


def warped_divergence(df: DataFrame, a: str, b: str, fields: list[str], out: str = "distance") -> DataFrame:
    """df with the mean symmetric divergence of frames along the best alignment; frames are floored and sum to 1."""

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        total, length, _ = _warped(batch, a, b, fields, _distribution, _kl, False)
        none = length == 0
        return [pa.array(total / np.where(none, 1, length), mask=none)]

    return _append(df, [(out, DoubleType())], fn)


def distance_l2(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of numbers, on the JVM."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def pair_distances(triplets: DataFrame, items: DataFrame, track: str, measure: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """id1, id2 (id1 < id2), distance of each pair that triplets need, once.

    measure adds `distance` to rows with _x and _y, the tracks of id1 and id2.
    """
    one = triplets.select(F.col("x_id").alias("_p"), F.col("a_id").alias("_q")).union(triplets.select("x_id", "b_id"))
    pairs = one.select(F.least("_p", "_q").alias("id1"), F.greatest("_p", "_q").alias("id2")).distinct()
    x, y = (items.select(F.col("id").alias(k), F.col(track).alias(v)) for k, v in (("id1", "_x"), ("id2", "_y")))
    return measure(pairs.join(x, "id1").join(y, "id2")).select("id1", "id2", "distance")


def abx_scores(triplets: DataFrame, distances: DataFrame) -> DataFrame:
    """triplets with score: 1 where x is nearer to a, 0 where nearer to b, 0.5 for a tie; chance is 0.5."""
    out = triplets
    for other, name in (("a_id", "_da"), ("b_id", "_db")):
        d = distances.select(F.col("id1").alias(f"_1{name}"), F.col("id2").alias(f"_2{name}"), F.col("distance").alias(name))
        out = out.join(d, (F.least("x_id", other) == F.col(f"_1{name}")) & (F.greatest("x_id", other) == F.col(f"_2{name}"))).drop(f"_1{name}", f"_2{name}")
    return out.withColumn("score", F.when(F.col("_da") < F.col("_db"), 1.0).when(F.col("_da") > F.col("_db"), 0.0).otherwise(0.5)).drop("_da", "_db")


def abx_cells(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """speaker, p, q, score (mean), n."""
    return scored.groupBy(*(by or []), "speaker", "p", "q").agg(F.avg("score").alias("score"), F.count("*").alias("n"))


def abx_accuracy(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """By condition: the mean over speakers of their accuracies, each weighted by triplets; and the pooled one."""
    by = by or []
    one = cells.groupBy(*by, "speaker").agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("_a"), F.sum("n").alias("_n"))
    return one.groupBy(*by).agg(F.avg("_a").alias("mean_across_speakers"), (F.sum(F.col("_a") * F.col("_n")) / F.sum("_n")).alias("accuracy_pooled"), F.sum("_n").alias("n_triplets"))


def _stripped(c: Column | str) -> Column:
    """In lower case, without quotes at the ends."""
    return F.btrim(F.lower(c), F.lit("'\""))


def _plain(labels: pa.Array) -> pa.Array:
    """Words with plain quotes and without hyphens."""
    for a, b in (("’", "'"), ("‘", "'"), ("“", '"'), ("”", '"'), ("-", "")):
        labels = pc.replace_substring(labels, a, b)
    return labels


@lru_cache(1 << 16)
def _like(token: str) -> tuple[str, ...]:
    """The words that are alike to a token: equal, or so but for a final s or 's of either."""
    return (token, token + "s", token + "'s", *((token[:-1],) if token.endswith("s") else ()), *((token[:-2],) if token.endswith("'s") else ()))


def _hit(words: list[str], twos: list[str], tokens: list[str], at: int, window: int, extra: int) -> tuple[int, int] | None:
    """First and last place of words that hold the tokens in order, beginning to look at `at` or up to `window` places behind; None if they do not.

    A word is passed over, or it is the next token, or it is so with the word behind it.  No more than
    len(tokens) + extra words are passed before the last begins.  twos: each word with the one behind it.  All beginnings up to the first word that is the first token
    go the same way from there, and the last of them the farthest: one search stands for them.
    """
    n, many, last = len(words), len(tokens), min(at + window, len(words) - 1)
    like = _like(tokens[0])
    while at <= last:
        first = at
        far = min(n, last + many + extra + 1)
        while first < far and words[first] not in like and twos[first] not in like:
            first += 1
        if first == far:
            return None
        begin = min(first, last)
        k, i, found, end = 0, first, 0, min(n, begin + many + extra + 1)
        keys = like
        while i < end:
            if words[i] in keys:
                found, i = i, i + 1
            elif twos[i] in keys:
                found, i = i + 1, i + 2
            else:
                i += 1
                continue
            k += 1
            if k == many:
                return first, found
            keys = _like(tokens[k])
        at = begin + 1
    return None


def segments(words: DataFrame, sentences: DataFrame, by: str, window: int = 5, extra: int = 8) -> DataFrame:
    """by, pos, sentence, status, t_start, t_end: the sentences of each recording, searched one after another in its words.

    words: by, pos, xmin, xmax, label; sentences: by, pos, sentence.  status: ok,
    no_match, or last_word_mismatch.  The search for a sentence begins behind the one
    before (by its number of tokens), or one word on after a failure, and tries the `window` places behind that too.
    Hyphens do not count, but in the last word they do.  Sentences without a token are left out.  A task has the
    words of some recordings at a time.
    """
    spoken = words.where(F.trim("label") != "").groupBy(by).agg(F.sort_array(F.collect_list(F.struct("pos", "xmin", "xmax", _stripped("label").alias("label")))).alias("words"))
    told = sentences.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), "sentence"))).alias("sentences"))
    return nested_segments(meet(told, spoken, [by], "left"), by, window, extra)


def nested_segments(rows: DataFrame, by: str, window: int = 5, extra: int = 8) -> DataFrame:
    """What `segments` returns, of rows that have a recording's words and sentences in order: by, words (structs of xmin, xmax and a label that is not blank), sentences (of pos and sentence)."""
    from ..functions.text import plain_quotes

    split = lambda s: F.filter(F.transform(F.filter(F.split(plain_quotes(s), r"(?U)[^\w']+"), lambda w: w != ""), _stripped), lambda w: w.isNotNull())
    told = F.filter(F.transform("sentences", lambda s: F.struct(s["pos"].cast("long").alias("pos"), s["sentence"].alias("sentence"), split(s["sentence"]).alias("tokens"))), lambda s: F.size(s["tokens"]) > 0)
    heard = lambda k, kind: F.coalesce(F.col(f"words.{k}"), F.array()).cast(f"array<{kind}>")
    both = rows.withColumn("_told", told).select(by, F.col("_told.pos").alias("_pos"), F.col("_told.sentence").alias("_sentence"), F.col("_told.tokens").alias("_tokens"), F.transform(heard("label", "string"), _stripped).alias("_label"), heard("xmin", "double").alias("_xmin"), heard("xmax", "double").alias("_xmax"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _cut(batch, ["_label", "_pos"]):
                (told, _), (heard, labels), (size, tokens) = _lists(part["_pos"]), _lists(part["_label"]), _lists(part["_tokens"].flatten())
                tokens, plain, labels = (c.to_numpy(zero_copy_only=False).tolist() for c in (tokens, _plain(labels), labels))
                of, to = (np.concatenate(([0], np.cumsum(x))).tolist() for x in (size, heard))
                status, first, last, s = [], [], [], 0
                for k, many in enumerate(told.tolist()):
                    words, at = plain[to[k] : to[k + 1]], 0
                    twos = [*map(add, words, words[1:]), None]
                    for _ in range(many):
                        one = tokens[of[s] : of[s + 1]]
                        hit = _hit(words, twos, one, at, window, extra)
                        ok = hit is not None and labels[to[k] + hit[1]] in _like(one[-1])
                        status.append("ok" if ok else "no_match" if hit is None else "last_word_mismatch")
                        first.append(to[k] + hit[0] if ok else None)
                        last.append(to[k] + hit[1] if ok else None)
                        at, s = hit[0] + len(one) if ok else at + 1, s + 1
                outer = pa.array(np.repeat(np.arange(part.num_rows), told))
                times = (part[c].flatten().take(pa.array(x, pa.int64())) for c, x in (("_xmin", first), ("_xmax", last)))
                yield pa.RecordBatch.from_arrays([part[by].take(outer), part["_pos"].flatten(), part["_sentence"].flatten(), pa.array(status, pa.string()), *times], [by, "pos", "sentence", "status", "t_start", "t_end"])

    fields = [StructField("pos", LongType()), StructField("sentence", StringType()), StructField("status", StringType()), StructField("t_start", DoubleType()), StructField("t_end", DoubleType())]
    return both.mapInArrow(run, StructType([both.schema[by], *fields]))


def spectrogram(samples: DataFrame, by: str, column: str, rate: int) -> DataFrame:
    """by, frames (time by frequency, dB below the largest): a wide-band spectrogram of each array of samples."""
    size = max(128, 2 ** round(np.log2(0.008 * rate)))
    hop = size // 8

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for x in batch[column]:
            v = np.pad(np.asarray(x.as_py() or [], float), size // 2)
            at = np.arange(0, max(1, len(v) - size + 1), hop)
            v = np.pad(v, (0, max(0, at[-1] + size - len(v))))
            power = np.abs(np.fft.rfft(v[at[:, None] + np.arange(size)] * np.hanning(size + 1)[:-1], axis=1))
            out.append((20 * np.log10(np.maximum(power, 1e-10) / max(power.max(), 1e-10))).tolist())
        return [pa.array(out, pa.list_(pa.list_(pa.float64())))]

    return _append(samples.select(by, column), [("frames", ArrayType(ArrayType(DoubleType())))], fn).select(by, "frames")
