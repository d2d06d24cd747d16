"""Importance resampling towards a target distribution.

Words (or runs of up to `longest` of them) are hashed into buckets.  What the buckets
hold in all documents and in all target texts gives each bucket a gain; a document's
weight is the mean gain of its features, and noise from a hash of its id makes of the
weights a draw without replacement: the documents with the highest scores are drawn.

Weights come from arrays: one gather and one sum by row for a whole batch.  Each task
sorts its eligible rows into runs of `RUN` rows, which are written out.  Scores are
whole numbers, and there are at most some hundred thousand different ones, however many documents
there are: their counts tell exactly how many are drawn and the least score that can
be.  Rows of lower scores are done then.  The others are dealt into ranges of the order,
and each range's slices of the runs meet in a task that merges them with a tournament
tree, which stops when the range's share of the draw is out.  Ranks go on from range to range.
So no task holds more than a range, and ties are as any other rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import integral, written
from .flat import LOWER, Words, buffer, gather, slices

BUCKETS = 10_000
#: Features are runs of up to so many words.
LONGEST = 1
#: Documents of fewer words are not eligible; of 100 eligible ones so many are drawn.
LEAST_WORDS, PERCENT = 20, 10
SEED = 2024
#: Rows of a sorted run, which a task holds at once, and of a range, which a merge holds, about.
RUN, RANGE = 1 << 16, 1 << 17
#: Longer features are hashed one by one, as the side-by-side pass takes a step for each byte.
_LONG = 48
#: What words consist of, when A to Z are lower-cased: all but [\x00-\x2F\x3A-\x60\x7B-\x7F].
_SOLID = np.ones(256, bool)
_SOLID[0x00:0x30] = _SOLID[0x3A:0x61] = _SOLID[0x7B:0x80] = False


def _crc_table() -> np.ndarray:
    """For each byte, what eight steps of the reflected polynomial make of it."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ (out >> 1)
    return out


_CRC = _crc_table()


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of each byte range: a step takes one byte of all ranges that still have one."""
    size = end - start
    out = np.full(len(start), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] <= _LONG]
    at, left = start[order], -size[order]  # ascending, so that those with a k-th byte stand in front
    state = out[order]
    for k in range(-left[0] if len(left) else 0):
        m = int(np.searchsorted(left, -k))
        state[:m] = _CRC[(state[:m] ^ data[at[:m] + k]) & 0xFF] ^ (state[:m] >> np.uint32(8))
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > _LONG):
        out[i] = zlib.crc32(data[start[i] : end[i]])
    return out


def features(texts: pa.Array, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket and the row of each feature, with repeats, and the number of words of each row."""
    data, off = buffer(texts)
    data = LOWER[data]
    words = Words(data, off, _SOLID)
    parts = [(crc32(data, words.start, words.end), words.row)]
    if longest > 1:  # words with one space between, so that each run of them is a range of bytes
        spaced = gather(np.concatenate((data, [np.uint8(32)])), np.stack((words.start, np.full_like(words.start, len(data))), 1).ravel(), np.stack((words.end, np.full_like(words.end, len(data) + 1)), 1).ravel())
        joined = np.frombuffer(spaced.buffers()[2], np.uint8)
        first = np.concatenate(([0], np.cumsum(words.end - words.start + 1)))
        for n in range(2, longest + 1):
            at = np.flatnonzero(words.row[: max(0, len(words.row) - n + 1)] == words.row[n - 1 :])
            parts.append((crc32(joined, first[at], first[at + n] - 1), words.row[at]))
    key, row = (np.concatenate(x) for x in zip(*parts, strict=True))
    return key % np.uint32(buckets), row, words.count


def histogram(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket.  A task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            total += np.bincount(features(batch["text"], longest, buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: 1000 times the log of its smoothed share in the target over that in the source, floored."""
    s, t, n = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def noise(ids: list[int | None], seed: int = SEED) -> np.ndarray:
    """Gumbel noise in thousandths from a hash of each id; a null id is hashed as no digits at all."""
    h = np.array([int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16) for i in ids], float)
    return np.floor(-1000 * np.log(-np.log((h + 0.5) / 4294967296))).astype(np.int64)


def scored(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight and score of each row; run and place of eligible ones, in sorted runs of at most RUN rows.

    A text without a word, as a null or an empty one, has no features and the weight 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    names = ["doc_id", "n_features", "weight", "score", "run", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number = TaskContext.get().partitionId() << 32

        def ordered() -> pa.RecordBatch:
            nonlocal number, held
            rows = pa.Table.from_batches(held).sort_by([("score", "descending"), ("doc_id", "ascending")]).combine_chunks()
            n, held, number = rows.num_rows, [], number + 1
            return pa.RecordBatch.from_arrays([*(rows[c].combine_chunks() for c in names[:4]), pa.array(np.full(n, number - 1)), pa.array(np.arange(n))], names)

        for batch in slices(batches):
            bucket, row, words = features(batch["text"], longest, len(shared.value))
            n = np.bincount(row, minlength=batch.num_rows)
            total = np.bincount(row, shared.value[bucket], batch.num_rows).astype(np.int64)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            ids = batch["doc_id"].cast(pa.int64())
            rows = pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), pa.array(weight), pa.array(weight + noise(ids.to_pylist(), seed))], names[:4])
            fit = words >= least
            if not fit.all():
                rest = rows.filter(pa.array(~fit))
                yield pa.RecordBatch.from_arrays([*rest.columns, *(pa.nulls(rest.num_rows, pa.int64()),) * 2], names)
            held.append(rows.filter(pa.array(fit)))
            if sum(x.num_rows for x in held) >= RUN:
                yield ordered()
        if sum(x.num_rows for x in held):
            yield ordered()

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{c} long" for c in names))


class Tournament:
    """A tournament of losers over sorted lists: each take gives the place of the least head, in log k matches.

    Of equal heads that of the earlier list comes first.
    """

    def __init__(self, runs: list[list]):
        self.runs, self.at = runs, [0] * len(runs)
        self.leaves = 1 << max(0, len(runs) - 1).bit_length()
        self.lost = [-1] * self.leaves
        won = [*([-1] * self.leaves), *(k if k < len(runs) and runs[k] else -1 for k in range(self.leaves))]
        for node in range(self.leaves - 1, 0, -1):
            won[node], self.lost[node] = self._match(won[2 * node], won[2 * node + 1])
        self.best = won[1]

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two lists; -1 is one without a head."""
        if a < 0 or b < 0:
            return (a, b) if b < 0 else (b, a)
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return (a, b) if x < y or (x == y and a < b) else (b, a)

    def take(self) -> tuple[int, int] | None:
        """The list and the place in it of the least head that is left."""
        k = self.best
        if k < 0:
            return None
        place = self.at[k]
        self.at[k] += 1
        up = k if self.at[k] < len(self.runs[k]) else -1
        node = (self.leaves + k) >> 1
        while node:
            up, self.lost[node] = self._match(up, self.lost[node])
            node >>= 1
        self.best = up
        return k, place


def drawn(rows: pa.Table, offset: int, quota: int) -> pa.Table:
    """The rows of one range with rank: the first `quota` of the order get offset + 1 and so on, the rest null."""
    rows = rows.sort_by([("run", "ascending"), ("place", "ascending")]).combine_chunks()
    run = rows["run"].to_numpy()
    cut = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))) if len(run) else np.zeros(0, int)
    keys = list(zip((-rows["score"].to_numpy()).tolist(), rows["doc_id"].is_null().to_pylist(), rows["doc_id"].fill_null(0).to_pylist(), strict=True))
    ends = [*cut[1:].tolist(), len(run)]
    tree = Tournament([keys[a:b] for a, b in zip(cut.tolist(), ends, strict=True)])
    rank = np.zeros(len(run), np.int64)
    for k in range(1, quota + 1):
        at = tree.take()
        rank[cut[at[0]] + at[1]] = offset + k
    return rows.append_column("rank", pa.array(rank, mask=rank == 0))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, longest: int = LONGEST, buckets: int = BUCKETS, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs (doc_id, text), drawn towards target (text).

    rank is 1 for the highest score; of equal scores the smaller doc_id comes first, a null one
    last; rows equal in both follow each other in no order of their own.  Rows that are not drawn have none.
    Without target texts all gains come from the source alone; without documents there are no rows.
    """
    spark = docs.sparkSession
    gain = gains(histogram(integral(docs), longest, buckets), histogram(target, longest, buckets))
    table = written(scored(docs, gain, longest, least, seed))
    by_score = table.where("run IS NOT NULL").groupBy("score").count().toArrow().sort_by([("score", "descending")])
    so_far = np.cumsum(by_score["count"].to_numpy())
    draws = int(so_far[-1]) * percent // 100 if len(so_far) else 0
    out = ["doc_id", "n_features", "weight", "score"]
    if not draws:
        return table.select(*out, F.lit(None).cast("long").alias("rank"))
    last = int(np.searchsorted(so_far, draws))
    floor, reach = by_score["score"][last].as_py(), int(so_far[last])
    able = F.col("run").isNotNull() & (F.col("score") >= floor)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-reach // RANGE))
    ranges = table.where(able).repartitionByRange(parts, F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "run", "place")
    ranges = written(ranges.withColumn("part", F.spark_partition_id()))
    sizes = ranges.groupBy("part").count().toArrow().sort_by("part")
    ends = np.cumsum(sizes["count"].to_numpy())
    begins = dict(zip(sizes["part"].to_pylist(), (ends - sizes["count"].to_numpy()).tolist(), strict=True))

    def merge(rows: pa.Table) -> pa.Table:
        offset = begins[rows["part"][0].as_py()]
        return drawn(rows, offset, max(0, min(rows.num_rows, draws - offset))).select([*out, "rank"])

    ranked = ranges.groupBy("part").applyInArrow(merge, ", ".join(f"{c} long" for c in [*out, "rank"]))
    return table.where(~able).select(*out, F.lit(None).cast("long").alias("rank")).unionByName(ranked)


def op13(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's result: every document with its weight, score and rank, drawn towards benchmark."""
    return resample(docs, benchmark)


#: The same rows in SQL: crc32 by a fold over the bytes of each different word.
SQL = r"""
WITH steps AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
own AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
aim AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
each AS (SELECT r, unnest(words) AS word FROM own),
names AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM each UNION SELECT word FROM aim)),
hashed AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 AS bucket FROM names, steps),
s AS (SELECT bucket, count(*) AS n FROM each JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM aim JOIN hashed USING (word) GROUP BY bucket),
sums AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS s_all, coalesce((SELECT sum(n) FROM t), 0)::DOUBLE AS t_all),
gain AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + 10000) / ((s.n + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS g FROM s LEFT JOIN t USING (bucket), sums),
w AS (SELECT r, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM each JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r),
k AS (SELECT own.r, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM own LEFT JOIN w USING (r)),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, (count(*) OVER ()) * 10 // 100 AS draws FROM k WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= draws THEN place END::BIGINT AS rank FROM k LEFT JOIN ranked USING (r)
"""
