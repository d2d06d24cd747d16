"""Mixing sources to target weights, by blocks and index permutations.

The words of each source are packed into blocks of fixed length, in an order of
the documents that a hash of their ids gives.  Output shards draw how many slots
each source gets from a multinomial over what is left of the targets, so the
totals come out at the targets.  A source's n-th slot goes to the block that a
pseudorandom permutation of the source's block indexes names: a swap-or-not
shuffle, which is a bijection for any number of blocks and needs no table.  Slots
and blocks meet in an equi-join on the index.

Everything but the cutting of texts runs on the JVM.  Positions within a source
come from two sums, within buckets of documents and over the buckets' totals; a
source has as many buckets as the square root of all rows, so both sums are over
few rows even for a source with a third of them.  On the driver are one row per source and one
per shard and source, with at most `MOST_SHARDS` shards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import WORD, integral, packed, quoted, scratch, unpacked, written
from .flat import Words, buffer, slices

#: Words in a block, slots in a shard, shards at most, rounds of the permutation.
BLOCK, SHARD_SLOTS, MOST_SHARDS, ROUNDS = 64, 1 << 16, 1024, 6
#: The mix: weights of the sources in order, repeating; share of all words; how often a source may be taken.
WEIGHTS, SHARE, MOST_TIMES = (5, 2, 1), 1.5, 2.0
#: Slots in a range that one row expands to.
RANGE = 1 << 14
SEED = 7


@dataclass
class Source:
    rank: int
    name: str | None
    size: int
    weight: float
    target: float

    @property
    def words(self) -> int:
        """Words to take."""
        return int(self.target + 0.5) if self.size else 0

    @property
    def full(self) -> int:
        return self.size // BLOCK

    @property
    def blocks(self) -> int:
        return -(-self.size // BLOCK)

    @property
    def slots(self) -> int:
        """Slots that take just the words: whole passes over the blocks, then part of one."""
        if not self.size:
            return 0
        passes, rest = divmod(self.words, self.size)
        return passes * self.blocks + (-(-rest // BLOCK) if rest <= self.full * BLOCK else self.blocks)


def targets(sizes: list[int], weights: list[float], total: float, most: float = MOST_TIMES) -> list[float]:
    """total shared by weight, no share above `most` times its size; the excess is reshared by weight until none is."""
    out, free = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s]
    left = total
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def sources(sizes: dict[str | None, int]) -> list[Source]:
    """The sources in order of code points, null last, with their targets."""
    names = sorted(sizes, key=lambda x: (x is None, (x or "").encode("utf-8", "surrogatepass")))
    weights = [float(WEIGHTS[i % len(WEIGHTS)]) for i in range(len(names))]
    own = [sizes[x] for x in names]
    goal = targets(own, weights, SHARE * sum(own))
    return [Source(i, x, own[i], weights[i], goal[i]) for i, x in enumerate(names)]


def shards(slots: list[int], seed: int = SEED) -> list[tuple[int, int, int, int]]:
    """(shard, source, first slot, number) of each shard's draw.

    A shard draws from a multinomial whose chances are the slots that the sources
    have left; where that is more than a source has, the others make it up.  So
    each source's slots are all dealt out.
    """
    r, left = np.random.default_rng(seed), np.array(slots, np.int64)
    total = int(left.sum())
    n = min(MOST_SHARDS, max(1, ceil(total / SHARD_SLOTS)))
    out, first = [], np.zeros(len(left), np.int64)
    for shard in range(n):
        size = int(left.sum()) - total * (n - 1 - shard) // n
        drawn = np.zeros(len(left), np.int64)
        while (rest := size - int(drawn.sum())) > 0:
            free = left - drawn
            drawn += np.minimum(r.multinomial(rest, free / free.sum()), free)
        out += [(shard, int(s), int(first[s]), int(drawn[s])) for s in np.flatnonzero(drawn)]
        first += drawn
        left -= drawn
    return out


def permuted(df: DataFrame, index: str, size: str, key: Column, out: str, rounds: int = ROUNDS) -> DataFrame:
    """Adds column out: index's image under a permutation of 0 .. size-1 that key names (swap-or-not)."""
    df = df.withColumn(out, F.col(index))
    for k in range(rounds):
        offset = F.pmod(F.xxhash64(key, F.lit(2 * k)), F.col(size))
        df = df.withColumn("_partner", F.pmod(offset - F.col(out) + F.col(size), F.col(size)))
        bit = F.pmod(F.xxhash64(key, F.lit(2 * k + 1), F.greatest(out, "_partner")), F.lit(2))
        df = df.withColumn(out, F.when(bit == 1, F.col("_partner")).otherwise(F.col(out)))
    # Not null by its type: else the join on it would infer a null test and repeat all rounds in it.
    return df.withColumn(out, F.coalesce(out, F.lit(0).cast("long"))).drop("_partner")


class Mix:
    """The mix of docs (doc_id, text, source): sizes, plan and takes, as DataFrames.

    rows: _row (a number of the row), doc_id, source, size.  Rows with the same id
    stay apart; equal rows are interchangeable.  Null and empty texts have size 0
    and are in no block; an empty table gives empty results.

    row: the column that tells rows apart, if there is one; equal rows may share
    its value.  put: writes the rows for later use.
    """

    def __init__(self, docs: DataFrame, seed: int = SEED, row: str | None = None, put: Callable[[DataFrame], DataFrame] = written):
        spark = integral(docs).sparkSession
        number = F.col(row) if row else F.monotonically_increasing_id()
        # The number of a row must be the same when a lost task is done again: it is written before it is used.
        self.rows = put(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("_text"), number.alias("_row")))
        found = self.rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        self.sources = sources({r["source"]: r["size"] for r in found})
        # A local relation tells its size, so that Spark broadcasts it when it is small and only then.
        own = self.sources
        self.table = spark.createDataFrame(
            pa.table(
                {"_source": pa.array([x.rank for x in own], pa.int64()), "source": pa.array([x.name for x in own], pa.string()), "source_size": pa.array([x.size for x in own], pa.int64()), "target": pa.array([x.target for x in own], pa.float64())}
                | {"_words": pa.array([x.words for x in own], pa.int64()), "_full": pa.array([x.full for x in own], pa.int64()), "_blocks": pa.array([x.blocks for x in own], pa.int64())}
            )
        )
        self.buckets = max(16, isqrt(sum(r["n"] for r in found)))
        self.dealt = shards([s.slots for s in self.sources], seed)
        self.seed = seed

    def placed(self) -> DataFrame:
        """Rows with words: _row, _source and _start, the place of the first word in the source."""
        # By the text too: rows without an id, or with one and the same, are no bucket of their own.
        bucket = F.pmod(F.xxhash64("doc_id", "_text", F.lit(self.seed)), F.lit(self.buckets))
        ranks = self.table.select("_source", F.col("source").alias("_name"))
        rows = self.rows.where(F.col("size") > 0).withColumn("_bucket", bucket).join(ranks, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
        sums = rows.groupBy("_source", "_bucket").agg(F.sum("size").alias("_sum"))
        base = sums.withColumn("_base", F.sum("_sum").over(Window.partitionBy("_source").orderBy("_bucket")) - F.col("_sum")).drop("_sum")
        within = Window.partitionBy("_source", "_bucket").orderBy(F.xxhash64("doc_id", "_text", F.lit(self.seed)), "doc_id", "_text", "size", "_row").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_within", F.sum("size").over(within) - F.col("size"))
        return rows.join(base, ["_source", "_bucket"]).select("_row", "_source", "size", (F.col("_base") + F.col("_within")).alias("_start"))

    def blocks(self) -> DataFrame:
        """_source, _block, _row, _start, and which words of the row are where in the block: _from (in the row), _at (in the block), _n."""
        end = F.col("_start") + F.col("size")
        rows = self.placed().withColumn("_block", F.explode(F.sequence(F.expr(f"_start div {BLOCK}"), F.expr(f"(_start + size - 1) div {BLOCK}"))))
        first = F.greatest(F.col("_start"), F.col("_block") * BLOCK)
        return rows.select("_source", "_block", "_row", "_start", (first - F.col("_start")).alias("_from"), (first - F.col("_block") * BLOCK).alias("_at"), (F.least(end, (F.col("_block") + 1) * BLOCK) - first).alias("_n"))

    def slots(self) -> DataFrame:
        """_source, _block, _shard, _slot (in the source), _pass, and _take: the words that the slot takes of the block."""
        spark = self.rows.sparkSession
        names = ("_shard", "_source", "_first", "_count")
        wide = spark.createDataFrame(pa.table({k: pa.array([x[i] for x in self.dealt], pa.int64()) for i, k in enumerate(names)}))
        step = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_count - 1) div {RANGE}"))).alias("_k")
        ranges = wide.select("*", step).select("_shard", "_source", (F.col("_first") + F.col("_k") * RANGE).alias("_first"), F.least(F.lit(RANGE).cast("long"), F.col("_count") - F.col("_k") * RANGE).alias("_count"))
        one = ranges.select("_shard", "_source", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_count") - 1)).alias("_slot")).join(self.table.select("_source", "source_size", "_words", "_full", "_blocks"), "_source")
        one = one.withColumn("_pass", F.expr("_slot div _blocks")).withColumn("_i", F.col("_slot") % F.col("_blocks")).withColumn("_span", F.greatest(F.col("_full"), F.lit(1)))
        one = permuted(one, "_i", "_span", F.xxhash64("_source", "_pass", F.lit(self.seed)), "_image")
        length = F.when(F.col("_i") < F.col("_full"), F.lit(BLOCK)).otherwise(F.col("source_size") - F.col("_full") * BLOCK)
        before = F.col("_pass") * F.col("source_size") + F.col("_i") * BLOCK
        return one.select("_source", F.coalesce(F.when(F.col("_i") < F.col("_full"), F.col("_image")).otherwise(F.col("_i")), F.lit(0).cast("long")).alias("_block"), "_shard", "_slot", "_pass", F.least(length, F.col("_words") - before).alias("_take"))

    def takes(self) -> DataFrame:
        """_row, _start, _shard, _slot, _pass, _from and _words: the words of each row that each slot takes."""
        both = self.blocks().join(self.slots(), ["_source", "_block"]).withColumn("_words", F.least("_n", F.col("_take") - F.col("_at")))
        return both.where(F.col("_words") > 0).select("_row", "_start", "_shard", "_slot", "_pass", "_from", "_words")


def texts(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix of docs itself, with the columns of docs: a row for each document and pass over its source that takes any of its words.

    text has the words taken in their order, with what stood between neighbours;
    line feeds join parts that were apart.  n_chars, where there is such a column,
    is that of the new text.  Rows are met by a hash of all their columns, so none
    may be a map.
    """
    key = F.xxhash64(*(F.col(quoted(c)) for c in docs.columns))
    with scratch(docs.sparkSession) as put:
        mix = Mix(docs.select("doc_id", "text", "source", key.alias("_row")), seed, "_row", put)
        twice = not mix.rows.groupBy("_row").agg(F.count("*").alias("_n")).where("_n > 1").isEmpty()
        # Equal rows are taken apart by where they start.
        takes = mix.takes().groupBy("_row", "_start", "_pass").agg(F.sort_array(F.collect_list(F.struct("_from", "_words"))).alias("_parts"))
        parts = written(takes.select("_row", "_parts"))
    rows = packed(docs).withColumn("_key", F.xxhash64(*(F.col("_all").getField(c) for c in docs.columns)))
    if twice:
        rows = rows.dropDuplicates(["_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_all.text"):
            words = Words(*buffer(batch["_all"].field("text")))
            data = words.data.tobytes()
            out = []
            for first, own in zip(words.first[:-1].tolist(), batch["_parts"].to_pylist(), strict=True):
                spans: list[list[int]] = []
                for x in own:
                    a, b = first + x["_from"], first + x["_from"] + x["_words"]
                    if spans and spans[-1][1] == a:
                        spans[-1][1] = b
                    else:
                        spans.append([a, b])
                out.append(b"\n".join(data[words.start[a] : words.end[b - 1]] for a, b in spans).decode())
            yield pa.RecordBatch.from_arrays([batch["_all"], pa.array(out, pa.string())], ["_all", "_new"])

    joined = rows.join(parts, F.col("_key") == F.col("_row")).select("_all", "_parts")
    out = joined.mapInArrow(run, StructType([joined.schema["_all"], StructField("_new", StringType())]))
    new = {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("_new").cast(docs.schema["n_chars"].dataType)
    return unpacked(out, docs.columns, **new)


def op9(docs: DataFrame) -> DataFrame:
    """The contract's result: doc_id, size, source_size, target, taken for every document."""
    mix = Mix(docs)
    taken = mix.takes().groupBy("_row").agg(F.sum("_words").alias("taken"))
    table = mix.table.select(F.col("source").alias("_name"), "source_size", "target")
    return (
        mix.rows.join(table, F.col("source").eqNullSafe(F.col("_name")))
        .join(taken, "_row", "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )
