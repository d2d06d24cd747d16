"""SentencePiece encoding and decoding as relations.

Text becomes units: parts between which no piece can reach, because no piece has
the two bytes that meet there.  Each different unit is encoded once: its
substrings of bounded length are exploded and equi-joined to the piece table;
the edges found are grouped by unit, and a higher-order aggregate folds them,
sorted by their ends, into the best path (Viterbi over the pieces' scores).  A
character without a piece is an edge that becomes byte pieces.

The most frequent units, at most `SHARED` and none longer than `SHARED_CHARS`, are
broadcast and looked up where the text is; the others meet their encodings in a join.

The model file's pieces and scores are taken as they are and never trained.
Where the file is of the BPE kind, its scores are ranks, and the path with the
best sum of them differs from the library's merges in many words; decoding gives
the text all the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import integral, quoted, scratch, written
from .flat import SLICE_BYTES, Lookup, buffer, gather, mix, slices, span_hash, trim

MODEL = "piece_bpe_32k.model"
#: Units that are broadcast: so many at most, of so many characters at most, hence of bounded size.
SHARED, SHARED_CHARS = 1_000_000, 64
#: A piece table of more rows is not broadcast to the join of substrings.
MOST_PIECES = 1_000_000
#: Units in one partition of the lattice, about: bounds what the grouping holds.
UNITS = 20_000
#: Below the least score by so much: a character that has no piece (fixed value).
UNKNOWN = 10.0
SPACE = "▁"
#: In a link of the best path: bits for the id, and what is added to it, as a character without a piece has the negated code point.
_ID_BITS, _ID_ADD = 26, 1 << 21
#: Characters of a part of a unit, whose edges one fold takes: Spark copies the state of a fold at each step.
PART = 256
#: A text with more rows than this, and than one in HOT_SHARE of all rows, is dealt to several tasks.
HOT, HOT_SHARE = 1_000, 10_000
#: Texts are compressed so much while they are shuffled.
LEVEL = 3
#: Of the digest: places of pieces count modulo this.
PRIME = 1_000_003


def default_path() -> str:
    """The model's path among the installed public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path(MODEL))


class Table:
    """Pieces of a model file: ids, scores, bytes, and which bytes can meet within a piece."""

    def __init__(self, path: str | None = None):
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path or default_path())
        kinds = [(i, m.id_to_piece(i)) for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.byte = np.full(256, m.unk_id(), np.int32)
        for i, p in kinds:
            if m.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
        self.rows = [(p, i, m.get_score(i)) for i, p in kinds if not m.is_byte(i)]
        self.longest = max((len(p) for p, _, _ in self.rows), default=1)
        self.unknown = min((s for _, _, s in self.rows), default=0.0) - UNKNOWN
        parts = [b""] * m.vocab_size()
        for i, p in kinds:
            parts[i] = bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace(SPACE, " ").encode()
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.first = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        # meets[a, b]: no cut between the bytes a and b.  A continuation byte never begins a character.
        self.meets = np.zeros((256, 256), bool)
        self.meets[:, 0x80:0xC0] = True
        for p, _, _ in self.rows:
            b = p.replace(SPACE, " ").encode()
            self.meets[list(b[:-1]), list(b[1:])] = True

    def frame(self, spark: SparkSession) -> DataFrame:
        """piece string, id int, score double."""
        cols = list(zip(*self.rows, strict=True)) or [[], [], []]
        return spark.createDataFrame(pa.table({"piece": pa.array(cols[0], pa.string()), "id": pa.array(cols[1], pa.int32()), "score": pa.array(cols[2], pa.float64())}))

    def decode(self, ids: np.ndarray, size: np.ndarray) -> pa.Array:
        """The bytes of each list of ids (flat ids, sizes of the lists), with spaces for the space sign."""
        start, end = self.first[ids], self.first[ids + 1]
        ends = np.concatenate(([0], np.cumsum(end - start)))
        at = np.concatenate(([0], np.cumsum(size)))
        _, off, data = gather(self.bytes, start, end).buffers()
        off = ends[at]
        return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off.astype(np.int64).tobytes()), data])


class Units:
    """Units of a column: a text that is not empty gets a space in front; then it is cut where no piece can reach across."""

    def __init__(self, texts: pa.Array, meets: np.ndarray):
        data, off = buffer(texts)
        if SPACE.encode() in data.tobytes():  # the space sign itself is a space to the model
            data, off = buffer(pc.replace_substring(texts.cast(pa.large_string()), SPACE, " "))
        some = np.diff(off) > 0
        shift = np.cumsum(some)
        self.off = off + np.concatenate(([0], shift))
        out = np.full(len(data) + int(some.sum()), 32, np.uint8)
        out[np.arange(len(data)) + np.repeat(shift, np.diff(off))] = data
        edge = np.zeros(len(out) + 1, bool)
        edge[self.off] = True
        if len(out):
            edge[1:-1] |= ~meets[out[:-1], out[1:]]
        cut = np.flatnonzero(edge)
        self.data, self.start, self.end = out, cut[:-1], cut[1:]
        self.first = np.searchsorted(self.start, self.off)
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        self.place = np.arange(len(self.start)) - np.repeat(self.first[:-1], np.diff(self.first))
        self.hash = span_hash(out, self.start, self.end)


def count_units(docs: DataFrame, table: Table) -> DataFrame:
    """unit string and n long over all texts."""
    meets = docs.sparkSession.sparkContext.broadcast(table.meets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            u = Units(batch["text"], meets.value)
            _, at, n = np.unique(u.hash, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([gather(u.data, u.start[at], u.end[at]).cast(pa.string()), pa.array(n)], ["unit", "n"])

    return docs.select("text").mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def _name(unit: str = "unit") -> tuple[Column, Column]:
    """Two hashes that stand for a unit where its text would travel with every edge."""
    return F.xxhash64(unit).alias("_u"), F.xxhash64(F.lit("unit"), unit).alias("_v")


def lattice(units: DataFrame, table: Table, long: bool = False) -> DataFrame:
    """_u, _v (of the unit) and parts: for each PART characters the array of edges (e, b, s, id) that end there, sorted; the piece from character b to e has score s.

    units: unit string, _u, _v, each once, hash-partitioned by _u and _v; the grouping
    then needs no shuffle.  long: units may have more than one part.  A unit is cut into windows first, which go on far enough
    for each piece that begins in them, so that no substring is looked for from far away.
    """
    spark = units.sparkSession
    pieces = table.frame(spark)
    pieces = F.broadcast(pieces) if len(table.rows) <= MOST_PIECES else pieces
    word = units.select("_u", "_v", F.replace("unit", F.lit(" "), F.lit(SPACE)).alias("_w")).withColumn("_n", F.char_length("_w"))
    word = word.select("_u", "_v", "_w", "_n", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(PART))).alias("_at"))
    word = word.select("_u", "_v", "_at", F.substring("_w", F.col("_at") + 1, F.lit(PART + table.longest - 1)).alias("_w"), F.least(F.lit(PART), F.col("_n") - F.col("_at")).alias("_n"))
    starts = word.select("_u", "_v", "_at", "_w", F.char_length("_w").alias("_n"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("b"))
    spans = starts.select("_u", "_v", "_at", "_w", "b", F.explode(F.sequence(F.lit(1), F.least(F.lit(table.longest), F.col("_n") - F.col("b")))).alias("_l"))
    spans = spans.select("_u", "_v", (F.col("_at") + F.col("b")).alias("b"), "_l", F.substring("_w", F.col("b") + 1, F.col("_l")).alias("piece"))
    edges = spans.join(pieces, "piece", "left").where(F.col("id").isNotNull() | (F.col("_l") == 1))
    unknown = -F.call_function("ascii", F.col("piece"))
    edge = F.struct((F.col("b") + F.col("_l")).alias("e"), "b", F.coalesce("score", F.lit(table.unknown)).alias("s"), F.coalesce("id", unknown).alias("id"))
    edges = edges.select("_u", "_v", edge.alias("_edge"), F.floor((F.col("b") + F.col("_l") - 1) / PART).alias("_part"))
    if not long:
        return edges.groupBy("_u", "_v").agg(F.array(F.sort_array(F.collect_list("_edge"))).alias("parts"))
    parts = edges.groupBy("_u", "_v", "_part").agg(F.sort_array(F.collect_list("_edge")).alias("_edges"))
    return parts.groupBy("_u", "_v").agg(F.transform(F.sort_array(F.collect_list(F.struct("_part", "_edges"))), lambda x: x["_edges"]).alias("parts"))


def viterbi(parts: Column, longest: int) -> Column:
    """ids of the best path over the edges of a unit; a character without a piece is the negated code point.

    A fold over the parts, and in it one over a part's edges.  The state has the
    scores of the last `longest` ends, for no edge goes further back, the best edge
    so far to the end at hand, and the links of the part's ends that are done.  Of
    equal scores the longest last piece stays.
    """
    link = lambda b, i: b.cast("long") * (1 << _ID_BITS) + i + _ID_ADD
    none = lambda kind: F.array().cast(f"array<{kind}>")

    def state(near: Column, links: Column, e: Column, s: Column, l: Column) -> Column:  # noqa: E741
        return F.struct(near.alias("near"), links.alias("links"), e.alias("e"), s.alias("s"), l.alias("l"))

    def step(a: Column, x: Column) -> Column:
        score = F.when(x["b"] == a["e"], a["s"]).otherwise(F.get(a["near"], x["b"] - a["e"] + F.size(a["near"]))) + x["s"]
        near = F.when(F.size(a["near"]) < longest, F.array_append(a["near"], a["s"])).otherwise(F.array_append(F.slice(a["near"], 2, longest - 1), a["s"]))
        better = state(a["near"], a["links"], a["e"], score, link(x["b"], x["id"]))
        onward = state(near, F.array_append(a["links"], a["l"]), x["e"], score, link(x["b"], x["id"]))
        return F.when(x["e"] != a["e"], onward).when(score > a["s"], better).otherwise(a)

    def part(o: Column, edges: Column) -> Column:
        begin = state(o["near"], none("bigint"), o["e"], o["s"], o["l"])
        return F.aggregate(edges, begin, step, lambda a: state(a["near"], F.array_append(o["links"], a["links"]), a["e"], a["s"], a["l"]))

    def back(o: Column) -> Column:
        """From the last end: each link on the path names the end that comes before it."""

        def at(at_: Column, i: Column, out: Column) -> Column:
            return F.struct(at_.alias("at"), i.alias("i"), out.alias("out"))

        def take(t: Column, own: Column) -> Column:
            hit = at(F.shiftright(own, _ID_BITS).cast("int"), t["i"] - 1, F.array_append(t["out"], (own.bitwiseAND((1 << _ID_BITS) - 1) - _ID_ADD).cast("int")))
            return F.when((t["i"] == t["at"]) & (t["i"] > 0), hit).otherwise(at(t["at"], t["i"] - 1, t["out"]))

        def some(t: Column, links: Column) -> Column:
            return F.aggregate(F.reverse(links), at(t["at"], t["i"], none("int")), take, lambda a: at(a["at"], a["i"], F.array_append(t["out"], a["out"])))

        links = F.reverse(F.array_append(o["links"], F.array(o["l"])))
        return F.aggregate(links, at(o["e"], o["e"], none("array<int>")), some, lambda t: F.reverse(F.flatten(t["out"])))

    zero = state(none("double"), none("array<bigint>"), F.lit(0), F.lit(0.0), F.lit(0).cast("long"))
    return F.aggregate(parts, zero, part, back)


def with_bytes(ids: Column, byte: np.ndarray) -> Column:
    """ids with the byte pieces of characters that have no piece."""
    table = F.array(*(F.lit(int(x)) for x in byte))
    piece = lambda b: F.get(table, b)
    tail = lambda c, k: (F.shiftright(c, 6 * k).bitwiseAND(F.lit(63)) + 128).cast("int")

    def expand(x: Column) -> Column:
        c = -x
        return (
            F.when(x >= 0, F.array(x))
            .when(c < 0x80, F.array(piece(c)))
            .when(c < 0x800, F.array(piece(F.shiftright(c, 6) + 0xC0), piece(tail(c, 0))))
            .when(c < 0x10000, F.array(piece(F.shiftright(c, 12) + 0xE0), piece(tail(c, 1)), piece(tail(c, 0))))
            .otherwise(F.array(piece(F.shiftright(c, 18) + 0xF0), piece(tail(c, 2)), piece(tail(c, 1)), piece(tail(c, 0))))
        )

    return F.when(F.exists(ids, lambda x: x <= 0), F.flatten(F.transform(ids, expand))).otherwise(ids)


def encodings(docs: DataFrame, table: Table, written: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """unit, n and ids of every different unit of the texts; written."""
    spark = docs.sparkSession
    units = written(count_units(docs, table))
    parts = max(1, math.ceil(units.count() / UNITS))
    # In two ways, as most units have one part and need one grouping.
    short = F.char_length("unit") <= PART
    grouped = lattice(units.where(short).select("unit", *_name()).repartition(parts, "_u", "_v"), table)
    grouped = grouped.union(lattice(units.where(~short).select("unit", *_name()).repartition(parts, "_u", "_v"), table, long=True))
    # A partition has about UNITS groups, which fit in memory; without this, grouping sorts after 128.
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, str(8 * UNITS))
    try:
        # A column of its own: the path would else be found again for each place that it is used in.
        paths = grouped.select("_u", "_v", viterbi(F.col("parts"), table.longest).alias("ids"))
        found = written(paths.select("_u", "_v", with_bytes(F.col("ids"), table.byte).alias("ids")))
    finally:
        spark.conf.set(name, before)
    return units.select("unit", "n", *_name()).join(found, ["_u", "_v"]).drop("_u", "_v")


class Codes:
    """Encodings by unit hash: number of pieces, where they begin, and the ids one after another."""

    def __init__(self, hashes: np.ndarray, ids: pa.Array):
        size = np.asarray(pc.list_value_length(ids), np.int32)
        self.table = Lookup(hashes.view(np.uint64), size, np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int32))
        self.ids = np.array(ids.flatten(), np.int32)


def _shared(coded: DataFrame) -> tuple[Codes, Column]:
    """The encodings of the most frequent units, and the condition that tells them."""
    short = F.char_length("unit") <= SHARED_CHARS
    sizes = coded.where(short).groupBy(F.floor(F.log2("n") * 8).alias("_b")).agg(F.count("*").alias("units"), F.min("n").alias("least")).orderBy(F.desc("_b")).collect()
    least, held = None, 0
    for r in sizes:
        held += r["units"]
        if held > SHARED or not r["_b"]:  # a unit that occurs once is not worth sending to every task
            break
        least = r["least"]
    own = short & (F.col("n") >= least) if least else F.lit(False)
    # Units are hashed where they are: the driver gets no texts, and needs no room to hash them.
    wide = _hashed(coded.where(own)).toArrow()
    codes = Codes(wide["_hash"].to_numpy(), wide["ids"].combine_chunks() if wide.num_rows else pa.array([], wide.schema.field("ids").type))
    del wide
    trim()
    return codes, own


def _hashed(coded: DataFrame) -> DataFrame:
    """_hash and ids of units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "unit"):
            data, off = buffer(batch["unit"])
            yield pa.RecordBatch.from_arrays([pa.array(span_hash(data, off[:-1], off[1:]).view(np.int64)), batch["ids"]], ["_hash", "ids"])

    return coded.select("unit", "ids").mapInArrow(run, "_hash long, ids array<int>")


def _salted(rows: DataFrame) -> list[tuple[int, int, int]]:
    """Of texts (by their hashes _k, _l) that so many rows have that one task should not get them all: both hashes, and how many tasks should.

    At most so many texts as `HOT_SHARE` says, so they can be broadcast.
    """
    counts = rows.groupBy("_k", "_l").agg(F.count("*").alias("_n"))
    with scratch(rows.sparkSession) as put:
        counts = put(counts.where(F.col("_n") > HOT))
        most = max(HOT, rows.count() // HOT_SHARE)
        return [(r["_k"], r["_l"], -(-r["_n"] // most)) for r in counts.where(F.col("_n") > most).collect()]


def _encoded(docs: DataFrame, table: Table, carry: str, finish: Callable[[pa.RecordBatch, pa.Array, pa.ListArray], dict[str, pa.Array]], out: list[StructField]) -> DataFrame:
    """What finish makes of each batch of rows of docs, its texts and their ids; carry: the columns it needs besides, by expression.

    Texts are shuffled once, compressed, to meet the encodings of their rare units;
    rows and encodings meet by two hashes of the text, so nothing of the rows is written.
    """
    sc = docs.sparkSession.sparkContext
    with scratch(docs.sparkSession) as put:
        coded = put(encodings(docs, table, put))
        codes, own = _shared(coded)

        rest = written(_hashed(coded.where(~own)))
    shared, tables = sc.broadcast(codes), sc.broadcast(table)
    keys = (F.xxhash64("text").alias("_k"), F.xxhash64(F.lit("text"), "text").alias("_l"))
    some = F.coalesce(F.col("text") != "", F.lit(False))
    def missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            u = Units(batch["text"], tables.value.meets)
            left = np.flatnonzero(shared.value.table.find(u.hash) < 0)
            if not len(left):
                continue
            _, at = np.unique(u.hash[left] ^ mix(u.row[left].astype(np.uint64)), return_index=True)
            at = left[at]
            of = pa.array(u.row[at])
            yield pa.RecordBatch.from_arrays([batch["_k"].take(of), batch["_l"].take(of), pa.array(u.hash[at].view(np.int64))], ["_k", "_l", "_hash"])

    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in slices(batches):
            packed_ = [pack(x) for x in batch["text"].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["_carry"], batch["_k"], batch["_l"], pa.array(packed_, pa.binary())], ["_carry", "_k", "_l", "_z"])

    def met(docs_: DataFrame, salts: DataFrame | None) -> DataFrame:
        """_carry, _z and _own of rows with their texts' rare units; salts: copies of a text meet them in as many tasks."""
        rare = docs_.select("text", *keys).mapInArrow(missing, "_k long, _l long, _hash long").join(rest, "_hash")
        rare = rare.groupBy("_k", "_l").agg(F.collect_set(F.struct("_hash", "ids")).alias("_own"))
        rows = docs_.select("text", F.expr(carry).alias("_carry"), *keys)
        rows = rows.mapInArrow(squeezed, StructType([rows.schema["_carry"], *(StructField(k, LongType()) for k in ("_k", "_l")), StructField("_z", BinaryType())]))
        on = ["_k", "_l"]
        if salts is not None:
            on = [*on, "_s"]
            rare = rare.join(salts, ["_k", "_l"]).withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
            # The salt is the row's number in its part of the table, the same whenever the part is read again.
            rows = rows.withColumn("_i", F.monotonically_increasing_id()).join(salts, ["_k", "_l"]).withColumn("_s", F.pmod("_i", "_salts").cast("int"))
        return rows.join(rare.select(*on, "_own"), on, "left").select("_carry", "_z", "_own")

    # Texts without units meet nothing.
    with_units = docs.where(some)
    hot = _salted(with_units.select(*keys))
    if hot:
        salts = F.broadcast(docs.sparkSession.createDataFrame(hot, "_k long, _l long, _salts int"))
        is_hot = lambda how: with_units.withColumns({"_k": keys[0], "_l": keys[1]}).join(salts, ["_k", "_l"], how).drop("_k", "_l")
        joined = met(is_hot("left_anti"), None).union(met(is_hot("left_semi"), salts))
    else:
        joined = met(with_units, None)
    without = docs.where(~some).select(F.expr(carry).alias("_carry"), F.col("text").cast("binary").alias("_z"), F.lit(None).cast(joined.schema["_own"].dataType).alias("_own"))
    joined = joined.union(without)

    def unsqueezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "_z", SLICE_BYTES // 4):
            text = pa.array([unpack(x).decode() if x else None if x is None else "" for x in batch["_z"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch["_carry"], text, batch["_own"]], ["_carry", "text", "_own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in slices(unsqueezed(batches)):
            u = Units(batch["text"], tables.value.meets)
            at = c.table.find(u.hash)
            size, first = (np.where(at >= 0, v[at], 0).astype(np.int64) if len(v) else np.zeros(len(at), np.int64) for v in c.table.values)
            own = c.ids
            if (at < 0).any():
                # The rows' own encodings stand behind the shared ones.
                lists = batch["_own"]
                owner = np.repeat(np.arange(batch.num_rows), np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64))
                hashes, inner = (lists.flatten().field(k) for k in ("_hash", "ids"))
                n = np.asarray(pc.list_value_length(inner), np.int64)
                begin = len(own) + np.concatenate(([0], np.cumsum(n)))[:-1]
                own = np.concatenate((own, np.asarray(inner.flatten(), np.int32)))
                key = lambda h, r: mix(h ^ mix(r.astype(np.uint64)))
                look = Lookup(key(np.asarray(hashes, np.int64).view(np.uint64), owner), n, begin)
                left = np.flatnonzero(at < 0)
                place = look.find(key(u.hash[left], u.row[left]))
                if (place < 0).any():
                    raise ValueError("a unit has no encoding: the texts changed between two passes")
                size[left], first[left] = look.values[0][place], look.values[1][place]
            ends = np.concatenate(([0], np.cumsum(size)))
            flat = own[np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)]
            lists = pa.ListArray.from_arrays(pa.array(ends[u.first].astype(np.int32)), pa.array(flat.astype(np.int32)))
            done = finish(batch["_carry"], batch["text"], lists)
            yield pa.RecordBatch.from_arrays(list(done.values()), list(done))

    return joined.mapInArrow(run, StructType(out))


def encode(docs: DataFrame, table: Table) -> DataFrame:
    """docs with ids array<int>: the pieces of the whole text; null for a null text, empty for an empty one.

    A column of docs named ids is replaced; others may have any names.
    """
    names = [c for c in docs.columns if c != "ids"]
    # By place, so that there is always a field and no name can clash.
    others = F.struct(F.lit(0).alias("none"), *(F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(names) if c != "text"))
    rows = docs.select("text", others.alias("_all"))

    def finish(all_: pa.Array, text: pa.Array, lists: pa.ListArray) -> dict[str, pa.Array]:
        return {"_all": all_, "_text": text, "_ids": pc.if_else(pc.is_valid(text), lists, pa.nulls(len(text), lists.type))}

    out = [StructField("_all", rows.schema["_all"].dataType), StructField("_text", StringType()), StructField("_ids", ArrayType(IntegerType()))]
    coded = _encoded(rows, table, "_all", finish, out)
    return coded.select(*((F.col("_text") if c == "text" else F.col(f"_all.c{k}")).alias(c) for k, c in enumerate(names)), F.col("_ids").alias("ids"))


def decode(coded: DataFrame, table: Table) -> DataFrame:
    """coded (with ids array<int>) with decoded string in its place: the text of the pieces without the space put in front.

    Null ids give null.  Byte pieces that are no UTF-8 become the replacement character.
    A column of coded named decoded is replaced; others may have any names.
    """
    shared = coded.sparkSession.sparkContext.broadcast(table)
    names = [c for c in coded.columns if c not in ("ids", "decoded")]
    rows = coded.select(*(F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate([*names, "ids"])))
    last = f"c{len(names)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts_of(batch[last], shared.value)], batch.schema.names)

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField(last, StringType())])).toDF(*names, "decoded")


def texts_of(ids: pa.ListArray, table: Table) -> pa.Array:
    """The decoded text of each list; null for a null list."""
    size = np.asarray(pc.fill_null(pc.list_value_length(ids), 0), np.int64)
    data, off = buffer(table.decode(np.asarray(ids.flatten(), np.int64), size))
    # The space put in front goes: each text begins a byte later.
    start = off[:-1] + ((size > 0) & (data[np.minimum(off[:-1], max(len(data) - 1, 0))] == 32 if len(data) else False))
    out = gather(data, start, off[1:])
    try:
        out = out.cast(pa.string())
    except pa.ArrowInvalid:
        out = pa.array([x.as_py().decode("utf-8", "replace") for x in out], pa.string())
    return pc.if_else(pc.is_valid(ids), out, pa.scalar(None, pa.string()))


def op5(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_pieces, digest of the ids in order, n_chars of the decoded text, and round_trip: whether it is the text.

    The ids are those of encode() and are decoded again.  The digest is the sum over
    the pieces of (id + 1) times (the piece's number from 0, mod PRIME, plus 1).  The
    space sign itself decodes to a space, so a text with one makes no round trip.  A
    null text has no piece, and null for the rest.
    """
    table = Table()

    def finish(doc_id: pa.Array, text: pa.Array, lists: pa.ListArray) -> dict[str, pa.Array]:
        size = np.asarray(pc.list_value_length(lists), np.int64)
        flat, first = np.asarray(lists.flatten(), np.int64), np.concatenate(([0], np.cumsum(size)))
        place = np.arange(len(flat)) - np.repeat(first[:-1], size)
        upto = np.concatenate(([0], np.cumsum((flat + 1) * (place % PRIME + 1))))
        decoded, some = texts_of(lists, table), pc.is_valid(text)
        null = pa.scalar(None, pa.int64())
        return {
            "doc_id": doc_id,
            "n_pieces": pa.array(size),
            "digest": pc.if_else(some, pa.array(upto[first[1:]] - upto[first[:-1]]), null),
            "n_chars": pc.if_else(some, pc.utf8_length(decoded).cast(pa.int64()), null),
            "round_trip": pc.equal(decoded, text),
        }

    out = [StructField("doc_id", LongType()), *(StructField(k, LongType()) for k in ("n_pieces", "digest", "n_chars")), StructField("round_trip", BooleanType())]
    return _encoded(integral(docs).select("doc_id", "text"), table, "cast(doc_id as long)", finish, out)
