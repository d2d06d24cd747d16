"""Language-model scoring with word classes (class-based bigrams after Brown).

Exchange clustering puts words into classes so that the classes' bigrams are as likely
as can be: a round finds for each word what the log likelihood of the training text
would gain by moving it to each other class, with the word's own counts taken out of
its present one and the classes' sizes counted, and moves words that gain.  As many
words move at once, the likelihood of what they make together is computed, and a round
that would lower it is taken back by halves: it never falls.  Every word takes part: rare ones
with all rare words of the same ending, which move as one and whose pairs are counted
as one's; a word that training lacks is in the class of its ending.  The probability of a word is
that of its class after the class before it, times that of the word within its class,
both smoothed.

Scale.  Words are known by a 64-bit hash.  Three passes read the texts: to count
words, to count pairs of classes-to-be, and to score.  Counts of all words stay
in a table; those whose share reaches `WIDE` (at most 1/WIDE) are broadcast, and
the rest of a text's words meet the table in a join on the hash, after which
their part of the score is a sum by document.  Clustering sees the pair counts
of all training text, one row per word or ending and piece of its neighbours; a round
is one map over these rows, and the gains are found where the rows are.  The driver
holds a class and a gain for each word that moves by itself (at most 1/NARROW of them, 20 bytes each) and each ending, a
matrix of classes, and the broadcast counts (at most 1/WIDE, 17 bytes each).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import integral, remainder, written
from .flat import LOWER, Lookup, Tally, Words, buffer, group_sum, mix, prefix, prefix_hash, slices

#: Least shares of the tokens: of words whose counts are broadcast, and of words that move by themselves; such a word occurs so often at least.
WIDE, NARROW, LEAST = 2e-7, 5e-6, 10
CLASSES, ROUNDS = 64, 6
#: Endings, by a hash of the last `LAST` bytes.
ENDINGS, LAST = 1024, 2
#: Added to each pair of classes.
PRIOR = 0.5
#: Neighbours of a word in one row, at most.
PIECE = 20_000
END = np.uint64(0)
_ENDING = np.uint64(ENDINGS - 1)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all rows' tokens with the end of each row, the rows, and the offsets of the rows.

    The lowest bits of a hash are those of the hash of the word's last bytes:
    its ending.  The end is 0.
    """
    words = Words(*buffer(texts))
    sums = prefix(LOWER[words.data])
    whole = prefix_hash(sums, words.start, words.end)
    last = prefix_hash(sums, np.maximum(words.start, words.end - LAST), words.end)
    h = (whole & ~_ENDING) | (last & _ENDING)
    h[h == END] = np.uint64(ENDINGS)
    n = len(words.off) - 1
    first = words.first + np.arange(n + 1)
    out = np.zeros(len(h) + n, np.uint64)
    out[np.arange(len(h)) + words.row] = h
    return out, np.repeat(np.arange(n), np.diff(first)), first


def count_words(docs: DataFrame) -> DataFrame:
    """hash long and n long of all tokens of docs (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in slices(batches):
            tally.add(tokens(batch["text"])[0])
            if tally.full():
                yield _pairs(*tally.take())
        yield _pairs(*tally.take())

    return docs.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def _pairs(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["hash", "n"])


class Model:
    """Counts and classes of the frequent words, classes of the endings, totals of all classes, transitions.

    The last class is the end.  words: hash -> (count, class).
    """

    def __init__(self, words: Lookup, endings: np.ndarray, tokens_: int, distinct: int):
        self.words, self.endings, self.tokens, self.distinct = words, endings, tokens_, distinct
        self.classes = CLASSES + 1
        self.total = np.zeros(self.classes)  # tokens
        self.kinds = np.zeros(self.classes)  # distinct words
        self.move = np.zeros((self.classes, self.classes))  # log10 of transitions

    def class_of(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each token, known or not."""
        out = self.endings[(h & _ENDING).astype(np.int64)].astype(np.int64)
        if len(self.words.keys):
            out = np.where(at >= 0, self.words.values[1][at], out).astype(np.int64)
        return np.where(h == END, self.classes - 1, out)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def emission(self, count: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """log10 of a word's probability within its class; an unknown word counts 0 there."""
        return np.log10((count + 0.5) / (self.total[kind] + 0.5 * (self.kinds[kind] + 1)))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))  # counts: 0 or at least 1


def likelihood(table: np.ndarray) -> float:
    """The log likelihood of the classes' bigrams, and of words given their classes but for what no exchange changes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(1)).sum() - _xlogx(table.sum(0)).sum())


#: Elements of a matrix while gains are found.
_CELLS = 1 << 21


def exchange(present: np.ndarray, word: np.ndarray, side: np.ndarray, kind: np.ndarray, n: np.ndarray, own: np.ndarray, table: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The best class of each of some words, and what the log likelihood gains by moving that word alone there.

    present: the words' classes.  word, side, kind, n: counts of the classes after a word
    (side 1) and before it (side 0), each once.  own: how often a word follows itself.  table: counts of
    all pairs of classes.  A word's counts are taken out of its class before it is put into each.
    """
    m, many = len(present), len(table)
    sums = np.zeros((2, m, many))
    sums[side, word, kind] = n
    before, after = sums
    at, rows = np.arange(m), np.arange(classes)
    gain = np.zeros((m, classes))
    a = present[word]
    step = max(1, _CELLS // classes)
    for s in (1, 0):
        t, mine, other = (table, after, before) if s else (table.T, before, after)
        for k in range(0, len(word), step):
            e = np.flatnonzero(side[k : k + step] == s) + k
            w, c, aw = word[e], kind[e], a[e]
            x = t[:classes, c].T.copy()  # pairs of each class with c
            same = np.flatnonzero(c == aw)
            x[same] -= other[w[same], :classes]
            i = np.arange(len(e))
            x[i, aw] = t[aw, c] - mine[w, c] - np.where(c == aw, other[w, c] - own[w], 0)
            more = n[e] - np.where(c == aw, own[w], 0)
            part = _xlogx(x + more[:, None]) - _xlogx(x)
            part[rows[None, :] == c[:, None]] = 0  # pairs within the class come below
            order = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1]))) if len(w) else w
            if len(w):
                gain[w[order]] += np.add.reduceat(part, order, axis=0)
    inner = np.broadcast_to(np.diag(table)[:classes], (m, classes)).copy()
    inner[at, present] -= after[at, present] + before[at, present] - own
    into = after[:, :classes] + before[:, :classes] + own[:, None]
    into[at, present] -= 2 * own
    gain += _xlogx(inner + into) - _xlogx(inner)
    for size, mine in ((table.sum(1), after.sum(1)), (table.sum(0), before.sum(1))):
        left = np.broadcast_to(size[:classes], (m, classes)).copy()
        left[at, present] -= mine
        gain -= _xlogx(left + mine[:, None]) - _xlogx(left)
    best = gain.argmax(1)
    return best, gain[at, best] - gain[at, present]


def cluster(docs: DataFrame, words: Lookup, classes: int = CLASSES, rounds: int = ROUNDS, told: list[float] | None = None, endings: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A class for each place of `words` by exchange; and the counts of all pairs of classes.

    words.values[1] holds -1 for a word that moves by itself; all others, those that `words` lacks among them, move with their ending.  In a round a hash picks the words that
    may move, half of them, which keeps two that belong together from passing each other.  told: gets the
    log likelihood of each round that stands; it never falls.  endings: gets the class of each ending.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(words)
    todo = np.flatnonzero(words.values[1] < 0)
    number = np.full(len(words.keys), -1, np.int32)
    number[todo] = np.arange(len(todo))
    few = len(todo)
    base = few + ENDINGS  # ids: words that move by themselves, then endings, then the end
    ids = spark.sparkContext.broadcast(number)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in slices(batches):
            h, _, first = tokens(batch["text"])
            at = shared.value.find(h)
            own = np.where(at >= 0, ids.value[at], -1).astype(np.int64) if len(ids.value) else np.full(len(h), -1)
            own = np.where(own >= 0, own, few + (h & _ENDING).astype(np.int64))
            own = np.where(h == END, base, own)
            left = np.concatenate(([base], own[:-1])) if len(own) else own
            left[first[:-1]] = base
            tally.add(((left << 32) | own).astype(np.uint64))
            if tally.full():
                yield _pairs(*tally.take())
        yield _pairs(*tally.take())

    counted = written(docs.select("text").mapInArrow(pairs, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")))
    left, right = F.shiftright("hash", 32).cast("int"), F.col("hash").bitwiseAND(0xFFFFFFFF).cast("int")
    sides = counted.select(left.alias("id"), right.alias("other"), F.lit(1).alias("side"), "n").union(counted.select(right.alias("id"), left.alias("other"), F.lit(0).alias("side"), "n"))
    piece = F.pmod(F.xxhash64("other"), F.lit(max(1, (2 * base) // PIECE))).alias("_piece")
    rows = sides.where(F.col("id") < base).groupBy("id", "side", piece).agg(F.collect_list("other").alias("other"), F.collect_list("n").alias("n")).drop("_piece")
    rows = written(rows)
    many = classes + 1

    def table_of(present: np.ndarray) -> np.ndarray:
        """Counts of all pairs of classes."""
        now = spark.sparkContext.broadcast(present)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(many * many)
            for batch in batches:
                h, n = np.asarray(batch["hash"], np.int64), np.asarray(batch["n"], np.int64)
                total += np.bincount(now.value[h >> 32].astype(np.int64) * many + now.value[h & 0xFFFFFFFF], n, many * many)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], ["pair", "n"])

        found = counted.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
        now.unpersist()
        out = np.zeros(many * many)
        out[found["pair"].to_numpy()] = found["n"].to_numpy()
        return out.reshape(many, many)

    def gains(present: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By clustered word the best class and its gain."""
        now = spark.sparkContext.broadcast((present, table))

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Neighbours of a piece become classes; the word itself counts also as class `many`."""
            for batch in batches:
                size = np.asarray(pc.list_value_length(batch["other"]), np.int64)
                row, other = np.repeat(np.arange(len(size)), size), np.asarray(batch["other"].flatten())
                n = np.asarray(batch["n"].flatten(), np.int64)
                self_ = np.flatnonzero((other == np.asarray(batch["id"])[row]) & (np.asarray(batch["side"])[row] == 1))
                key, n = group_sum(np.concatenate((row * (many + 1) + now.value[0][other], row[self_] * (many + 1) + many)).astype(np.int64), np.concatenate((n, n[self_])))
                first = np.searchsorted(key, np.arange(len(size) + 1) * (many + 1)).astype(np.int32)
                kinds, sums = (pa.ListArray.from_arrays(pa.array(first), pa.array(x)) for x in ((key % (many + 1)).astype(np.int32), n))
                yield pa.RecordBatch.from_arrays([batch["id"], batch["side"], kinds, sums], ["id", "side", "kind", "n"])

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, 4096):
                    part = batch.slice(k, 4096)
                    some = part["parts"].flatten()
                    outer = np.repeat(np.arange(part.num_rows), np.asarray(pc.list_value_length(part["parts"]), np.int64))
                    size = np.asarray(pc.list_value_length(some.field("kind")), np.int64)
                    word, side = np.repeat(outer, size), np.repeat(np.asarray(some.field("side"), np.int64), size)
                    key = (word * 2 + side) * (many + 1) + np.asarray(some.field("kind").flatten(), np.int64)
                    key, n = group_sum(key, np.asarray(some.field("n").flatten(), np.int64))
                    kind, word, side = key % (many + 1), key // (2 * (many + 1)), key // (many + 1) % 2
                    own, real = np.zeros(part.num_rows), kind < many
                    own[word[~real]] = n[~real]
                    id_ = np.asarray(part["id"])
                    to, gain = exchange(now.value[0][id_].astype(np.int64), word[real], side[real], kind[real], n[real].astype(float), own, now.value[1], classes)
                    yield pa.RecordBatch.from_arrays([pa.array(id_), pa.array(to.astype(np.int32)), pa.array(gain)], ["id", "best", "gain"])

        folded = rows.mapInArrow(fold, "id int, side int, kind array<int>, n array<long>").groupBy("id").agg(F.collect_list(F.struct("side", "kind", "n")).alias("parts"))
        found = folded.mapInArrow(best, "id int, best int, gain double").toArrow()
        now.unpersist()
        to, gain = present[:base].astype(np.int64), np.zeros(base)
        to[found["id"].to_numpy()], gain[found["id"].to_numpy()] = found["best"].to_numpy(), found["gain"].to_numpy()
        return to, gain

    present = np.append(np.arange(base) % classes, classes).astype(np.int16)
    table = table_of(present)
    score = likelihood(table)
    for r in range(rounds):
        to, gain = gains(present, table)
        turn = mix(np.arange(base, dtype=np.uint64) + np.uint64(r * base))
        moving = (gain > 1e-6) & (turn & np.uint64(1) == 0)
        if not (gain > 1e-6).any():
            break
        while moving.any():
            tried = present.copy()
            tried[:base][moving] = to[moving]
            new = table_of(tried)
            if likelihood(new) >= score:
                present, table, score = tried, new, likelihood(new)
                break
            turn >>= np.uint64(1)
            moving &= turn & np.uint64(1) == 0
        if told is not None:
            told.append(score)
    kinds = present[few + (words.keys & _ENDING).astype(np.int64)].astype(words.values[1].dtype)
    kinds[todo] = present[:few]
    if endings is not None:
        endings.append(present[few:base])
    return kinds, table


def learn(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of all texts of docs, and the written counts of all their words."""
    counts = written(count_words(docs))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    wide, narrow = max(1, int(np.ceil(WIDE * total["n"]))), max(LEAST, int(np.ceil(NARROW * total["n"])))
    narrow = max(wide, narrow)
    known = counts.where((F.col("n") >= wide) & (F.col("hash") != 0)).toArrow()
    h, n = (np.asarray(known[k].combine_chunks()) if known.num_rows else np.zeros(0, np.int64) for k in ("hash", "n"))
    h = h.view(np.uint64)
    order = np.lexsort((h, -n))  # so that the first classes are given out by frequency, the same in each run
    h, n = h[order], n[order]
    words, endings = Lookup(h, n, np.where(n >= narrow, -1, 0).astype(np.int8)), []
    kind, table = cluster(docs, words, endings=endings)
    model = Model(Lookup(words.keys, words.values[0], kind), endings[0], total["n"], total["v"])
    many = model.classes
    alone = words.values[0] >= narrow
    model.total[:CLASSES] = np.bincount(kind[alone], words.values[0][alone], CLASSES)
    model.kinds[:CLASSES] = np.bincount(kind[alone], minlength=CLASSES)
    ending = F.when(F.col("hash") != 0, F.col("hash").bitwiseAND(ENDINGS - 1)).alias("k")
    small = counts.where((F.col("n") < narrow) | (F.col("hash") == 0)).groupBy(ending).agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    for r in small.collect():
        k = many - 1 if r["k"] is None else int(model.endings[r["k"]])
        model.total[k] += r["n"]
        model.kinds[k] += r["v"]
    table += PRIOR
    model.move = np.log10(table / table.sum(1, keepdims=True))
    assert model.move.shape == (many, many)
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of each row of docs (_row, doc_id, text).

    _row numbers the rows, so that rows with one id stay apart.  A null or empty
    text has the end alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("_row", pa.int64()), ("doc_id", pa.int64()), ("hash", pa.int64()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("kind", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            h, row, first = tokens(batch["text"])
            at = m.words.find(h)
            kind = m.class_of(h, at)
            end = m.classes - 1
            before = np.concatenate(([end], kind[:-1]))
            before[first[:-1]] = end
            moves = m.move[before, kind]
            rows = batch.num_rows
            here = (at >= 0) | (h == END)
            count = m.words.values[0][at[here]].astype(float) if len(m.words.keys) else np.zeros(int(here.sum()))
            count[h[here] == END] = m.total[end]
            base, own = m.base(count), m.emission(count, kind[here])
            sums = [np.bincount(row[here], x, rows) for x in (base, own)]
            ids, numbers = batch["doc_id"].cast(pa.int64()), batch["_row"]
            # Row by row what is settled here; then each other word of a row once, with its number.
            yield pa.RecordBatch.from_arrays(
                [numbers, ids, pa.nulls(rows, pa.int64()), pa.array(np.diff(first)), pa.array(np.bincount(row[here], count > 0, rows).astype(np.int64)), pa.array(sums[0]), pa.array(sums[1] + np.bincount(row, moves, rows)), pa.nulls(rows, pa.int64())], schema=schema
            )
            h, row, kind = h[~here], row[~here], kind[~here]
            order = np.lexsort((h, row))
            h, row, kind = h[order], row[order], kind[order]
            if len(h):
                head = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1]))))
                times = np.diff(np.append(head, len(h)))
                n = len(head)
                none = pa.nulls(n, pa.float64())
                yield pa.RecordBatch.from_arrays([numbers.take(pa.array(row[head])), pa.nulls(n, pa.int64()), pa.array(h[head].view(np.int64)), pa.array(times), pa.nulls(n, pa.int64()), none, none, pa.array(kind[head])], schema=schema)


    found = written(docs.select("_row", "doc_id", "text").mapInArrow(run, "_row long, doc_id long, hash long, n long, known long, base double, score double, kind long"))
    settled = found.where(F.col("hash").isNull()).select("_row", "doc_id", F.col("n").alias("n_tokens"), "known", "base", "score")
    # Words that are not broadcast: their counts come by a join on the hash; a word that training lacks stays at 0.
    rest = found.where(F.col("hash").isNotNull()).select("_row", "hash", "kind", F.col("n").alias("times"))
    rest = rest.join(counts.select("hash", F.col("n").cast("double").alias("count")), "hash", "left").withColumn("count", F.coalesce("count", F.lit(0.0)))
    denominators = F.array(*(F.lit(float(model.total[k] + 0.5 * (model.kinds[k] + 1))) for k in range(CLASSES)))
    whole = float(model.tokens + 0.5 * (model.distinct + 1))
    rest = rest.groupBy("_row").agg(
        F.sum(F.when(F.col("count") > 0, F.col("times")).otherwise(0)).alias("_known"),
        F.sum(F.col("times") * F.log10((F.col("count") + 0.5) / whole)).alias("_base"),
        F.sum(F.col("times") * F.log10((F.col("count") + 0.5) / F.get(denominators, F.col("kind").cast("int")))).alias("_score"),
    )
    return settled.join(rest, "_row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("_score", F.lit(0.0))).alias("score"),
    )


def op6(docs: DataFrame) -> DataFrame:
    """The contract's result for every document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    held = F.coalesce(remainder("doc_id", 5) == 1, F.lit(False))
    model, counts = learn(integral(docs).where(~held))
    out = score(docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id()), model, counts)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
