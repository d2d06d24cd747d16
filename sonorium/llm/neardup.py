"""Near-duplicate documents by weighted MinHash.

A document is its shingles of five words, weighted by TF-IDF; two documents are
near duplicates when their weighted Jaccard similarity is `SIMILARITY` or more.

* Document frequencies are counted for hashed features, as usual for TF-IDF at
  scale: an array of `FEATURES` counters, whatever the corpus.
* Improved consistent weighted sampling gives each shingle of weight w a key
  that depends on the shingle and w alone; the shingle with the least key in each
  of `BINS` bins is the bin's sample, and an empty bin borrows from a full one
  that a fixed permutation names.  Four samples make a band, sixteen bands a
  signature: of pairs with similarity 0.8, 99.98 % meet in a band.
* Documents that meet are verified on their whole texts.  Within a bucket they
  are compared with one member, the hub, not with each other: the one that meets
  most others in all buckets, as the text that others were copied from does.
  Members of a bucket that are then still in different groups get another hub, and
  after `HUB_ROUNDS` rounds every pair of them that lies in different groups is
  compared, unless it has no shingle in common among those of which similar texts
  must share one (prefix and position filters, which are exact).  So a group of n copies costs
  about n comparisons, and no link between groups is lost.
* Links make groups: connected components, by labels that spread along links.

Equal texts are one node (a 64-bit hash of the text) from the start.  Texts
travel only for nodes that met another one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import integral, packed, scratch, unpacked, written
from .flat import Words, buffer, mix, runs, slices

WORDS, SIMILARITY = 5, 0.8
FEATURES, IDF = 1 << 20, 0.25
BINS, BAND = 64, 4
HUB_ROUNDS = 2
#: Counters in a row while document frequencies are summed.
CHUNK = 1 << 13
#: Texts of so many nodes are picked by a broadcast of their ids, of more by a shuffle.
BROADCAST_NODES = 400_000
#: For each bin, the order in which an empty one asks the others.
_PROBES = np.stack([np.random.default_rng(b).permutation(BINS) for b in range(BINS)])


def shingles(texts: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the different shingles of each text, their rows, and how often they occur there.

    Words are compared in lower case (A-Z).  A text of fewer words than a shingle
    has is one shingle; one without words has none.
    """
    words = Words(*buffer(texts))
    h = words.hashes(lower=True)
    hashes, at = runs(h, words.row, size)
    row = words.row[at]
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            some = words.count[short] > k
            whole[some] = mix(whole[some] + h[words.first[short[some]] + k])
        hashes, row = np.concatenate((hashes, whole)), np.concatenate((row, short))
    _, first, times = np.unique(hashes ^ mix(row.astype(np.uint64)), return_index=True, return_counts=True)
    return hashes[first], row[first], times


def _feature(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """By hashed feature, how many (document, shingle) pairs there are; and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(FEATURES, np.int64), 0
        for batch in slices(batches):
            counts += np.bincount(_feature(shingles(batch["text"])[0]), minlength=FEATURES)
            n += batch.num_rows
        if n:
            parts = counts.reshape(-1, CHUNK).astype(np.int32)
            used = np.flatnonzero(parts.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1).astype(np.int32)), pa.array([*(p.tobytes() for p in parts[used]), np.int32(n).tobytes()], pa.binary())], ["chunk", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | int = 0
        for batch in batches:
            for x in batch["counts"]:
                part = np.frombuffer(x.as_py(), np.int32 if len(x.as_py()) in (4, 4 * CHUNK) else np.int64)
                total = total + part.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "counts"])

    sums = docs.select("text").mapInArrow(run, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect()
    out, n = np.zeros((FEATURES // CHUNK, CHUNK), np.int64), 0
    for r in sums:
        part = np.frombuffer(r["counts"], np.int64)
        if r["chunk"] < 0:
            n = int(part[0])
        else:
            out[r["chunk"]] = part
    return out.reshape(-1), n


def inverse_frequencies(counts: np.ndarray, n: int) -> np.ndarray:
    """1 for a feature of every document, up to 1 + IDF for a rare one."""
    rare = np.log((n + 1) / (np.minimum(counts, n) + 1)) / np.log(FEATURES)
    return (1 + IDF * np.clip(rare, 0, 1)).astype(np.float32)


def _uniform(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers between 0 and 1, neither included, from each 64-bit value."""
    low = (x & np.uint64(0xFFFFFFFF)).astype(float)
    return (low + 0.5) * 2.0**-32, ((x >> np.uint64(32)).astype(float) + 0.5) * 2.0**-32


def signatures(texts: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bands (rows x bands, uint64) of each text, and which texts have any."""
    h, row, times = shingles(texts)
    rows = len(texts)
    weight = np.log(times * idf[_feature(h)].astype(float))
    u1, u2 = _uniform(mix(h ^ np.uint64(0x51)))
    r = -np.log(u1 * u2)
    u1, u2 = _uniform(mix(h ^ np.uint64(0x52)))
    log_c = np.log(-np.log(u1 * u2))
    beta, u1 = _uniform(mix(h ^ np.uint64(0x53)))
    t = np.floor(weight / r + beta)
    key = log_c - r * (t - beta) - r
    cell = row * BINS + (u1 * BINS).astype(np.int64)
    least = np.full(rows * BINS, np.inf)
    np.minimum.at(least, cell, key)
    won = key == least[cell]
    sample = np.zeros(rows * BINS, np.uint64)
    sample[cell[won]] = mix(h[won] + mix(t[won].astype(np.int64).view(np.uint64)))
    full = np.isfinite(least).reshape(rows, BINS)
    sample = sample.reshape(rows, BINS)
    some = full.any(1)
    at, bin_ = np.nonzero(~full & some[:, None])
    k = 0
    while len(at):
        other = _PROBES[bin_, k]
        hit = full[at, other]
        sample[at[hit], bin_[hit]] = sample[at[hit], other[hit]]
        at, bin_, k = at[~hit], bin_[~hit], k + 1
    bands = np.zeros((rows, BINS // BAND), np.uint64)
    for k in range(BAND):
        bands = mix(bands + sample[:, k::BAND])
    return mix(bands + np.arange(BINS // BAND, dtype=np.uint64)), some


def similarities(a: pa.Array, b: pa.Array, idf: np.ndarray) -> np.ndarray:
    """The weighted Jaccard similarity of each pair of texts; 0 where either has no word."""
    n = len(a)
    (ha, ra, ta), (hb, rb, tb) = shingles(a), shingles(b)
    wa, wb = ta * idf[_feature(ha)].astype(float), tb * idf[_feature(hb)].astype(float)
    _, i, j = np.intersect1d(ha ^ mix(ra.astype(np.uint64)), hb ^ mix(rb.astype(np.uint64)), assume_unique=True, return_indices=True)
    both = np.bincount(ra[i], np.minimum(wa[i], wb[j]), n)
    whole = np.bincount(ra, wa, n) + np.bincount(rb, wb, n) - both
    return np.where(whole > 0, both / np.where(whole > 0, whole, 1), 0.0)


def _nodes(docs: DataFrame) -> DataFrame:
    """doc_id, _node, text; a null text is an empty one."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("_node"), text.alias("text"))


def _signed(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, _node and bands (empty without a word) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bands, some = signatures(batch["text"], shared.value)
            off = np.concatenate(([0], np.cumsum(some * bands.shape[1]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), batch["_node"], pa.ListArray.from_arrays(pa.array(off), pa.array(bands[some].reshape(-1).view(np.int64)))], ["doc_id", "_node", "bands"])

    return docs.mapInArrow(run, "doc_id long, _node long, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, least: float) -> DataFrame:
    """The pairs (_a, _b) whose texts are similar enough."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_x", 1 << 20):
            near = pa.array(similarities(batch["_x"], batch["_y"], shared.value) >= least)
            yield batch.select(["_a", "_b"]).filter(near)

    both = pairs.join(texts.select(F.col("_node").alias("_a"), F.col("text").alias("_x")), "_a").join(texts.select(F.col("_node").alias("_b"), F.col("text").alias("_y")), "_b")
    return both.select("_a", "_b", "_x", "_y").mapInArrow(run, "_a long, _b long")


def prefixes(texts: DataFrame, idf: np.ndarray, least: float) -> DataFrame:
    """_node, _token, _after, _total: the rare shingles of each text of which similar texts must share one; the weight from it on, and of all.

    Shingles are ordered by how often they occur in these texts, rare ones first.  Let
    a prefix go on until what follows weighs less than `least` of the whole.  If the
    first shingle that two texts share follows either's prefix, then so does all that
    they share, and they are not similar.  Any order that is the same for all texts
    would do; this one keeps texts apart that differ from each other in many places.
    """
    counts, _ = document_frequencies(texts)
    sc = texts.sparkSession.sparkContext
    often, weights = sc.broadcast(counts), sc.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, row, times = shingles(batch["text"])
            order = np.lexsort((h, often.value[_feature(h)], row))
            h, row, w = h[order], row[order], (times * weights.value[_feature(h)].astype(float))[order]
            total = np.bincount(row, w, batch.num_rows)
            upto = np.cumsum(w)
            begin = np.concatenate(([0.0], np.cumsum(total)))[:-1]
            after = total[row] - (upto - w - begin[row])
            kept = after >= least * total[row] * (1 - 1e-9)
            yield pa.RecordBatch.from_arrays([batch["_node"].take(pa.array(row[kept])), pa.array(h[kept].view(np.int64)), pa.array(after[kept]), pa.array(total[row[kept]])], ["_node", "_token", "_after", "_total"])

    return texts.select("_node", "text").mapInArrow(run, "_node long, _token long, _after double, _total double")


def components(nodes: DataFrame, links: DataFrame, written: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """_node and _label for each of nodes (_node): the least node that it is linked with, directly or not.

    Labels spread along links and then along labels, so a chain of n takes about
    log n rounds.  Each round is written; nothing comes to the driver but a count.
    """
    ends = written(links.select(F.col("_a").alias("_node"), F.col("_b").alias("_to")).union(links.select(F.col("_b"), F.col("_a"))).distinct())
    labels = written(nodes.select("_node", F.col("_node").alias("_label")))
    while True:
        told = ends.join(labels.withColumnRenamed("_node", "_to"), "_to").groupBy("_node").agg(F.min("_label").alias("_told"))
        one = labels.join(told, "_node", "left").select("_node", F.col("_label").alias("_old"), F.least("_label", F.coalesce("_told", "_label")).alias("_mid"))
        one = written(one)
        jump = one.select(F.col("_node").alias("_mid"), F.col("_mid").alias("_next"))
        after = written(one.join(jump, "_mid").select("_node", "_old", F.least("_mid", "_next").alias("_label")))
        labels = after.select("_node", "_label")
        if after.where(F.col("_old") != F.col("_label")).isEmpty():
            return labels


def groups(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, _node, class_id and group_id for each row of docs (doc_id, text).

    class_id is the least doc_id with an equal text; group_id the least doc_id of
    the connected component of near duplicates.  Null and empty texts, and texts
    of white space, are near to none but equal ones.
    """
    with scratch(docs.sparkSession) as put:
        return written(_groups(integral(docs), least, put))


def _groups(docs: DataFrame, least: float, written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    own = _nodes(docs)
    idf = inverse_frequencies(*document_frequencies(own))
    signed = written(_signed(own, idf))
    classes = signed.groupBy("_node").agg(F.min("doc_id").alias("class_id"))
    bands = signed.select("_node", F.explode("bands").alias("_band"))
    shared = bands.groupBy("_band").agg(F.min("_node").alias("_low"), F.max("_node").alias("_high")).where("_low <> _high").select("_band")
    members = written(bands.join(shared, "_band").distinct())
    active = written(members.select("_node").distinct().join(classes, "_node").select("_node", "class_id"))
    few = active.count() <= BROADCAST_NODES
    ids = active.select(F.col("_node").alias("_id"), "class_id")
    # An equal row in doc_id and text would come twice: one of them is enough.
    texts = own.join(F.broadcast(ids) if few else ids, (F.col("_node") == F.col("_id")) & F.col("doc_id").eqNullSafe(F.col("class_id"))).select("_node", "text")
    texts = written(texts)
    if texts.count() > active.count():
        texts = written(texts.groupBy("_node").agg(F.min("text").alias("text")))
    nodes = active.select("_node")
    sizes = members.groupBy("_band").agg(F.count("*").alias("_size"))
    met = members.join(sizes, "_band").groupBy("_node").agg(F.sum("_size").alias("_met"))
    members = written(members.join(met, "_node"))
    labels, links, tried = nodes.select("_node", F.col("_node").alias("_label")), None, None
    for k in range(HUB_ROUNDS + 1):
        placed = members.join(labels, "_node")
        first = F.struct(-F.col("_met"), "_node") if k == 0 else F.struct(F.xxhash64("_node", F.lit(k)), "_node")
        # Buckets whose members are not yet in one group.
        split = placed.groupBy("_band").agg(F.min("_label").alias("_low"), F.max("_label").alias("_high"), F.min_by(F.struct(F.col("_node").alias("hub"), F.col("_label").alias("label")), first).alias("_hub")).where("_low <> _high")
        placed = placed.join(split.select("_band", "_hub"), "_band")
        if k < HUB_ROUNDS:
            pairs = placed.where(F.col("_label") != F.col("_hub.label")).select(F.least("_node", "_hub.hub").alias("_a"), F.greatest("_node", "_hub.hub").alias("_b"))
        else:
            open_ = written(placed.select("_node").distinct())
            if open_.isEmpty():
                break
            begun = prefixes(texts.join(open_, "_node"), idf, least).join(labels, "_node")
            here, there = (begun.select("_token", *(F.col(c).alias(c + side) for c in ("_node", "_label", "_after", "_total"))) for side in "ab")
            # To be similar, texts must share least / (1 + least) of their summed weights.
            enough = F.least("_aftera", "_afterb") >= least / (1 + least) * (1 - 1e-9) * (F.col("_totala") + F.col("_totalb"))
            met = (here["_token"] == there["_token"]) & (F.col("_nodea") < F.col("_nodeb")) & (F.col("_labela") != F.col("_labelb")) & enough
            pairs = here.join(there, met).select(F.col("_nodea").alias("_a"), F.col("_nodeb").alias("_b"))
        pairs = pairs.distinct()
        pairs = written(pairs if tried is None else pairs.join(tried, ["_a", "_b"], "left_anti"))
        if pairs.isEmpty():
            if k < HUB_ROUNDS:
                continue
            break
        found = written(_verified(pairs, texts, idf, least))
        tried = pairs if tried is None else tried.union(pairs)
        links = found if links is None else links.union(found)
        if not found.isEmpty():
            labels = components(nodes, links, written)
    first = labels.join(active, "_node").groupBy("_label").agg(F.min("class_id").alias("group_id"))
    of_node = labels.join(first, "_label").select("_node", "group_id")
    known = classes.join(of_node, "_node", "left").select("_node", "class_id", F.coalesce("group_id", "class_id").alias("group_id"))
    return signed.select("doc_id", "_node").join(known, "_node")


def clean(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of each group, with the columns of docs: that of the least doc_id."""
    kept = groups(docs.select("doc_id", "text"), least).where(F.col("doc_id").eqNullSafe(F.col("group_id"))).groupBy(F.col("doc_id").alias("_doc"), F.col("_node").alias("_kept")).agg(F.count("*").alias("_n"))
    kept = written(kept)
    node = F.xxhash64(F.coalesce(F.col("_all.text"), F.lit("")))
    out = packed(docs).join(kept, (node == F.col("_kept")) & F.col("_all.doc_id").eqNullSafe(F.col("_doc")))
    if not kept.where("_n > 1").isEmpty():  # rows equal in doc_id and text
        out = out.dropDuplicates(["_doc", "_kept"])
    return unpacked(out, docs.columns)


def op1(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (equal texts), group_id (near duplicates), kept (the one that stays)."""
    return groups(docs).select("doc_id", "class_id", "group_id", F.coalesce(F.col("doc_id") == F.col("group_id"), F.lit(False)).alias("kept"))
