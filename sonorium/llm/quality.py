"""Quality classifier: a convolutional network over bytes, in numpy.

Bytes are embedded; learned filters of 12 bytes slide in steps of 4 over the
whole document; their rectified outputs are averaged in overlapping chunks of 128
bytes; a dense layer turns each chunk into features; the maximum of each feature
over all chunks, and of each filter over all positions, goes into one logistic
unit.  Nothing is cut off: a long document has more chunks.

Learning uses at most `most` labelled documents and runs on the driver.  Scoring
is one pass without a shuffle; slices of half a megabyte bound what a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import integral, labelled_sample, remainder
from .flat import buffer, slices

#: Labelled documents that are used for learning, at most.
MOST = 4_000
EPOCHS = 6
STEP, TAPS, EMBED, FILTERS, HIDDEN, HALF = 4, 3, 8, 32, 24, 16
BATCH_BYTES = 1 << 18
SLICE_BYTES = 1 << 19
THRESHOLD = 0.3
RATE = 4e-3


class Layout:
    """Texts laid out for the network: each padded with zeros to whole half chunks and one half chunk more."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        unit = STEP * HALF
        size = np.diff(off)
        halves = np.maximum(1, -(-size // unit)) + 1
        to = np.concatenate(([0], np.cumsum(halves)))
        self.bytes = np.zeros((to[-1] + 1) * unit, np.uint8)
        self.bytes[np.arange(len(data)) + np.repeat(to[:-1] * unit - off[:-1], size)] = data
        self.halves = to  # of each text: where its half chunks begin
        self.n = int(to[-1])


class Network:
    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        g = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {
            "embed": g(256, EMBED, scale=0.5),
            "filters": g(STEP * EMBED, TAPS * FILTERS, scale=(STEP * TAPS * EMBED) ** -0.5),
            "bias": np.zeros(FILTERS, np.float32),
            "dense": g(FILTERS, HIDDEN, scale=2 * FILTERS**-0.5),
            "dense_bias": np.full(HIDDEN, 0.1, np.float32),
            "out": g(HIDDEN + FILTERS, scale=0.1),
            "out_bias": np.zeros(1, np.float32),
        }

    def forward(self, x: Layout) -> tuple[np.ndarray, dict]:
        p = self.p
        n = x.n * HALF
        rows = p["embed"][x.bytes].reshape(-1, STEP * EMBED)
        parts = rows @ p["filters"]
        act = parts[:n, :FILTERS] + p["bias"]
        for k in range(1, TAPS):
            act += parts[k : n + k, k * FILTERS : (k + 1) * FILTERS]
        # A text ends in padding; the last filters there would reach into the text behind it.
        edge = (x.halves[1:, None] * HALF - np.arange(1, TAPS)).ravel()
        pad = np.tile(p["embed"][0], STEP)
        act[edge] = p["bias"] + (pad @ p["filters"]).reshape(TAPS, FILTERS).sum(0)
        np.maximum(act, 0, out=act)
        halves = act.reshape(x.n, HALF, FILTERS)
        mean = halves.mean(1)
        chunk = mean.copy()
        last = x.halves[1:] - 1
        inner = np.ones(x.n, bool)
        inner[last] = False
        chunk[:-1][inner[:-1]] += mean[1:][inner[:-1]]
        chunk *= 0.5
        hidden = np.maximum(chunk @ p["dense"] + p["dense_bias"], 0)
        hidden[last] = 0  # a chunk of padding decides nothing
        start = x.halves[:-1]
        top_hidden = np.maximum.reduceat(hidden, start, axis=0)
        top_filter = np.maximum.reduceat(halves.max(1), start, axis=0)
        pooled = np.concatenate([top_hidden, top_filter], 1)
        logit = pooled @ p["out"] + p["out_bias"][0]
        score = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return score, {"rows": rows, "act": act, "chunk": chunk, "hidden": hidden, "pooled": pooled, "inner": inner, "edge": edge, "pad": pad}

    def gradients(self, x: Layout, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, (score, c) = self.p, self.forward(x)
        texts, n = len(x.halves) - 1, x.n * HALF
        d = ((score - label) * weight / texts).astype(np.float32)
        out = {"out": c["pooled"].T @ d, "out_bias": d.sum(keepdims=True)}
        dpool = d[:, None] * p["out"]
        dhidden = np.zeros_like(c["hidden"])
        dact = np.zeros_like(c["act"])
        for i in range(texts):
            a, b = x.halves[i], x.halves[i + 1]
            at = a + c["hidden"][a:b].argmax(0)
            dhidden[at, np.arange(HIDDEN)] = dpool[i, :HIDDEN] * (c["pooled"][i, :HIDDEN] > 0)
            at = a * HALF + c["act"][a * HALF : b * HALF].argmax(0)
            dact[at, np.arange(FILTERS)] = dpool[i, HIDDEN:]
        out["dense"], out["dense_bias"] = c["chunk"].T @ dhidden, dhidden.sum(0)
        dchunk = (dhidden @ p["dense"].T) * 0.5
        dmean = dchunk.copy()
        dmean[1:][c["inner"][:-1]] += dchunk[:-1][c["inner"][:-1]]
        dact += np.repeat(dmean / HALF, HALF, axis=0)
        dact *= c["act"] > 0
        out["bias"] = dact.sum(0)
        at_edge = np.outer(c["pad"], dact[c["edge"]].sum(0))
        dact[c["edge"]] = 0
        rows = c["rows"]
        out["filters"] = np.empty_like(p["filters"])
        drows = np.zeros_like(rows)
        for k in range(TAPS):
            w = slice(k * FILTERS, (k + 1) * FILTERS)
            out["filters"][:, w] = rows[k : n + k].T @ dact + at_edge
            drows[k : n + k] += dact @ p["filters"][:, w].T
        drows = drows.reshape(-1, EMBED)
        out["embed"] = np.stack([np.bincount(x.bytes, drows[:, j], 256) for j in range(EMBED)], 1).astype(np.float32)
        out["embed"][0] = 0
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        """The probability of label 1 of each text; a null text is an empty one."""
        return self.forward(Layout(*buffer(texts)))[0].astype(float)


def fit(texts: list[bytes], label: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 0) -> Network:
    """Adam on the logistic loss, either class with half of the weight; the better half of the run is averaged."""
    net = Network(seed)
    if not texts:
        return net
    net.p["embed"][0] = 0
    r = np.random.default_rng(seed)
    share = np.clip(np.bincount(label, minlength=2) / len(label), 1e-3, None)
    weight = 0.5 / share
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step, kept, averaged = 0, 0, {k: np.zeros_like(x) for k, x in net.p.items()}
    sizes = np.array([len(t) for t in texts])
    for epoch in range(epochs):
        order = r.permutation(len(texts))
        cut = np.cumsum(sizes[order] + 64)
        groups = np.minimum(cut // BATCH_BYTES, np.arange(len(texts)) * 10**6).astype(int)
        batches = np.split(order, np.flatnonzero(np.diff(groups)) + 1)
        batches = [part for b in batches for part in np.array_split(b, -(-len(b) // 32))]
        for k, b in enumerate(batches):
            at = rate * 0.5 * (1 + np.cos(np.pi * (epoch + k / len(batches)) / epochs))
            data = np.frombuffer(b"".join(texts[i] for i in b), np.uint8)
            off = np.concatenate(([0], np.cumsum(sizes[b])))
            step += 1
            for name, g in net.gradients(Layout(data, off), label[b], weight[label[b]]).items():
                m[name] += 0.1 * (g - m[name])
                v[name] += 0.01 * (g * g - v[name])
                net.p[name] -= at * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)
            if 2 * epoch >= epochs:
                kept += 1
                for name in averaged:
                    averaged[name] += (net.p[name] - averaged[name]) / kept
    net.p = {k: x.astype(np.float32) for k, x in averaged.items()} if kept else net.p
    return net


def learn(docs: DataFrame, marks: DataFrame, most: int = MOST) -> Network:
    """A network from labels.quality of at most `most` documents with crc32(doc_id) mod 5 <> 0.

    Null texts count as empty ones.
    """
    table = labelled_sample(docs, marks, "quality", 5, 0, most).toArrow().sort_by("doc_id")
    texts = [(t or "").encode() for t in table["text"].to_pylist()]
    return fit(texts, np.array(table["_label"].to_pylist(), int))


def score(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id and score for each row of docs (doc_id, text); equal texts have equal scores."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(shared.value.score(batch["text"]))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op2(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The contract's result: doc_id, held_out, score, predicted for every document."""
    out = score(integral(docs), learn(docs, marks))
    return out.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
