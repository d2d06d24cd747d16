"""Importance resampling against plain Python; the tournament against sorting."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sonorium.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(t, longest):
    w = WORD.findall((t or "").translate(LOW))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=10, longest=1, least=20):
    found = [grams(t, longest) for _, t in docs]
    s, t = Counter(x for _, f in found for x in f), Counter(x for a in target for x in grams(a, longest)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in s}
    out = []
    for (i, _), (words, f) in zip(docs, found, strict=True):
        weight = sum(gain[x] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(able[: len(able) * percent // 100]):
        x[4] = k + 1
    return sorted(str(tuple(x[:5])) for x in out)


def data(spark, n=300):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcABé1漢") for _ in range(r.randint(1, 3)))
    docs = [(k, " ".join(word() for _ in range(r.randint(0, 60)))) for k in range(n)]
    docs += [(k + 1000, "tie " * 25) for k in range(3)] + [(7, "again " * 30)] * 5 + [(None, "no id " * 20)] * 4 + [(5000, "x" * 300 + " " + "y " * 30)]
    return docs, [" ".join(word() for _ in range(20)) for _ in range(10)]


@pytest.mark.parametrize("run, size, percent, longest", [(1 << 16, 1 << 17, 10, 1), (7, 4, 35, 1), (1, 1, 100, 3), (16, 1 << 17, 50, 2)])
def test_resample(spark, monkeypatch, run, size, percent, longest):
    monkeypatch.setattr(resample, "RUN", run)
    monkeypatch.setattr(resample, "RANGE", size)
    docs, target = data(spark)
    df, aim = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(df, aim, percent=percent, longest=longest).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(docs, target, percent, longest)


def test_op13(spark, edges, none):
    aim = spark.createDataFrame([("a word of the target",), (None,), ("",)], "text string")
    docs = [(r.doc_id, r.text) for r in edges.select("doc_id", "text").collect()]
    for target in (aim, aim.limit(0)):
        want = brute(docs, [r.text for r in target.collect()])
        assert sorted(str(tuple(r)) for r in resample.op13(edges, target).collect()) == want
    assert resample.op13(none, aim).count() == 0
    assert resample.op13(none, aim).columns == ["doc_id", "n_features", "weight", "score", "rank"]
    with pytest.raises(TypeError, match="integer"):
        resample.op13(spark.createDataFrame([("ab", "x")], "doc_id string, text string"), aim)


def test_crc():
    r = random.Random(0)
    parts = [r.randbytes(r.choice([0, 1, 2, 5, 47, 48, 49, 300])) for _ in range(500)]
    off = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    got = resample.crc32(np.frombuffer(b"".join(parts), np.uint8), off[:-1], off[1:])
    assert got.tolist() == [zlib.crc32(p) for p in parts]
    assert resample.crc32(np.zeros(0, np.uint8), off[:0], off[:0]).tolist() == []


def test_features_of_long_runs():
    texts = ["Ab c-d", None, "", "e", "1 2 3 4"]
    key, row, words = resample.features(pa.array(texts), 3)
    want = Counter((r, x) for r, t in enumerate(texts) for x in grams(t, 3)[1])
    assert Counter(zip(row.tolist(), key.tolist(), strict=True)) == want and words.tolist() == [3, 0, 0, 1, 4]


def test_tournament():
    r = random.Random(3)
    for k in (0, 1, 2, 3, 7, 33):
        runs = [sorted(r.randint(0, 20) for _ in range(r.randint(0, 9))) for _ in range(k)]
        tree, got = resample.Tournament(runs), []
        while at := tree.take():
            got.append((runs[at[0]][at[1]], at[0]))
        assert got == list(heapq.merge(*([(x, i) for x in run] for i, run in enumerate(runs))))
