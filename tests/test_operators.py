import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonorium.operators import align, intervals, mos, pairing, sampling


def edits(a, b):
    """Brute force: the matrix, then back with match, substitution, deletion, insertion."""
    m = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            m[i][j] = min(m[i - 1][j - 1] + (a[i - 1] != b[j - 1]), m[i - 1][j] + 1, m[i][j - 1] + 1)
    i, j, s, d, n = len(a), len(b), 0, 0, 0
    while i or j:
        if i and j and a[i - 1] == b[j - 1] and m[i][j] == m[i - 1][j - 1]:
            i, j = i - 1, j - 1
        elif i and j and m[i][j] == m[i - 1][j - 1] + 1:
            i, j, s = i - 1, j - 1, s + 1
        elif i and m[i][j] == m[i - 1][j] + 1:
            i, d = i - 1, d + 1
        else:
            j, n = j - 1, n + 1
    return s, d, n


def test_edit_counts(spark):
    r = random.Random(5)
    rows = [(list("abc"), list("axcd")), (list("ab"), list("ba")), ([], list("ab")), (list("ab"), []), ([], [])]
    rows += [([r.choice("abcd") for _ in range(r.randint(0, 12))], [r.choice("abcd") for _ in range(r.randint(0, 12))]) for _ in range(300)]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(rows)], "k int, a array<string>, b array<string>")
    out = {x.k: (x.s, x.d, x.i, x.n_ref) for x in align.edit_counts(df, "a", "b").collect()}
    assert out[0] == (1, 0, 1, 3) and out[1] == (2, 0, 0, 2)
    for k, (a, b) in enumerate(rows):
        s, d, i, n = out[k]
        assert n == len(a) and (s, d, i) == edits(a, b), (a, b)


def warp(x, y, cost):
    """Brute force of the path: steps (1,1), (0,1), (1,0), the first of equal ones."""
    n, m = len(x), len(y)
    best = {}
    for i in range(n):
        for j in range(m):
            c = cost(x[i], y[j])
            before = [best[k] for k in ((i - 1, j - 1), (i, j - 1), (i - 1, j)) if k in best]
            p = min(before, key=lambda b: b[0]) if before else (0.0, [])
            best[i, j] = (p[0] + c, [*p[1], (i, j)])
    return best[n - 1, m - 1]


def test_warped_rmse(spark):
    g = np.random.default_rng(0)
    rows = [(k, (g.random((g.integers(3, 9), 3)) * 900 + 200).tolist(), (g.random((g.integers(3, 9), 3)) * 900 + 200).tolist()) for k in range(40)]
    rows.append((40, rows[0][1], rows[0][1]))
    df = spark.createDataFrame(rows, "k int, a array<array<double>>, b array<array<double>>")
    out = {r.k: r for r in align.warped_rmse(df, "a", "b", ["F1", "F2", "F3"], "none").collect()}
    for k, a, b in rows:
        a, b = np.array(a), np.array(b)
        _, path = warp(a, b, lambda p, q: float(np.sqrt(((p - q) ** 2).sum())))
        e = np.sqrt(np.mean([(a[i] - b[j]) ** 2 for i, j in path], axis=0))
        assert [out[k].rmse_F1, out[k].rmse_F2, out[k].rmse_F3] == pytest.approx(e.tolist())
    assert out[40].rmse_F1 == 0
    empty = spark.createDataFrame([(1, [], rows[0][1])], "k int, a array<array<double>>, b array<array<double>>")
    assert align.warped_rmse(empty, "a", "b", ["F1", "F2", "F3"]).first().rmse_F1 is None


def test_abx(spark):
    rows = [(f"i{k}", "s", "p" if k < 3 else "q", [float(k)]) for k in range(6)] + [("j", "s2", "p", [1.0])]
    items = spark.createDataFrame(rows, "id string, speaker string, phoneme string, v array<double>")
    t = sampling.triplets(items, most=1000)
    assert t.count() == 2 * 3 * 2 * 3 and t.distinct().count() == t.count()
    assert t.where("x_id = a_id").count() == 0
    d = align.pair_distances(t, items, "v", lambda x: x.withColumn("distance", align.distance_l2(F.col("_x"), F.col("_y"))))
    for r in align.abx_scores(t, d).collect():
        x, a, b = (int(v[1]) for v in (r.x_id, r.a_id, r.b_id))
        assert r.score == (1.0 if abs(x - a) < abs(x - b) else 0.0 if abs(x - a) > abs(x - b) else 0.5)
    assert sampling.triplets(items, most=2).groupBy("speaker", "p", "q").count().agg(F.max("count")).first()[0] == 2


def test_tiers(spark):
    rows = [("f", 0.0, 1.0, "a"), ("f", 1.0, 1.5, "a"), ("f", 1.5, 2.0, "b"), ("f", 2.5, 3.0, "b")]
    df = spark.createDataFrame(rows, "file string, xmin double, xmax double, label string")
    got = [(r.xmin, r.xmax, r.label) for r in intervals.merge_contiguous(df, ["file"]).orderBy("pos").collect()]
    assert got == [(0.0, 1.5, "a"), (1.5, 2.0, "b"), (2.5, 3.0, "b")]
    rows = [("f", 0.0, 1.0, "a"), ("f", 1.5, 2.0, "b"), ("f", 1.8, 3.0, "c")]
    df = spark.createDataFrame(rows, "file string, xmin double, xmax double, label string")
    got = [(r.xmin, r.xmax, r.label) for r in intervals.seal_gaps(df, ["file"]).orderBy("xmin").collect()]
    assert got == [(0.0, 1.0, "a"), (1.0, 1.5, "sp"), (1.5, 2.0, "b"), (2.0, 3.0, "c")]


def test_contains(spark):
    df = spark.createDataFrame([([], ["a"]), (["b", "c"], ["a", "b", "c"]), (["a", "c"], ["a", "b", "c"]), (["b"], ["ab"])], "n array<string>, h array<string>")
    assert [r.v for r in df.select(intervals.contains("h", "n").alias("v")).collect()] == [True, True, False, False]


def test_moving_mean(spark):
    df = spark.createDataFrame([("f", k, float(k + 1)) for k in range(4)], "f string, i int, v double")
    for k, want in ((3, [1.5, 2, 3, 3.5]), (2, [1, 1.5, 2.5, 3.5])):
        assert [r.mean for r in intervals.moving_mean(df, ["f"], "i", "v", k).orderBy("i").collect()] == want


def test_sentence_search(spark):
    words = spark.createDataFrame([("f", k, float(k), k + 1.0, w) for k, w in enumerate(["sp", "The", "cat", "sp", "sat", "the", "dog"])], "file string, pos int, xmin double, xmax double, label string")
    targets = spark.createDataFrame([("f", 1, ["cat", "sat"]), ("f", 2, ["no"]), ("f", 3, ["the", "dog"])], "file string, sid int, tokens array<string>")
    out = {r.sid: (r.t_start, r.t_end, r["first"], r["last"]) for r in intervals.sentence_window(words, targets, ["file"]).collect()}
    assert out == {1: (1.95, 5.05, 2, 4), 3: (4.95, 7.05, 5, 6)}
    told = spark.createDataFrame([("f", 0, "The cats sat"), ("f", 1, "unheard words"), ("f", 2, "the dog")], "file string, pos int, sentence string")
    got = {r.pos: (r.status, r.t_start, r.t_end) for r in align.segments(words, told, "file").collect()}
    assert got == {0: ("ok", 1.0, 5.0), 1: ("no_match", None, None), 2: ("ok", 5.0, 7.0)}


def test_pairing(spark):
    rows = [("a", "x", 1), ("a", "y", 2), ("b", "x", 3)]
    df = spark.createDataFrame(rows, "k string, c string, v int")
    assert [tuple(r) for r in pairing.pair_all(df, ["k"], "c", ["x", "y"], "v").collect()] == [("a", 1, 2)]
    assert [r.k for r in pairing.in_all(df, ["k"], "c", 2).collect()] == ["a"]
    c = pairing.set_counts(df, [], "c", "k", ["x", "y"]).first()
    assert (c.n_all, c.n_any, c.equal, c.only_x, c.only_y) == (1, 2, False, 1, 0)
    frames = spark.createDataFrame([("r", "1", t, k, 5.0, "w") for k, t in enumerate((0.3, 0.1, 0.2))] + [("r", "2", 0.1, 3, 1.0, "w")], "rec string, id string, rel_time double, row_idx int, F1 double, word string")
    nested = pairing.nest_tracks(frames, ["rec", "id"], ["F1"], ["word"]).collect()
    assert [(r.id, [x.rel_time for x in r.track]) for r in nested] == [("1", [0.1, 0.2, 0.3])]
    t = spark.createDataFrame([("r", 1, "a", "b", "c"), ("r", 2, "b", "c", "")], "rec string, t int, pre_word string, word string, fol_word string")
    assert pairing.sentence_text(t, ["rec"], ["t"]).first().sentence == "a b c b c"


def test_sampling(spark):
    df = spark.createDataFrame([(k, f"s{k % 3}") for k in range(30)], "k int, s string")
    got = sampling.capped_per_group(df, ["s"], "k", 2, 4).collect()
    assert len(got) == 4 and got == sampling.capped_per_group(df, ["s"], "k", 2, 4).collect()
    utts = spark.createDataFrame([(f"utt{k:02d}",) for k in range(1, 13)], "u string")
    assert sorted(r.u for r in sampling.blocks(utts, "u", 3).collect()) == ["utt09", "utt10", "utt11", "utt12"]
    assert sorted(r.u for r in sampling.blocks(utts, "u", 4).collect()) == ["utt01", "utt02", "utt03", "utt04"]
    order = sampling.spaced(df.withColumn("g", F.lit(1)), ["g"], "s", "k").orderBy("place").collect()
    assert [r.place for r in order] == list(range(30)) and sum(a.s == b.s for a, b in zip(order, order[1:], strict=False)) <= 2
    some = spark.createDataFrame([("p", f"r{k % 4}", f"s{k % 5}") for k in range(20)], "p string, r string, s string")
    got = sampling.distinct_sentences(some, "p", "r", "s", 3).collect()
    assert len(got) == 3 and len({r.r for r in got}) == 3 and len({r.s for r in got}) == 3


def test_report(spark):
    mapping = spark.createDataFrame([("i1", "experimental", "orig", "raw", ""), ("i2", "gold_high", "c", "clean", ">=4"), ("i3", "anchor_clean", "c", "clean", "")], "id string, role string, condition string, base string, expected_overall string")
    rows = [("a", "quality", "i1", 3.0, 3.0, 4.0), ("a", "quality", "i2", 5.0, 5.0, 5.0), ("b", "quality", "i1", 1.0, 1.0, 1.0), ("b", "quality", "i2", 1.0, 1.0, 1.0), ("b", "quality", "i3", 5.0, 5.0, 5.0), ("c", "wrong", "i1", 2.0, 2.0, 2.0), ("a", "quality", "zz", 1.0, 1.0, 1.0)]
    ratings = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "row_idx int, rater string, finalCheck string, id string, SIG double, BAK double, OVRL double")
    out = mos.report(ratings, mapping, ["row_idx"])
    assert {r.rater: r.flagged for r in out.raters.collect()} == {"a": False, "b": True, "c": True}
    assert [(r.dim, r["mean"], r.n) for r in out.table.where("dim = 'OVRL'").collect()] == [("OVRL", 4.0, 1)]
    assert out.headline.first().OVRL_raw == "4.00 (nan)" and out.anchors.first().OVRL == 5.0
    assert [tuple(r) for r in out.gold.collect()] == [("i2", 1, 1.0, ">=4")] and [tuple(r) for r in out.unknown.collect()] == [("zz", 1)]


def test_spectrogram(spark):
    """A tone is loudest in its own band; frames, bands and levels are those of a plain transform of each window."""
    import numpy as np

    rate, n = 8000, 2000
    x = np.sin(2 * np.pi * 1000 * np.arange(n) / rate)
    df = spark.createDataFrame([("a", x.tolist()), ("b", [])], "k string, v array<double>")
    out = {r.k: np.array(r.frames) for r in align.spectrogram(df, "k", "v", rate).collect()}
    size = max(128, 2 ** round(np.log2(0.008 * rate)))
    padded = np.pad(x, size // 2)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    want = np.array([np.abs(np.fft.rfft(padded[k : k + size] * window)) for k in range(0, len(padded) - size + 1, size // 8)])
    want = 20 * np.log10(np.maximum(want, 1e-10) / want.max())
    assert out["a"].shape == want.shape and np.allclose(out["a"], want, atol=1e-6) and out["a"].max() == 0
    assert (out["a"][5:-5].argmax(1) == round(1000 * size / rate)).all() and out["b"].shape[1] == size // 2 + 1


def test_triplets_by_brute_force(spark):
    """Small cells have every triplet there is, large ones as many different ones as are wanted."""
    from itertools import permutations

    items = [(k, f"s{k % 2}", "aabbbc"[k % 6]) for k in range(24)] + [(100, "s9", "a"), (101, "s9", "b")]
    df = spark.createDataFrame(items, "id int, speaker string, phoneme string")
    every = {}
    for s in {x[1] for x in items}:
        for x, a in permutations([i for i in items if i[1] == s], 2):
            for b in items:
                if x[2] == a[2] and b[1] == s and b[2] != x[2]:
                    every.setdefault((s, x[2], b[2]), set()).add((x[0], a[0], b[0]))
    for most in (3, 1000):
        got = {}
        for r in sampling.triplets(df, most=most).collect():
            got.setdefault((r.speaker, r.p, r.q), []).append((r.x_id, r.a_id, r.b_id))
        assert got.keys() == every.keys()
        for k, v in got.items():
            assert len(v) == len(set(v)) <= most and set(v) <= every[k] and (len(v) == min(most, len(every[k])) or len(every[k]) > 4 * most + 8)
        assert sampling.triplets(df, most=most).count() == sum(map(len, got.values()))
