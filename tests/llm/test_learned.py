"""Operators that learn: held-out accuracy, edge cases, exact base figures."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sonorium.llm import classlm, language, ogg, quality, rules, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(i, by):
    return zlib.crc32(str(i).encode()) % by


def test_quality(corpus, edges, none, marks):
    docs, labels = corpus
    truth = {r.doc_id: r.quality for r in labels.collect()}
    out = quality.op2(docs, labels).collect()
    assert len(out) == 400 and all(r.held_out == (remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in out)
    held = [r.predicted == truth[r.doc_id] for r in out if r.held_out]
    assert sum(held) / len(held) > 0.95
    assert quality.op2(edges, marks).count() == 10 and quality.op2(none, marks).count() == 0
    assert {r.score for r in quality.op2(edges, labels.limit(0)).collect()} and quality.op2(none, labels.limit(0)).count() == 0


def test_network_gradient():
    net = quality.Network(1)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    texts = [b"abc def GHI! " * 30, b"", b"x" * 700]
    x = quality.Layout(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
    label, weight = np.array([1, 0, 1]), np.ones(3)
    loss = lambda: -np.mean(label * np.log(s := net.forward(x)[0]) + (1 - label) * np.log(1 - s))
    for name, g in net.gradients(x, label, weight).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-5
        up = loss()
        net.p[name][at] = old - 1e-5
        assert abs((up - loss()) / 2e-5 - g[at]) < 1e-4
        net.p[name][at] = old


def test_toxicity(corpus, edges, none, marks):
    docs, labels = corpus
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    out = toxicity.op8(docs, labels).collect()
    held = [r.predicted == truth[r.doc_id] for r in out if r.held_out]
    assert len(out) == 400 and sum(held) / len(held) > 0.95
    assert toxicity.op8(edges, marks).count() == 10 and toxicity.op8(none, marks).count() == 0
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns
    assert sum(truth[r.doc_id] for r in kept.collect()) <= 4 and kept.count() >= 312
    assert toxicity.clean(edges, marks).columns == edges.columns
    odd = edges.withColumnsRenamed({"lang": "a.b", "source": "c`d"})
    assert toxicity.clean(odd, marks).columns == odd.columns and toxicity.clean(odd, marks).count() == toxicity.clean(edges, marks).count()
    assert toxicity.fit([]).score(pa.array(["a", None])).tolist() == [0.5, 0.5]


def test_language(corpus, edges, none):
    docs, _ = corpus
    truth = {r.doc_id: r.lang for r in docs.collect()}
    out = language.op3(docs).collect()
    assert all(r.lang_pred == truth[r.doc_id] for r in out if r.held_out)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.op3(edges).collect()}
    assert got[1] == got[2] == got[3] == got[6] == ("und", 0.0)
    assert got[7][0] != "und" and all(0 <= s <= 1 for _, s in got.values())
    assert language.op3(none).count() == 0 and {r.lang_pred for r in language.op3(docs.limit(3).selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def test_filters_have_no_false_negative():
    r = np.random.default_rng(0)
    entries = [np.unique(r.integers(0, 1 << 32, 3000)).astype(np.uint64) for _ in range(3)]
    f = language.Filters(["a", "b", "c"], entries, slots=1 << 14)
    for b, e in enumerate(entries):
        assert ((f.hits(e)[0] >> b) & 1).all()
    other = np.unique(r.integers(1 << 33, 1 << 34, 20000)).astype(np.uint64)
    for b in range(3):
        assert abs(((f.hits(other)[0] >> b) & 1).mean() - f.false[b]) < 0.02


def test_many_languages(spark):
    """More languages than a word of a mask has bits: each is learned and told."""
    rows = [(k * 10 + j, " ".join(chr(0x4E00 + 3 * k + (i * j) % 3) * 3 for i in range(9)), f"l{k:03}") for k in range(150) for j in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r.lang_pred for r in language.identify(df, language.learn(df)).collect()}
    assert len(set(out.values())) == 150 and all(out[i] == lang for i, _, lang in rows)
    covered = language.learn(df).covered
    assert len(covered) == 150 and min(covered) > 0.99


def brute_scores(f, text):
    """The corrected counts of a text, an n-gram at a time."""
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode() + b"   ")
    low = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in low)
    found = [low[i : i + 4] for i in range(len(low) - 3) if low[i] != 32 or low[i + 3] != 32]
    counts = []
    for k in range(len(f.names)):
        hits = 0
        for g in found:
            at = language._slots(np.array([int.from_bytes(g, "big")], np.uint64), f.slots, f.hashes)
            hits += all(int(f.masks[k // 64][x[0]]) >> k % 64 & 1 for x in at)
        counts.append(max(0, hits - f.false[k] * len(found)) / (1 - f.false[k]))
    return counts


def test_language_scores_by_brute_force(corpus):
    docs, _ = corpus
    f = language.learn(docs)
    some = docs.limit(12).collect()
    _, got = f.score(*language._padded(pa.array([r.text for r in some])))
    assert np.allclose(got, [brute_scores(f, r.text) for r in some])


def brute_ftrl(rows, size):
    """The weights after the same passes, a coordinate at a time."""
    z, n = [0.0] * size, [0.0] * size
    weight = lambda i: 0.0 if abs(z[i]) <= toxicity.L1 else (math.copysign(toxicity.L1, z[i]) - z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)
    for epoch in range(toxicity.EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            label, at = rows[k]
            at = [*at, size - 1]
            w = {i: weight(i) for i in at}
            g = (1 / (1 + math.exp(-sum(w.values()))) - label) * (toxicity.POSITIVE if label else 1)
            for i in at:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
                n[i] += g * g
    return {i: weight(i) for i in range(size) if weight(i)}


def test_ftrl_by_brute_force():
    r = np.random.default_rng(5)
    rows = [(int(k % 4 == 0), np.unique(np.append(r.integers(0, 60, 6), 60 if k % 4 == 0 else 61))) for k in range(300)]
    model, want = toxicity.fit(rows, bits=6), brute_ftrl(rows, 65)
    got = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True)) | ({64: model.bias} if model.bias else {})
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def brute_forward(net, text):
    """The network's score of one text, with loops over places and filters."""
    p, unit = net.p, quality.STEP * quality.HALF
    halves = max(1, -(-len(text) // unit)) + 1
    data = list(text) + [0] * ((halves + 1) * unit - len(text))
    act = []
    for i in range(halves * quality.HALF):
        row = []
        for f in range(quality.FILTERS):
            total = float(p["bias"][f])
            for tap in range(quality.TAPS):
                seen = np.concatenate([p["embed"][data[(i + tap) * quality.STEP + j]] for j in range(quality.STEP)])
                total += float(seen.astype(float) @ p["filters"][:, tap * quality.FILTERS + f].astype(float))
            row.append(max(total, 0.0))
        act.append(row)
    act = np.array(act)
    mean = [act[h * quality.HALF : (h + 1) * quality.HALF].mean(0) for h in range(halves)]
    hidden = [np.maximum((mean[h] + mean[h + 1]) / 2 @ p["dense"] + p["dense_bias"], 0) for h in range(halves - 1)]
    pooled = np.concatenate([np.max([*hidden, np.zeros(quality.HIDDEN)], 0), act.max(0)])
    return 1 / (1 + math.exp(-float(pooled @ p["out"] + p["out_bias"][0])))


def test_network_by_brute_force():
    net = quality.Network(4)
    texts = ["", "short", "a longer text, " * 9, "é" * 100]
    got = net.score(pa.array(texts))
    assert np.allclose(got, [brute_forward(net, t.encode()) for t in texts], atol=1e-4)
    # What stands beside a text in a batch does not count.
    assert all(abs(net.score(pa.array([t, "other words"]))[0] - net.score(pa.array(["x", t]))[1]) < 1e-6 for t in texts)


def test_learning_is_bounded(spark, monkeypatch):
    """Rows with one id are one document, and what is learned from has a bound in bytes."""
    from sonorium.llm import common

    docs = spark.createDataFrame([(k % 40, f"text {k:03} " * 10) for k in range(400)], "doc_id long, text string")
    marks = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    rows = common.labelled_sample(docs, marks, "toxic", 4, 2, 1000).collect()
    assert len(rows) == len({r.doc_id for r in rows}) and all(r.text.startswith(f"text {r.doc_id + 360:03}") for r in rows)
    assert common.labelled_sample(docs, marks, "toxic", 4, 2, 5).count() == 5
    monkeypatch.setattr(common, "MOST_BYTES", 250)
    assert common.labelled_sample(docs, marks, "toxic", 4, 2, 1000).count() == 2


@pytest.mark.parametrize("op", [lambda d, m: quality.op2(d, m), lambda d, m: language.op3(d), lambda d, m: ogg.op4(d), lambda d, m: classlm.op6(d), lambda d, m: rules.op7(d), lambda d, m: toxicity.op8(d, m)])
def test_ids_are_integers(spark, marks, op):
    with pytest.raises(TypeError, match="doc_id must be an integer"):
        op(spark.createDataFrame([("ab", "x", "en")], "doc_id string, text string, lang string"), marks)


def brute_base(rows):
    tokens = {k: [*WORD.findall((t or "").translate(LOW)), None] for k, (_, t) in enumerate(rows)}
    count = Counter(x for k, (i, _) in enumerate(rows) if i is None or remainder(i, 5) != 1 for x in tokens[k])
    n, v = sum(count.values()), len(count)
    return n, {k: (len(w), sum(x in count for x in w), sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for k, w in tokens.items()}


def check_lm(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    n, want = brute_base(rows)
    out = classlm.op6(df).collect()
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out)
    assert got == sorted((str(i), *want[k][:2], round(want[k][2], 6)) for k, (i, _) in enumerate(rows))
    assert all(r.train_tokens == n and r.score < 0 for r in out)
    return out


def test_class_model(corpus, edges, none, monkeypatch):
    docs, _ = corpus
    out = check_lm(docs)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    # With a coarse bound most words come by the join; nothing else changes.
    monkeypatch.setattr(classlm, "WIDE", 2e-3)
    monkeypatch.setattr(classlm, "NARROW", 4e-3)
    monkeypatch.setattr(classlm, "LEAST", 1)
    check_lm(docs)
    check_lm(edges)
    assert classlm.op6(none).count() == 0


def test_exchange_gains(spark):
    """The gain of a move is the difference of the likelihoods before and after it, counted anew; rounds never lower it."""
    r = np.random.default_rng(3)
    v, classes, open_ = 14, 4, 2
    text = r.integers(0, v + open_, 3000)
    kinds = np.concatenate([r.integers(0, classes, v), classes + np.arange(open_)])
    many = classes + open_

    def table(k):
        out = np.zeros((many, many))
        np.add.at(out, (k[text[:-1]], k[text[1:]]), 1)
        return out

    word, side, kind, n, own = [], [], [], [], np.zeros(v)
    for w in range(v):
        for s, a, b in ((0, text[1:], text[:-1]), (1, text[:-1], text[1:])):
            c = np.bincount(kinds[b[a == w]], minlength=many)
            word, side, kind, n = word + [w] * many, side + [s] * many, kind + list(range(many)), n + list(c)
        own[w] = ((text[:-1] == w) & (text[1:] == w)).sum()
    n = np.array(n, float)
    some = n > 0
    best, gain = classlm.exchange(kinds[:v], np.array(word)[some], np.array(side)[some], np.array(kind)[some], n[some], own, table(kinds), classes)
    was = classlm.likelihood(table(kinds))
    for w in range(v):
        every = []
        for c in range(classes):
            to = kinds.copy()
            to[w] = c
            every.append(classlm.likelihood(table(to)) - was)
        assert abs(max(every) - gain[w]) < 1e-6 and abs(every[best[w]] - gain[w]) < 1e-6


def test_likelihood_never_falls(corpus, monkeypatch):
    monkeypatch.setattr(classlm, "LEAST", 3)
    docs, _ = corpus
    counts = classlm.count_words(docs).where("hash <> 0").toArrow()
    h, n = (np.asarray(counts[k].combine_chunks(), np.int64) for k in ("hash", "n"))
    words = classlm.Lookup(h.view(np.uint64), n, np.where(n >= 3, -1, classlm.CLASSES).astype(np.int8))
    told = []
    kinds, table = classlm.cluster(docs, words, classes=8, rounds=5, told=told)
    assert told == sorted(told) and told[-1] > told[0] and abs(classlm.likelihood(table) - told[-1]) < 1e-6 * abs(told[-1])
    assert set(kinds[words.values[1] < 0]) <= set(range(8))


def test_class_model_sums_to_one(corpus):
    docs, _ = corpus
    model, counts = classlm.learn(docs)
    kinds = np.concatenate([model.words.values[1], [model.classes - 1]])
    n = np.concatenate([model.words.values[0], [model.total[-1]]]).astype(float)
    within = np.bincount(kinds, 10 ** model.emission(n, kinds), model.classes)
    # What a class leaves is half a count for an unknown word.
    for k in np.unique(kinds):
        assert abs(within[k] + 0.5 / (model.total[k] + 0.5 * (model.kinds[k] + 1)) - 1) < 1e-9
    assert np.allclose((10**model.move).sum(1), 1)


def test_rare_words_are_clustered_by_their_endings(spark):
    """Words that occur once, of two kinds that alternate, are told apart: the class of their ending is the exchange's, and so is an unknown word's."""
    r = np.random.default_rng(5)
    word = lambda end: "".join(chr(97 + k) for k in r.integers(0, 26, 8)) + end
    docs = spark.createDataFrame([(k, " ".join(word(("za", "zo")[j % 2]) for j in range(60))) for k in range(60)], "doc_id long, text string")
    model, counts = classlm.learn(docs)
    assert counts.where("n > 1 and hash <> 0").count() == 0
    known = model.words.values[1]
    assert known.max() < classlm.CLASSES and len(set(known)) == 2
    a, o = (model.class_of(classlm.tokens(pa.array(["new" + e]))[0][:1], np.array([-1]))[0] for e in ("za", "zo"))
    assert {a, o} == set(known)
    # One kind follows the other.
    assert model.move[a, o] > -0.1 and model.move[o, a] > -0.1 and model.move[a, a] < -2


def brute_counts(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(cover)


def test_rules(spark, corpus, edges, none):
    more = spark.createDataFrame([(20, "a b c\na b c\n \nx a b c"), (21, "\n\nq\nq\n"), (22, "same\nsame\nother\nsame")], "doc_id long, text string")
    for df in (edges, more.selectExpr("*", "cast(null as string) as lang"), corpus[0]):
        rows = {(r.doc_id, r.text): 0 for r in df.select("doc_id", "text").collect()}
        got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.op7(df).collect()}
        assert got == {(i, *brute_counts(t)) for i, t in rows}
    out = {r.doc_id: r for r in rules.op7(corpus[0]).collect()}
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in out.values())
    assert sum(r.kept for k, r in out.items() if k % 7) > 330 and rules.op7(none).count() == 0


@pytest.mark.parametrize("share", [0.0, 1e-4, 1e-2])
def test_kneser_ney_sums_to_one(corpus, share):
    """With all n-grams and with those of a share: what is left out backs off, and nothing is lost."""
    model = rules.learn(corpus[0], share=share)
    for context in (b"\0\0\0", b"la ", b"zzz", b"ba\xff", b" kr", b"o l"):
        code = int.from_bytes(context, "big") * 256 + np.arange(256, dtype=np.uint32)
        assert abs(np.exp2(model.logs(code.astype(np.uint32)).astype(float)).sum() - 1) < 1e-4


def test_rare_grams_are_measured_by_the_whole_model(spark, corpus, edges, none, monkeypatch):
    """Texts have the same bits whatever number of n-grams is broadcast: the others come by the join."""
    docs = corpus[0].select("doc_id", "lang", "text").union(edges.select("doc_id", "lang", "text"))
    model = rules.learn(docs, share=0.0)
    code, off = rules.packed(*rules.buffer(pa.array([r.text for r in docs.collect()])))
    logs = np.split(model.logs(code).astype(float), off[1:-1])
    want = sorted(-x.mean() for x in logs if len(x))
    for most in (2_000_000, 300, 20, 0):
        monkeypatch.setattr(rules, "MOST", most)
        assert len(rules.learn(docs).grams[rules.ORDER][0]) <= max(1, most)
        out = rules.op7(docs).collect()
        assert len(out) == len(logs) and np.allclose(sorted(r.bits for r in out if r.bits is not None), want, atol=1e-5)
    assert rules.op7(none).count() == 0


def test_bands_reject_what_is_far_out(spark):
    """A text 7 deviations from the median is out on both sides, one of 4 is in."""
    df = spark.createDataFrame([("xx", 2 + k / 100, False) for k in range(-10, 11)], "lang string, bits double, base_failed boolean")
    own, deviation = rules.bands(df).first(), 1.4826 * 0.05
    assert own.upper < 2 + 7 * deviation and own.lower > 2 - 7 * deviation
    assert own.upper > 2 + 4 * deviation and own.lower < 2 - 4 * deviation
