"""Sentences searched in the words of recordings, against plain loops."""

import random
import re

from sonorium.operators import align, intervals


def alike(a, b):
    return a == b or any(x == y + end for x, y in ((a, b), (b, a)) for end in ("s", "'s"))


def plain(w):
    return w.translate(str.maketrans("’‘“”", "''\"\"")).replace("-", "")


def brute(words, sentences, window=5, extra=8):
    """(status, first, last) of each sentence with tokens; words and sentences are plain strings."""
    ws = [w.lower().strip("'\"") for w in words if w.strip()]
    at, out = 0, []
    for s in sentences:
        tokens = [t.lower().strip("'\"") for t in re.split(r"[^\w']+", s.translate(str.maketrans("’‘“”", "''\"\""))) if t]
        if not tokens:
            continue
        hit = None
        for begin in range(at, min(at + window, len(ws) - 1) + 1):
            j, n, used = begin, 0, []
            while n < len(tokens) and j < len(ws) and j - begin <= len(tokens) + extra:
                if alike(tokens[n], plain(ws[j])):
                    wide = 1
                elif j + 1 < len(ws) and alike(tokens[n], plain(ws[j] + ws[j + 1])):
                    wide = 2
                else:
                    j += 1
                    continue
                used.append((j, j + wide - 1))
                n, j = n + 1, j + wide
            if n == len(tokens):
                hit = used[0][0], used[-1][1]
                break
        if hit is None:
            out.append(("no_match", None, None))
            at += 1
        elif not alike(tokens[-1], ws[hit[1]]):
            out.append(("last_word_mismatch", None, None))
            at += 1
        else:
            out.append(("ok", float(hit[0]), hit[1] + 0.5))
            at = hit[0] + len(tokens)
    return out


def test_segments(spark):
    r = random.Random(3)
    vocabulary = ["a", "cat", "cats", "cat's", "dog", "re-do", "redo", "s", "don't", "élan", "“hi”", "out", "side", "outside", "'", ""]
    words, told, want = [], [], {}
    for k in range(60):
        ws = [r.choice(vocabulary) for _ in range(r.randint(0, 40))]
        ss = [" ".join(r.choice(vocabulary[:-1]) for _ in range(r.randint(0, 5))) + r.choice(["", ",", " -"]) for _ in range(r.randint(1, 9))]
        if k % 3 == 0:  # the words of the sentences, some of them lost
            ws = [w for s in ss for w in s.split(" ") if r.random() < 0.9]
        heard = [w for w in ws if w.strip()]
        words += [(f"f{k}", i, float(i), i + 0.5, w) for i, w in enumerate(heard)] + [(f"f{k}", 1000, 1000.0, 1000.5, " ")]
        told += [(f"f{k}", i, s) for i, s in enumerate(ss)]
        want[f"f{k}"] = brute(ws, ss)
    out = align.segments(spark.createDataFrame(words, "f string, pos int, xmin double, xmax double, label string"), spark.createDataFrame(told, "f string, pos int, sentence string"), "f").collect()
    got = {}
    for x in sorted(out, key=lambda x: (x.f, x.pos)):
        got.setdefault(x.f, []).append((x.status, x.t_start, x.t_end))
    assert got == {k: v for k, v in want.items() if v}
    assert {s for v in want.values() for s, _, _ in v} == {"ok", "no_match", "last_word_mismatch"}


def test_segments_without_words(spark):
    told = spark.createDataFrame([("x", 0, "some words"), (None, 0, "no file")], "f string, pos int, sentence string")
    words = spark.createDataFrame([], "f string, pos int, xmin double, xmax double, label string")
    assert sorted(r.status for r in align.segments(words, told, "f").collect()) == ["no_match", "no_match"]


def test_sentences_are_searched_without_a_shuffle(spark, tmp_path):
    """a document's words and sentences are searched where its row is."""
    from sonorium.plans import catalogue

    texts = ["The cat-s sat. On the mat, it 'was' good! Who? no one ran; ran off.", "one. two. one two three. three", "", None]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = catalogue.queries()["sentence_segments"](spark, str(tmp_path))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.doc_id, r.pos): (r.status, r.t_start, r.t_end) for r in out.collect()}
    for k, t in enumerate(texts[:2]):
        heard = [(i, w) for i, w in enumerate(t.split()) if i % 11 != 10]
        want = brute([w for _, w in heard], [x.strip() for x in re.split(r"[.!?;]", t) if x.strip()])
        at = lambda v, end, heard=heard: None if v is None else heard[int(v)][0] * 0.5 + 0.25 * end
        assert [got[k, i] for i in range(len(want))] == [(s, at(a, 0), at(b, 1)) for s, a, b in want]


def test_contained_by_brute_force(spark):
    r = random.Random(5)
    span = lambda longest: (a := round(r.uniform(0, 20), 2), round(a + r.choice([0, 0.1, r.uniform(0, longest)]), 2))
    words = [("f", k, *span(9), r.choice(["w", "v", ""])) for k in range(80)] + [("f", 90, None, None, "w"), ("g", 0, 1.0, 0.5, "w"), ("f", 91, 0.0, 2000.0, "all")]
    phones = [("f", k, *span(1), f"p{k}") for k in range(200)] + [("g", 0, 0.6, 0.9, "p"), ("f", 300, 3.0, 2.0, "turned")]
    schema = "file string, pos int, xmin double, xmax double, label string"
    out = {(x.file, x.pos): x.phones for x in intervals.contained(spark.createDataFrame(words, schema), spark.createDataFrame(phones, schema), ["file"]).collect()}
    want = {}
    for f, pos, a, b, label in words:
        if label:
            want[f, pos] = [p[4] for p in phones if a is not None and p[0] == f and p[2] <= p[3] and p[2] >= a - 1e-6 and p[3] <= b + 1e-6]
    assert out == want


def test_drop_with_a_rate_by_file(spark):
    r = random.Random(6)
    rows, want = [], {}
    for k, rate in enumerate((20, 100, 400)):
        x = [r.uniform(0.5, 1) for _ in range(150)] + [r.uniform(0, 0.4) for _ in range(50)]
        rows += [(f"f{k}", rate, i, v) for i, v in enumerate(x)]
        half = lambda v: int(v + 0.5)
        w, n = max(1, half(0.05 * rate)), len(x)
        level = [(sum(v * v for v in part) / len(part)) ** 0.5 for i in range(n) for part in [x[max(0, i - w // 2) : i + w - w // 2]]]
        end = n - half(min(7 * rate, 0.7 * n))
        least = min(level[half(0.5 * rate) - 1 : end], default=None)
        want[f"f{k}"] = next((i + 1 for i in range(end - 1, n) if least is not None and level[i] < 0.9 * least), None)
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "f string, rate int, idx long, sample double")
    assert {x.f: x.end_idx for x in intervals.drop_index(df, ["f"], F.col("rate")).collect()} == want


def test_holders_by_brute_force(spark):
    r = random.Random(7)
    text = lambda n: [r.choice("abc") for _ in range(n)]
    hays = [(k, text(r.randint(0, 40))) for k in range(80)]
    needles = [(k, text(n)) for k, n in enumerate((0, 1, 2, 3, 5, 8, 11, 20))] + [(50, hays[9][1][2:14]), (51, hays[3][1])]
    got = intervals.holders(spark.createDataFrame(hays, "d int, h array<string>"), "d", "h", spark.createDataFrame(needles, "i int, n array<string>"), "i", "n").distinct().collect()
    want = {(d, i) for d, h in hays for i, n in needles if any(h[at : at + len(n)] == n for at in range(len(h) - len(n) + 1))}
    assert {tuple(x) for x in got} == want


def test_batches_are_cut_by_elements(spark):
    """Python works on a bounded number of tokens at a time, and gets back no more columns than are wanted."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([["a"] * n for n in (3, 1, 0, 9, 2)] + [None]), pa.array([["b"]] * 6)], ["x", "y"])
    assert [p.num_rows for p in align._cut(batch, ["x", "y"], 6)] == [2, 1, 1, 2]
    df = spark.createDataFrame([(1, ["a", "b"], ["a"])], "k int, x array<string>, y array<string>")
    out = align.edit_counts(df, "x", "y", keep=["k"])
    assert out.columns == ["k", "s", "d", "i", "n_ref"] and [tuple(r) for r in out.collect()] == [(1, 0, 1, 0, 2)]
