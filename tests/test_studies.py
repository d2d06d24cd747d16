import numpy as np

from sonorium.plans import studies


def frames(spark, conditions=("ref", "x", "y")):
    g, rows = np.random.default_rng(1), []
    for c in conditions:
        for v in range(12):
            for k in range(6):
                f = [500 + 30 * v + 5 * k, 1500 - 20 * v, 2500 + 10 * k] + (np.zeros(3) if c == "ref" else g.normal(0, 20, 3))
                rows.append((c, "S1", f"{c}.csv", len(rows), f"corpus_mri_s1_{v // 4}_tracks", str(v), f"w{v % 3}", "p", "f", "AE1" if v % 2 else "iy", 0.1 * k, *map(float, f), 0.01 * (v % 5) + (0.001 if c == "x" else 0.0)))
    rows.append(("ref", "S1", "ref.csv", len(rows), "corpus_s1_9", "99", "w", "p", "f", "sil", 0.0, 1.0, 1.0, 1.0, None))
    return spark.createDataFrame(rows, "condition string, speaker string, file string, row_idx long, file_name string, id string, word string, pre_word string, fol_word string, label string, rel_time double, F1_s double, F2_s double, F3_s double, error double")


def test_formant_rmse(spark):
    out = studies.formant_rmse(frames(spark), "ref", ["x", "y"])
    assert out["long"].count() == 12 * 2 * 3 and out["excluded"].count() == 0
    assert {(r.formant, r.condition): r["count"] for r in out["summary"].collect()} == {(f, c): 12 for f in ("F1", "F2", "F3") for c in "xy"}
    assert [r.pair for r in out["wilcoxon"].collect()] == ["x-y"] * 3 and {r.n for r in out["friedman"].collect()} == {12}


def test_token_errors(spark):
    tokens = studies.token_errors(frames(spark))
    assert tokens.count() == 36
    out = studies.token_error_study(tokens, "ref", [("x", "y")])
    assert {r.condition: round(r.median_diff, 6) for r in out["unpaired"].collect()} == {"x": 0.001, "y": 0.0}
    assert [(r.pair, r.n_pairs, r.rank_biserial) for r in out["paired"].collect()] == [("x-y", 12, 1.0)]


def test_verification(spark):
    rows = [("f_1_2.TextGrid", "words", k, float(k), k + 1.0, w) for k, w in enumerate(["The", "sp", "cat", "sat"])] + [("f_1_2.TextGrid", "phones", 0, 2.0, 2.5, "k"), ("f_1_2.TextGrid", "phones", 1, 2.5, 3.0, "t")]
    schema = "file string, tier string, pos int, xmin double, xmax double, label string"
    a = spark.createDataFrame([*rows, ("g", "words", 0, 0.0, 1.0, "x")], schema)
    b = spark.createDataFrame([(f, t, p, x, y, {"sat": "sits", "t": "d"}.get(w, w)) for f, t, p, x, y, w in rows], schema)
    out = studies.compare_tiers(a, b)
    assert (out["wer"].first().errors, out["wer"].first().n_ref, out["per"].first().errors, out["per"].first().n_ref) == (1, 3, 1, 2)
    assert {r.file: r.side for r in out["files"].collect()} == {"f_1_2.TextGrid": "pair", "g": "left_only"}
    sentences = spark.createDataFrame([(1, ["the", "cat"]), (2, ["cat", "sat"])], "sid int, tokens array<string>")
    got = {r.sid: (r.in_a, r.in_b) for r in studies.sentence_identity(a, b, sentences).collect()}
    assert got == {1: (True, True), 2: (True, False)}


def test_abx(spark):
    v = studies.vowels(frames(spark, ("ref", "x")))
    items = v.selectExpr("condition", "vowel_id as id", "speaker", "phoneme", "track").cache()
    out = studies.abx(items, most=4, replicates=200)
    assert {r.condition for r in out["accuracy"].collect()} == {"ref", "x"} and all(0 <= r.accuracy_pooled <= 1 and r.n_triplets == 8 for r in out["accuracy"].collect())
    tests = studies.abx_tests(out["cells"], [("ref", "x")], 0.5)
    assert tests["paired"].count() == 1 and tests["against"].count() == 2


def test_phones_of_two_sides_are_dealt_once(spark):
    """words and phones meet in one shuffle each, and their occurrences in one more; the pairs are those of plain loops."""
    schema = "file string, tier string, pos int, xmin double, xmax double, label string"
    sides = []
    for lost in (7, 3):
        words = [(f"f{f}", "words", k, float(k), k + 0.9, "ab"[k % 2]) for f in range(3) for k in range(20) if k % lost]
        phones = [(f"f{f}", "phones", 10 * k + j, k + j / 10, k + j / 10 + 0.1, "xyz"[(k + j) % 3]) for f in range(3) for k in range(20) for j in range(4)]
        sides.append(words + phones)
    a, b = (spark.createDataFrame(rows, schema) for rows in sides)
    out = studies.compare_tiers(a, b)["phones"]
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 3
    heard = lambda rows, f, w: [[p[5] for p in rows if p[:2] == (f, "phones") and p[2] // 10 == r[2]] for r in rows if r[:2] == (f, "words") and r[5] == w]
    want = sorted((f"f{f}", w, k, x, y) for f in range(3) for w in "ab" for k, (x, y) in enumerate(zip(heard(sides[0], f"f{f}", w), heard(sides[1], f"f{f}", w), strict=False)))
    assert sorted((r.file, r.word, r.occurrence, r.a_phones, r.b_phones) for r in out.collect()) == want
