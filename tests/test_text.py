from pyspark.sql import functions as F

from sonorium.functions import text as T


def values(spark, expression, rows, schema="x string"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).withColumn("_o", F.monotonically_increasing_id())
    return [r[0] for r in df.select(expression.alias("v"), "_o").orderBy("_o").collect()]


def test_labels(spark):
    rows = ["AE1", "ay0", "ay01", "IY2", " *HR ", "sil", "T", None]
    assert values(spark, T.phoneme("x"), rows) == ["æ", "aɪ", "aɪ", "i", "ər", None, None, None]


def test_keys(spark):
    assert values(spark, T.recording_key("x"), ["/a/corpus_MRI_m3_446_450_tracks.csv", "b_ema_c_mri_d.wav"]) == ["corpus_m3_446_450", "b_c_mri_d"]
    assert values(spark, T.set_name("x"), ["a_mri_cinema.wav"]) == ["a_<SET>_cin<SET>.wav"]
    assert values(spark, T.trailing_number("x"), ["rec_s1_20", "x", None]) == [20, None, None]
    assert values(spark, T.max_sentence("x"), ["corpus_f1_456_460", "f1_9", "460_456", "a"]) == [460, 9, 460, None]
    assert values(spark, T.stimulus("x"), ["corpus_f1_116_120", "116_120", "f1"]) == ["116_120", "116_120", None]


def test_ranges_and_inventory(spark):
    assert values(spark, T.expand_range("x"), ["120_116", "x", None, "3_3"]) == [[116, 117, 118, 119, 120], [], [], [3]]
    names = [f"f_{n}" for n in (1, 15, 21, 37, 38)]
    assert values(spark, T.within_inventory("x"), names) == [True, False, False, True, False]
    assert values(spark, T.within_inventory("x", 0), names) == [True] * 5
    assert values(spark, T.within_sentences("x"), ["a_450_455", "a_456_460", "a"]) == [True, False, False]


def test_words(spark):
    assert values(spark, T.word_key("x"), [" Ab ", None]) == ["ab", "nan"]
    pairs = [("don’t", "don't"), ("cats", "cat"), ("dog", "dog's"), ("re-do", "redo"), ("cat", "dog")]
    assert values(spark, T.fuzzy_equal("x", "y"), pairs, "x string, y string") == [True, True, True, True, False]
    assert values(spark, T.sentences("x"), [" A b. C!? ; d "]) == [["A b", "C", "d"]]
    assert values(spark, T.prompt_tokens("x"), ["It’s 9-fold, OK"]) == [["it's", "9", "fold", "ok"]]


def test_rules(spark):
    rows = [(">=4", 3.0), ("<=2", 2.0), ("", 5.0), (">=4", None), (" > 3 ", 3.0), ("=5", 5.0)]
    assert values(spark, T.expectation_fails("x", "y"), rows, "x string, y double") == [True, False, False, False, True, False]
    assert values(spark, T.attention_fails("x"), ["quality", "", "accent", None]) == [False, False, True, True]
    assert values(spark, T.alpha_tag("x"), [0.8, 0.7, 0.1, None], "x double") == ["good", "tentative", "low", "n/a"]
    assert values(spark, T.percent("x"), [0.12345, None], "x double") == ["12.35%", "n/a"]
    assert values(spark, T.half_even("x", 0), [0.5, 1.5, 2.5], "x double") == [0.0, 2.0, 2.0]
    assert values(spark, T.half_away("x"), [0.5, -0.5, 2.4], "x double") == [1, -1, 2]
    assert values(spark, T.numeric("x"), ["1.5", "a", "NaN", None]) == [1.5, None, None, None]
    assert values(spark, T.in_window("x", F.lit(0.0), F.lit(1.0)), [0.05, 0.06, 0.94, 0.95], "x double") == [False, True, True, False]
    assert values(spark, T.in_window("x", F.lit(0.0), F.lit(0.1)), [0.0, 0.1], "x double") == [True, True]
