"""Whole studies: each takes tables that the readers give and returns result tables by name."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from tempfile import mkdtemp

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import align, intervals, pairing, sampling, stats
from ..operators.ranking import medians

FORMANTS = ["F1_s", "F2_s", "F3_s"]


def kept(df: DataFrame) -> DataFrame:
    """df, checkpointed: what is read several times is made once, in the folder that all executors share."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        sc.setCheckpointDir(mkdtemp())
    return df.checkpoint()


def vowels(frames: DataFrame, formants: list[str] | None = None) -> DataFrame:
    """One row per vowel: condition, the track key, vowel_id, raw_label, track.

    Frames without numbers or with a label that is no vowel go; so do vowels of fewer
    than three frames.  Of two vowels with one key the one read last stays.
    """
    formants = formants or FORMANTS
    rows = frames.dropna(subset=["rel_time", *formants]).withColumns({"recording": text.recording_key("file_name"), "phoneme": text.phoneme("label"), **{w: text.word_key(w) for w in ("word", "pre_word", "fol_word")}})
    unit = ["condition", "speaker", "file", "recording", "id"]
    nested = pairing.nest_tracks(rows.where("phoneme is not null"), unit, formants, ["word", "pre_word", "fol_word", "label", "phoneme"])
    nested = nested.withColumn("_t0", F.col("track")[0]["rel_time"]).withColumnsRenamed({"id": "vowel_id", "label": "raw_label"})
    slot = ["condition", "speaker", "file", "recording", "pre_word", "word", "fol_word", "phoneme"]
    return pairing.last_write(pairing.ordinal(nested, slot, ["_t0", "vowel_id"]), ["condition", *pairing.TRACK_KEY], ["file", "_t0", "vowel_id"]).drop("_t0", "file")


def formant_rmse(frames: DataFrame, reference: str, others: list[str], scale: str = "zscore", formants: list[str] | None = None) -> dict[str, DataFrame]:
    """long (key, condition, formant, rmse_hz), summary, friedman, wilcoxon (with p_holm), excluded (with reasons)."""
    formants = formants or FORMANTS
    v = vowels(frames, formants)
    ref, rest = v.where(F.col("condition") == reference).drop("condition"), v.where(F.col("condition").isin(*others))
    key = pairing.TRACK_KEY
    # Joined before anything is aligned: a vowel that a condition lacks costs no alignment.
    both = ref.join(pairing.in_all(rest, key, "condition", len(others)), key).join(rest.select(*key, "condition", F.col("track").alias("_other")), key)
    wide = align.warped_rmse(both.select(*key, "vowel_id", "raw_label", "condition", "track", "_other"), "track", "_other", formants, scale)
    long = wide.unpivot([*key, "vowel_id", "raw_label", "condition"], [f"rmse_{f}" for f in formants], "formant", "rmse_hz").withColumn("formant", F.regexp_replace("formant", "^rmse_(.*?)(_s)?$", "$1"))
    block = [*key]
    a = long.select(*block, "formant", F.col("condition").alias("_a"), F.col("rmse_hz").alias("_x"))
    b = long.select(*block, "formant", F.col("condition").alias("_b"), F.col("rmse_hz").alias("_y"))
    order = F.create_map(*(x for i, o in enumerate(others) for x in (F.lit(o), F.lit(i))))
    pairs = a.join(b, [*block, "formant"]).where(order[F.col("_a")] < order[F.col("_b")]).select("formant", F.concat_ws("-", "_a", "_b").alias("pair"), (F.col("_x") - F.col("_y")).alias("_d"))
    slot = [c for c in key if c not in ("phoneme", "in_word_index")]
    return {
        "long": long,
        "summary": stats.summary(long, ["formant", "condition"], "rmse_hz"),
        "friedman": stats.guarded(stats.friedman(long, ["formant"], block, "condition", "rmse_hz"), "n", ["chi2", "p"]),
        "wilcoxon": stats.holm(stats.wilcoxon(pairs, ["formant", "pair"], "_d"), ["formant"], "p"),
        "excluded": pairing.exclusion_reasons(ref.select(*key, "vowel_id"), rest.select(*key, "condition"), slot, "phoneme", len(others)),
    }


def unmapped_units(frames: DataFrame) -> DataFrame:
    """recording, n: the units (recording, id) with a label that no phoneme stands for."""
    rows = frames.withColumn("recording", text.recording_key("file_name")).where(text.phoneme("label").isNull())
    return rows.groupBy("recording").agg(F.countDistinct("id").alias("n"))


def token_errors(frames: DataFrame) -> DataFrame:
    """condition, speaker, recording, vowel_id, error: the first error of each token in reading order."""
    rows = frames.withColumn("recording", text.recording_key("file_name")).where(F.col("error").isNotNull())
    return rows.groupBy("condition", "speaker", "recording", F.col("id").alias("vowel_id")).agg(F.min_by("error", F.struct("file", "row_idx")).alias("error"))


def token_error_study(tokens: DataFrame, reference: str, paired: list[tuple[str, str]], least: int = 8) -> dict[str, DataFrame]:
    """summary; unpaired tests of each condition against the reference; paired tests of conditions on the same tokens.

    Pairs with fewer than `least` tokens in common have no test.
    """
    sample = tokens.select("condition", "error")
    against = stats.mann_whitney_against(sample.where(F.col("condition") != reference), ["condition"], "error", sample.where(F.col("condition") == reference))
    key = ["speaker", "recording", "vowel_id"]
    side = lambda c, n: tokens.where(F.col("condition") == c).select(*key, F.col("error").alias(n))
    parts = [side(x, "_x").join(side(y, "_y"), key).select(F.lit(f"{x}-{y}").alias("pair"), (F.col("_x") - F.col("_y")).alias("_d")) for x, y in paired]
    out = {"summary": stats.summary(tokens, ["condition"], "error"), "unpaired": stats.holm(against.withColumn("_f", F.lit(1)), ["_f"], "p").drop("_f")}
    if parts:
        rows = reduce(DataFrame.unionByName, parts)
        enough = rows.groupBy("pair").agg(F.count("*").alias("n_pairs")).where(F.col("n_pairs") >= least)
        tested = stats.wilcoxon(rows.join(enough.select("pair"), "pair"), ["pair"], "_d")
        out["paired"] = stats.holm(enough.join(tested, "pair").withColumn("_f", F.lit(1)), ["_f"], "p").drop("_f")
    return out


def abx(items: DataFrame, most: int = 5, replicates: int = 2000, seed: int = 0, fields: list[str] | None = None) -> dict[str, DataFrame]:
    """cells, accuracy, interval and sem of items (condition, id, speaker, phoneme, track), which are read several times: pass a written table.

    Triplets are made once, of the items that every condition has, with the labels of
    the first condition by name; each condition scores them with its own tracks.
    """
    fields = fields or FORMANTS
    conditions = sorted(r["condition"] for r in items.select("condition").distinct().collect())
    shared = kept(items.join(pairing.in_all(items, ["id"], "condition", len(conditions)), "id"))
    chosen = kept(sampling.triplets(shared.where(F.col("condition") == conditions[0]) if conditions else shared, most=most, seed=seed))
    scored = []
    for c in conditions:
        own = shared.where(F.col("condition") == c)
        d = align.pair_distances(chosen, own, "track", lambda x: align.warped_divergence(x, "_x", "_y", fields))
        scored.append(align.abx_scores(chosen, d).withColumn("condition", F.lit(c)))
    if not scored:
        raise ValueError("no items")
    all_ = reduce(DataFrame.unionByName, scored)
    cells = align.abx_cells(all_, ["condition"])
    return {"cells": cells, "accuracy": align.abx_accuracy(cells, ["condition"]), "interval": stats.bootstrap(all_, ["condition"], "score", replicates, seed), "sem": stats.standard_error(cells, ["condition"], "score")}


def abx_tests(cells: DataFrame, pairs: list[tuple[str, str]], baseline: float | None = None) -> dict[str, DataFrame]:
    """Signed-rank tests of cells: between two conditions (second less first), and of each against one accuracy."""
    key = ["speaker", "p", "q"]
    side = lambda c, n: cells.where(F.col("condition") == c).select(*key, F.col("score").alias(n))
    out = {}
    if pairs:
        rows = reduce(DataFrame.unionByName, [side(x, "_x").join(side(y, "_y"), key).select(F.lit(f"{x}-{y}").alias("pair"), (F.col("_y") - F.col("_x")).alias("_d")) for x, y in pairs])
        found = stats.wilcoxon(rows, ["pair"], "_d").join(medians(rows, ["pair"], "_d", "median_diff"), "pair")
        out["paired"] = stats.holm(found.withColumn("direction", text.direction("median_diff")).withColumn("_f", F.lit(1)), ["_f"], "p").drop("_f")
    if baseline is not None:
        found = stats.wilcoxon_against(cells, ["condition"], "score", F.lit(baseline))
        out["against"] = stats.holm(found.withColumn("_f", F.lit(1)), ["_f"], "p").drop("_f")
    return out


def pair_names(conditions: list[str]) -> list[tuple[str, str]]:
    return list(combinations(conditions, 2))


def compare_tiers(a: DataFrame, b: DataFrame) -> dict[str, DataFrame]:
    """Two annotations of the same files (file, tier, pos, xmin, xmax, label; a is the reference).

    words: by file both sequences, their edit counts and whether they differ; phones:
    by word occurrence the same; wer and per: rates from summed counts.  Files that
    one side lacks are in `files`.
    """
    spoken = lambda d, n: d.where((F.col("tier") == "words") & ~text.silent("label", text.SILENT_TIER)).groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.lower("label").alias("l")))), lambda x: x["l"]).alias(n))
    words = align.edit_counts(spoken(a, "a_words").join(spoken(b, "b_words"), "file"), "a_words", "b_words").withColumn("differ", F.col("a_words") != F.col("b_words"))
    # Both sides at once, dealt by file and word, where their occurrences meet.
    both = a.withColumn("_side", F.lit("a")).unionByName(b.select(*a.columns).withColumn("_side", F.lit("b")))
    inside = intervals.contained(both.where("tier = 'words'"), both.where("tier = 'phones'"), ["file", "_side"], deal=["file", "word"])
    phones = pairing.paired_occurrences(inside, ["file"], "word", ["pos"], "phones")
    phones = align.edit_counts(phones, "a_phones", "b_phones").withColumn("differ", F.col("a_phones") != F.col("b_phones"))
    one = lambda d: align.error_rate(d.withColumn("_g", F.lit(1)), ["_g"]).drop("_g")
    return {"words": words, "phones": phones, "wer": one(words), "per": one(phones), "files": pairing.orphans(a, b, ["file"])}


def sentence_identity(a: DataFrame, b: DataFrame, sentences: DataFrame) -> DataFrame:
    """file, stimulus, sid, in_a, in_b: whether each side's words hold the sentences that the file's name promises.

    A side that lacks the file has null; an expected sentence that is not listed is held by all.
    """
    spoken = lambda d, n: d.where((F.col("tier") == "words") & ~text.silent("label", text.SILENT_TIER)).groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.lower("label").alias("l")))), lambda x: x["l"]).alias(n))
    both = spoken(a, "_a").join(spoken(b, "_b"), "file", "full").withColumn("stimulus", text.stimulus(text.stem("file")))
    rows = both.withColumn("sid", F.explode(text.expand_range("stimulus"))).join(sentences.select(F.col("sid").cast("long").alias("sid"), "tokens"), "sid", "left")
    needle = F.coalesce("tokens", F.array().cast("array<string>"))
    held = lambda c: F.when(F.col(c).isNotNull(), intervals.contains(c, needle))
    return rows.select("file", "stimulus", "sid", held("_a").alias("in_a"), held("_b").alias("in_b"))
