"""Pairing of recordings, tracks and tokens across conditions, and set comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import meet

#: What makes two vowels of different conditions the same one.
TRACK_KEY = ["speaker", "recording", "pre_word", "word", "fol_word", "phoneme", "in_word_index"]


def first_by(df: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """One row of each group, the first in an order that must be total."""
    own = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_i", F.row_number().over(own)).where("_i = 1").drop("_i")


def last_write(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the one that came last."""
    return first_by(df, by, [F.col(c).desc() for c in order])


def nest_tracks(frames: DataFrame, by: list[str], values: list[str], carry: list[str], order: str = "rel_time", tie: str = "row_idx", least: int = 3) -> DataFrame:
    """Frames of each unit as one array `track`, sorted by time; `carry` is taken from the first frame.

    Units of fewer than `least` frames, and frames whose key is null, are left out.
    """
    rows = frames.where(" and ".join(f"`{c}` is not null" for c in by))
    nested = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order, tie, *values))).alias("track"), F.min_by(F.struct(*carry), F.struct(order, tie)).alias("_c"))
    return nested.where(F.size("track") >= least).select(*by, *(F.col(f"_c.{c}").alias(c) for c in carry), "track")


def ordinal(df: DataFrame, by: list[str], order: list[str], out: str = "in_word_index") -> DataFrame:
    """0, 1, ... within a group: the k-th occurrence pairs with the k-th."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def in_all(df: DataFrame, key: list[str], condition: str, conditions: int) -> DataFrame:
    """Keys that every condition has (relational division)."""
    return df.groupBy(*key).agg(F.countDistinct(condition).alias("_n")).where(F.col("_n") == conditions).select(*key)


def pair_all(df: DataFrame, key: list[str], condition: str, conditions: list[str], value: str, total: str = "first") -> DataFrame:
    """Wide rows: key and one column per condition; a key that lacks one is left out.  One shuffle, however many conditions."""
    wide = df.groupBy(*key).pivot(condition, conditions).agg(F.expr(f"{total}(`{value}`)"))
    return wide.dropna(subset=conditions)


def exclusion_reasons(reference: DataFrame, others: DataFrame, slot: list[str], phoneme: str, conditions: int) -> DataFrame:
    """For rows of reference without a partner in every condition, why: reason.

    No word slot there: different_word_context; the phoneme is in the slot of each
    condition that lacks the row: phoneme_count_mismatch; else different_phoneme.
    others: slot, phoneme, condition, in_word_index.
    """
    key = [*slot, phoneme, "in_word_index"]
    found = others.groupBy(*key).agg(F.countDistinct("condition").alias("_n"))
    slots = others.groupBy(*slot).agg(F.countDistinct("condition").alias("_slots"))
    kinds = others.groupBy(*slot, phoneme).agg(F.countDistinct("condition").alias("_kinds"))
    rows = reference.join(found, key, "left").where(F.coalesce("_n", F.lit(0)) < conditions).join(slots, slot, "left").join(kinds, [*slot, phoneme], "left")
    reason = F.when(F.coalesce("_slots", F.lit(0)) < conditions, "different_word_context").when(F.coalesce("_kinds", F.lit(0)) >= conditions, "phoneme_count_mismatch").otherwise("different_phoneme")
    return rows.select(*reference.columns, reason.alias("reason"))


def set_report(df: DataFrame, by: list[str], source: str, name: str, sources: list[str]) -> DataFrame:
    """by, name, one boolean per source, and all: one full comparison of sets in one shuffle."""
    flags = [F.bool_or(F.col(source) == s).alias(s) for s in sources]
    return df.groupBy(*by, name).agg(*flags).withColumn("all", F.lit(True) if not sources else F.expr(" and ".join(f"`{s}`" for s in sources)))


def set_counts(df: DataFrame, by: list[str], source: str, name: str, sources: list[str]) -> DataFrame:
    """by, n_all (in every set), n_any, equal (all sets are one), and only_<s>: in no other."""
    report = set_report(df, by, source, name, sources)
    seen = sum((F.col(s).cast("int") for s in sources[1:]), F.col(sources[0]).cast("int"))
    only = [F.count_if(F.col(s) & (seen == 1)).alias(f"only_{s}") for s in sources]
    return report.groupBy(*by).agg(F.count_if("all").alias("n_all"), F.count("*").alias("n_any"), F.bool_and("all").alias("equal"), *only) if by else report.agg(F.count_if("all").alias("n_all"), F.count("*").alias("n_any"), F.bool_and("all").alias("equal"), *only)


def listing(df: DataFrame, by: list[str], name: str, most: int = 5) -> DataFrame:
    """by, listed: the first names in order and how many more there are; no task holds more of a group than those."""
    names = df.select(*by, name).where(F.col(name).isNotNull()).distinct()
    first = names.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(name))).where(F.col("_i") <= most)
    first = first.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list(name)), ", ").alias("_first"))
    sizes = df.groupBy(*by).agg(F.countDistinct(name).alias("_n"))
    more = F.when(F.col("_n") > most, F.concat(F.lit(" +"), (F.col("_n") - most).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return meet(sizes, first, by, "left").select(*by, F.concat(F.coalesce("_first", F.lit("")), more).alias("listed"))


def orphans(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """key, side: pair, left_only or right_only."""
    a, b = left.select(*key).distinct().withColumn("_l", F.lit(True)), right.select(*key).distinct().withColumn("_r", F.lit(True))
    return a.join(b, key, "full").select(*key, F.when(F.col("_l") & F.col("_r"), "pair").when(F.col("_l"), "left_only").otherwise("right_only").alias("side"))


def occurrence_pairs(a: DataFrame, b: DataFrame, by: list[str], word: str, order: list[str], value: str) -> DataFrame:
    """The k-th occurrence of a word in a with the k-th in b: by, word, occurrence, a_<value>, b_<value>."""
    x, y = (d.select(*by, word, *order, value, F.lit(side).alias("_side")) for d, side in ((a, "a"), (b, "b")))
    # Both sides are dealt once, by word; numbers and pairs are made where they come to.
    return paired_occurrences(x.unionByName(y).repartition(*by, word), by, word, order, value)


def paired_occurrences(both: DataFrame, by: list[str], word: str, order: list[str], value: str) -> DataFrame:
    """occurrence_pairs of one table whose _side is a or b."""
    numbered = ordinal(both.dropna(subset=[*by, word]), [*by, word, "_side"], order, "occurrence")
    sides = [F.max_by(value, F.when(F.col("_side") == side, 1)).alias(f"{side}_{value}") for side in "ab"]
    return numbered.groupBy(*by, word, "occurrence").agg(*sides, F.count("*").alias("_n")).where("_n = 2").drop("_n")


def tolerance_match(left: DataFrame, right: DataFrame, by: list[str], time: str, other: str, offsets: tuple[int, ...] = (0, 1, -1), unit: str = "1 second") -> DataFrame:
    """left with `matched`: the time in right at the first offset that has one, else null.

    Offsets are exploded and equi-joined, so nothing is compared by ranges.
    """
    tries = F.explode(F.array(*(F.struct(F.lit(i).alias("_rank"), F.lit(o).alias("_off")) for i, o in enumerate(offsets)))).alias("_o")
    rows = left.select("*", tries)
    rows = rows.withColumn("_at", F.col(time) + F.expr(f"interval {unit}") * F.col("_o._off"))
    there = right.select(*(F.col(c).alias(f"_{c}") for c in by), F.col(other).alias("_t")).distinct()
    hit = rows.join(there, [F.col(c) == F.col(f"_{c}") for c in by] + [F.col("_at") == F.col("_t")], "left")
    # Each row of left is here once for each offset: so many times it comes back, if it was repeated.
    found = hit.groupBy(*left.columns).agg(F.min_by("_t", F.when(F.col("_t").isNotNull(), F.col("_o._rank"))).alias("matched"), (F.count("*") / len(offsets)).cast("int").alias("_times"))
    return found.select(*left.columns, "matched", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*left.columns, "matched")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """new, and of old what new does not replace."""
    return new.unionByName(old.join(new, key, "left_anti"))


def tagged(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """The parts by name under one another, with their names in a column."""
    out = None
    for name, df in parts.items():
        one = df.withColumn(tag, F.lit(name))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no parts")
    return out


def sentence_text(tracks: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """by, sentence: pre, word and following word along the tracks, without what repeats the word before."""
    seq = tracks.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order, F.array("pre_word", "word", "fol_word").alias("_w")))).alias("_s"))
    flat = F.filter(F.flatten(F.transform("_s", lambda x: x["_w"])), lambda w: w.isNotNull() & (w != ""))
    seq = seq.withColumn("_f", flat)
    return seq.select(*by, F.array_join(F.filter("_f", lambda w, i: (i == 0) | (w != F.get("_f", i - 1))), " ").alias("sentence"))


def phone_strings(tracks: DataFrame, by: list[str]) -> DataFrame:
    """by, phones: the phonemes of a word in order, without silence."""
    from ..functions.text import silent

    rows = tracks.where(~silent("raw_label") & ~silent("phoneme"))
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("in_word_index", "raw_label", "phoneme"))), lambda x: x["phoneme"]), "").alias("phones"))
