"""Listening tests: summaries by condition, rater checks, agreement, the report as a whole."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alpha_tag, attention_fails, expectation_fails
from .pairing import first_by
from .stats import half_width, krippendorff

DIMENSIONS = ("SIG", "BAK", "OVRL")
ANCHORS = ("anchor_clean", "anchor_noisy")
GOLD = ("gold_high", "gold_low")


def with_mapping(ratings: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ratings with what the mapping says of their stimuli, and how often each unknown id occurs.

    A small mapping is broadcast by Spark of its own accord; an id that it has twice counts once.
    """
    known = mapping.dropDuplicates(["id"])
    return ratings.join(known, "id"), ratings.join(known, "id", "left_anti").groupBy("id").agg(F.count("*").alias("n"))


def long(ratings: DataFrame, keys: list[str], dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    return ratings.unpivot(keys, list(dimensions), "dim", "rating")


def condition_table(ratings: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, digits: int = 3) -> DataFrame:
    """condition, base, dim, mean, std, n, ci95; rounded half to even."""
    t = long(ratings, ["condition", "base"], dimensions).groupBy("condition", "base", "dim").agg(F.avg("rating").alias("m"), F.stddev_samp("rating").alias("s"), F.count("rating").alias("n"))
    return t.select("condition", "base", "dim", F.bround("m", digits).alias("mean"), F.bround("s", digits).alias("std"), "n", F.bround(half_width("s", "n"), digits).alias("ci95"))


def order_key(c: str, order: list[str]) -> list[Column]:
    """Sort columns: known values in their order, then the others by name."""
    known = F.array_position(F.array(*(F.lit(x) for x in order)), F.col(c)) if order else F.lit(0)
    return [F.when(known > 0, known).otherwise(len(order) + 1), F.col(c)]


def headline(table: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, bases: tuple[str, ...] = ("raw", "dsp")) -> DataFrame:
    """condition by dimension and base: `mean (std)`; `nan` for a deviation that one rating has none of."""
    cell = F.when(F.col("mean").isNull(), "-").otherwise(F.format_string("%.2f (%s)", "mean", F.coalesce(F.format_string("%.2f", "std"), F.lit("nan"))))
    one = table.withColumn("_c", F.concat_ws("_", "dim", "base")).withColumn("_cell", F.when(F.col("std").isNull() & F.col("mean").isNotNull(), F.concat(F.format_string("%.2f", "mean"), F.lit(" (nan)"))).otherwise(cell))
    return one.groupBy("condition").pivot("_c", [f"{d}_{b}" for d in dimensions for b in bases]).agg(F.first("_cell"))


def rater_checks(ratings: DataFrame, order: list[str], threshold: float = 0.5) -> DataFrame:
    """rater, gold_items, gold_fails, gold_fail_rate, attention_fail, flagged.

    The answer to the attention check is the first that the rater gave, in the order
    in which rows were read.
    """
    gold = ratings.where(F.col("role").isin(*GOLD)).groupBy("rater").agg(F.count("*").alias("gold_items"), F.count_if(expectation_fails("expected_overall", "OVRL")).alias("gold_fails"))
    told = first_by(ratings.select("rater", "finalCheck", *order), ["rater"], [F.col(c) for c in order]).select("rater", attention_fails("finalCheck").alias("attention_fail"))
    rate = F.coalesce(F.col("gold_fails").cast("double") / F.col("gold_items"), F.lit(0.0))
    return told.join(gold, "rater", "left").select("rater", F.coalesce("gold_items", F.lit(0)).alias("gold_items"), F.coalesce("gold_fails", F.lit(0)).alias("gold_fails"), rate.alias("gold_fail_rate"), "attention_fail", ((rate > threshold) | F.col("attention_fail")).alias("flagged"))


def gold_failures(ratings: DataFrame) -> DataFrame:
    """id, n, mean_ovrl, expected of gold items that failed."""
    fails = ratings.where(F.col("role").isin(*GOLD) & expectation_fails("expected_overall", "OVRL"))
    return fails.groupBy("id").agg(F.count("*").alias("n"), F.avg("OVRL").alias("mean_ovrl"), F.min("expected_overall").alias("expected"))


def anchor_means(ratings: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    return ratings.where(F.col("role").isin(*ANCHORS)).groupBy("role").agg(*(F.bround(F.avg(d), 3).alias(d) for d in dimensions))


def agreement(ratings: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """dim, alpha, tag, mean_item_sd."""
    rows = long(ratings, ["id"], dimensions)
    alpha = krippendorff(rows, ["dim"], "id", "rating")
    sd = rows.groupBy("dim", "id").agg(F.stddev_samp("rating").alias("_s")).groupBy("dim").agg(F.avg("_s").alias("mean_item_sd"))
    return sd.join(alpha, "dim", "left").select("dim", "alpha", alpha_tag("alpha").alias("tag"), "mean_item_sd")


def roles(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("role").agg(F.count("*").alias("n"))


@dataclass
class Report:
    table: DataFrame
    headline: DataFrame
    agreement: DataFrame
    anchors: DataFrame
    raters: DataFrame
    gold: DataFrame
    unknown: DataFrame


def report(ratings: DataFrame, mapping: DataFrame, order: list[str], keep_flagged: bool = False, threshold: float = 0.5, bases: tuple[str, ...] = ("raw", "dsp")) -> Report:
    """All tables of a test.  Anchor means see all raters; the others leave flagged raters out unless keep_flagged."""
    all_, unknown = with_mapping(ratings, mapping)
    raters = rater_checks(all_, order, threshold)
    kept = all_ if keep_flagged else all_.join(raters.where("flagged").select("rater"), "rater", "left_anti")
    experimental = kept.where(F.col("role") == "experimental")
    table = condition_table(experimental)
    return Report(table, headline(table, bases=bases), agreement(experimental), anchor_means(all_), raters, gold_failures(all_), unknown)
