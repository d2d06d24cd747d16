"""Intervals of annotation tiers: merging, sealing, containment, search, sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SILENT_TIER, SILENT_WORDS, prompt_tokens, silent
from .ranking import meet

EPS = 1e-6
#: Mean words to a bin of time.
BINS = 4


def merge_contiguous(df: DataFrame, by: list[str], label: str = "label", order: list[str] | None = None, eps: float = EPS) -> DataFrame:
    """Neighbours with one label and no gap become one interval: by, pos, xmin, xmax, label.

    Gaps and islands: a row opens an island where the label changes or time jumps.
    """
    own = Window.partitionBy(*by).orderBy(*(order or ["xmin", "xmax"]))
    opens = F.coalesce(~((F.col(label) == F.lag(label).over(own)) & (F.abs(F.col("xmin") - F.lag("xmax").over(own)) < eps)), F.lit(True))
    rows = df.withColumn("_island", F.sum(opens.cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    # Within an island time is contiguous, so the last end is that of the last row.
    rows = rows.withColumn("_i", F.row_number().over(own))
    return rows.groupBy(*by, "_island").agg(F.min_by("xmin", "_i").alias("xmin"), F.max_by("xmax", "_i").alias("xmax"), F.min_by(label, "_i").alias(label)).withColumn("pos", F.col("_island").cast("int") - 1).drop("_island")


def seal_gaps(df: DataFrame, by: list[str], label: str = "label", filler: str = "sp", order: list[str] | None = None, eps: float = EPS) -> DataFrame:
    """A tier without gaps or overlaps: gaps become intervals of silence, an overlap is cut from the later one.

    The end reached so far is a running maximum, so nothing is folded row by row.
    by, xmin, xmax, label, in order of (xmin, xmax).
    """
    own = Window.partitionBy(*by).orderBy(*(order or ["xmin", "xmax"]))
    rows = df.withColumn("_end", F.max("xmax").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    gap = F.col("xmin") - F.col("_end") > eps
    overlap = F.col("xmin") < F.col("_end")
    kept = F.struct(F.when(overlap, F.col("_end")).otherwise(F.col("xmin")).alias("xmin"), F.when(overlap, F.greatest("xmax", "_end")).otherwise(F.col("xmax")).alias("xmax"), F.col(label).alias(label))
    filled = F.struct(F.col("_end").alias("xmin"), F.col("xmin").alias("xmax"), F.lit(filler).alias(label))
    return rows.select(*by, F.explode(F.when(gap, F.array(filled, kept)).otherwise(F.array(kept))).alias("_x")).select(*by, "_x.*")


def contained(words: DataFrame, phones: DataFrame, by: list[str], eps: float = EPS, deal: list[str] | None = None) -> DataFrame:
    """For each word its phones inside it: by, pos, word, phones (in order).

    words and phones: by, pos, xmin, xmax, label.  Silent and empty labels are left
    out; a word without times has no phones, and a phone that ends before it begins is in none.  Time is
    cut into bins as long as `BINS` mean words: the phones of the bin of their beginning travel together, and a word meets
    the bins that it reaches over, mostly one.  deal: of by and word, what words are dealt by to the tasks in the end.
    """
    w = words.where(F.coalesce(~F.lower("label").isin(*SILENT_TIER), F.lit(False))).select(*by, "pos", F.lower("label").alias("word"), F.col("xmin").alias("_a"), F.col("xmax").alias("_b"))
    p = phones.where(F.coalesce(~F.col("label").isin(*SILENT_TIER), F.lit(False)) & (F.col("xmin") <= F.col("xmax")))
    mean = F.broadcast(w.agg(F.greatest(F.coalesce(F.avg(F.col("_b") - F.col("_a")), F.lit(1.0)) * BINS, F.lit(1e-3)).alias("_width")))  # one row
    bin_ = lambda t: F.floor(t / F.col("_width"))
    reach = F.when(F.col("_b") + eps >= F.col("_a") - eps, F.sequence(bin_(F.col("_a") - eps), bin_(F.col("_b") + eps)))
    w = w.crossJoin(mean).select(*by, "pos", "word", "_a", "_b", F.explode_outer(reach).alias("_at"))
    one = F.struct(F.col("pos").alias("_p"), F.col("label").alias("_phone"), F.col("xmin").alias("_c"), F.col("xmax").alias("_d"))
    p = p.crossJoin(mean).groupBy(*(F.col(c).alias(f"_{c}") for c in by), bin_(F.col("xmin")).alias("_bin")).agg(F.collect_list(one).alias("_all"))
    on = [F.col(c) == F.col(f"_{c}") for c in by] + [F.col("_at") == F.col("_bin")]
    inside = F.filter("_all", lambda x: (x["_c"] >= F.col("_a") - eps) & (x["_d"] <= F.col("_b") + eps))
    own = F.transform(inside, lambda x: F.struct(x["_p"].alias("_p"), x["_phone"].alias("_phone")))
    met = w.join(p, on, "left").select(*by, "pos", "word", own.alias("_own"))
    met = met.repartition(*deal) if deal else met
    return met.groupBy(*by, "pos", "word").agg(F.transform(F.sort_array(F.flatten(F.collect_list("_own"))), lambda x: x["_phone"]).alias("phones"))


def contains(haystack: Column | str, needle: Column | str) -> Column:
    """Whether an array holds another as a contiguous part; an empty one is in all.

    Words are joined by a control character, so that a match begins and ends at one.
    """
    wrap = lambda a: F.concat(F.lit("\x01"), F.array_join(a, "\x01", "\x02"), F.lit("\x01"))
    h, n = (F.col(c) if isinstance(c, str) else c for c in (haystack, needle))
    return (F.size(n) <= 0) | (F.instr(wrap(h), wrap(n)) > 0)


#: How many words two sequences meet by: the greatest of these that the shorter one has.
HEADS = (8, 4, 2, 1)


def holders(haystacks: DataFrame, key: str, hay: str, needles: DataFrame, name: str, needle: str) -> DataFrame:
    """key, name of each array of words and each other one that it holds as a contiguous part; an empty one is in all.

    They meet by a hash of the needle's first words: needles are in classes by how many those are, and each
    class that there is (of four at most) makes the haystacks' runs of that length.  The whole needle then confirms.
    """
    size = F.size(needle)
    n = needles.select(name, needle, F.coalesce(*(F.when(size >= k, k) for k in HEADS), F.lit(0)).alias("_k"))
    some = n.where("_k > 0").withColumn("_h", F.xxhash64(F.transform(F.slice(needle, 1, F.col("_k")), lambda w: F.xxhash64(w))))
    classes = F.broadcast(some.select("_k").distinct())
    runs = haystacks.select(key, F.transform(hay, lambda w: F.xxhash64(w)).alias("_w")).crossJoin(classes).where(F.size("_w") >= F.col("_k"))
    heads = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("_w") - F.col("_k") + 1), lambda i: F.xxhash64(F.slice("_w", i, F.col("_k")))))
    met = runs.select(key, "_k", F.explode(heads).alias("_h")).join(some, ["_k", "_h"]).select(key, name, needle)
    found = met.join(haystacks.select(key, hay), key).where(contains(hay, needle)).select(key, name)
    empty = haystacks.select(key).crossJoin(n.where("_k = 0").select(name)).select(key, name)  # all of them is the answer
    return found.union(empty)


def sentence_window(words: DataFrame, targets: DataFrame, by: list[str], pad: float = 0.05) -> DataFrame:
    """The first run of words, silences skipped, that equals a sentence: by, sid, t_start, t_end, first, last.

    words: by, pos, xmin, xmax, label; targets: by, sid, tokens.  Of an interval only
    the first normalised token counts.  A sentence that is not found has no row.
    """
    token = F.coalesce(F.get(prompt_tokens("label"), F.lit(0)), F.lit(""))
    spoken = words.where(~silent("label", SILENT_WORDS)).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "xmin", "xmax", token.alias("token")))).alias("_w"))
    both = spoken.join(targets.where(F.size("tokens") > 0), by).withColumn("_n", F.size("tokens")).withColumn("_t", F.transform("_w", lambda x: x["token"]))
    at = F.get(F.filter(F.sequence(F.lit(1), F.greatest(F.size("_w") - F.col("_n") + 1, F.lit(1))), lambda i: F.slice("_t", i, F.col("_n")) == F.col("tokens")), F.lit(0))
    found = both.withColumn("_at", at).where("_at is not null")
    first, last = F.get("_w", F.col("_at") - 1), F.get("_w", F.col("_at") + F.col("_n") - 2)
    return found.select(*by, "sid", F.greatest(F.lit(0.0), first["xmin"] - pad).alias("t_start"), (last["xmax"] + pad).alias("t_end"), first["pos"].alias("first"), last["pos"].alias("last"))


def moving_mean(df: DataFrame, by: list[str], order: str, value: Column | str, k: int, out: str = "mean") -> DataFrame:
    """Centred mean of k values, k // 2 of them before; windows shrink at the ends."""
    own = Window.partitionBy(*by).orderBy(order).rowsBetween(-(k // 2), k - 1 - k // 2)
    return df.withColumn(out, F.avg(value).over(own))


def drop_index(samples: DataFrame, by: list[str], rate: Column | int, ratio: float = 0.9, fixed_width: int | None = None) -> DataFrame:
    """by, end_idx: the place (from 1) of the first sample in the tail whose level falls below ratio times the least level before it.

    samples: by, idx (from 0, without gaps), sample.  rate: samples a second, a number or a column with one value for each by.
    Level: root of the centred mean of squares over 50 ms, or over fixed_width samples.  The part
    before ends 7 s or 70 % of the length before the end and begins at 0.5 s.  The mean is
    that of running sums at both ends of its window, so that its width may be another in each file.
    """
    from ..functions.text import half_away

    rate = F.lit(rate) if isinstance(rate, int) else rate
    width = F.lit(fixed_width) if fixed_width is not None else half_away(0.05 * rate)
    own = Window.partitionBy(*by)
    rows = samples.withColumns({"_rate": rate.cast("double"), "_w": F.greatest(width.cast("long"), F.lit(1).cast("long")), "_n": F.count("*").over(own)})
    rows = rows.withColumn("_sum", F.sum(F.col("sample") * F.col("sample")).over(own.orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    back = F.floor(F.col("_w") / 2)
    rows = rows.withColumns({"_hi": F.least(F.col("idx") + F.col("_w") - 1 - back, F.col("_n") - 1), "_lo": F.greatest(F.col("idx") - back, F.lit(0)) - 1})
    for side in ("_hi", "_lo"):
        there = rows.select(*by, F.col("idx").alias(side), F.col("_sum").alias(f"{side}_sum"))
        rows = meet(rows, there, [*by, side], "left")
    level = F.sqrt(F.greatest(F.lit(0.0), (F.col("_hi_sum") - F.coalesce("_lo_sum", F.lit(0.0))) / (F.col("_hi") - F.col("_lo"))))
    sized = rows.select(*by, "idx", level.alias("_rms"), half_away(0.5 * F.col("_rate")).alias("_start"), (F.col("_n") - half_away(F.least(7.0 * F.col("_rate"), 0.7 * F.col("_n")))).alias("_end"))
    bound = sized.withColumn("_least", F.min(F.when((F.col("idx") >= F.col("_start") - 1) & (F.col("idx") < F.col("_end")), F.col("_rms"))).over(own))
    return bound.groupBy(*by).agg(F.min(F.when((F.col("idx") >= F.col("_end") - 1) & (F.col("_rms") < ratio * F.col("_least")), F.col("idx"))).alias("_i")).select(*by, (F.col("_i") + 1).alias("end_idx"))


def same_slice(part: DataFrame, whole: DataFrame, by: list[str], offset: Column | int, atol: float = 1e-6, rtol: float = 1e-5) -> DataFrame:
    """by, same: whether part (idx, sample) equals whole from offset on, in length and within tolerance."""
    b = whole.select(*by, (F.col("idx") - offset).alias("idx"), F.col("sample").alias("_b"))
    both = part.select(*by, "idx", F.col("sample").alias("_a")).join(b, [*by, "idx"], "left")
    return both.groupBy(*by).agg(F.bool_and(F.coalesce(F.abs(F.col("_b") - F.col("_a")) <= atol + rtol * F.abs("_a"), F.lit(False))).alias("same"))
