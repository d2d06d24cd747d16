"""Ranks and quantiles of groups of any size.

A window over a whole group would put the group into one task.  Here a group's values
fall into buckets, that is ranges of the values, of bounded size.  Where a new bucket
begins is told by a hash: one of `EVERY` different values is a splitter.  So the
splitters do not depend on the order of rows or on partitions, and each pass finds the
same ones; they are a bounded share of the data and are broadcast.  Totals by
bucket, added up from bucket to bucket, say how many rows stand before a bucket, and a
window inside it does the rest.  A quantile is found by selection: only rows of the
bucket that has the wanted rank are sorted at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One of so many different values, picked by a hash, begins a bucket.
EVERY = 1 << 16
#: Places of a binary search: a group may have 2 to this many splitters.
SEARCH = 24


def meet(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner", small: bool = False) -> DataFrame:
    """left joined with right on by, null equal to null; without by the one row of right comes to each.

    small: right is bounded and is broadcast.  Other columns of both have to differ.
    """
    names = {c: f"_by{k}" for k, c in enumerate(by)}
    right = right.select(*(F.col(c).alias(names.get(c, c)) for c in right.columns))
    right = F.broadcast(right) if small or not by else right
    if not by:
        return left.crossJoin(right)  # one row
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    return left.join(right, on, how).drop(*names.values())


def _splitters(rows: DataFrame, by: list[str], value: str, every: int) -> DataFrame:
    """by and _s: the values that begin buckets, sorted.  A group without any has no row if there are groups."""
    picked = rows.where(F.pmod(F.xxhash64(value), F.lit(every)) == 0).select(*by, value).distinct()
    return picked.groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias("_s"))


def _place(value: Column, splitters: Column) -> Column:
    """How many of the sorted values are not above this one."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(SEARCH))))
    found = F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(splitters, low + step - 1) <= value, low + step).otherwise(low))
    return F.when(F.size(splitters) > 0, found).otherwise(0)


def _bucketed(rows: DataFrame, by: list[str], value: str, every: int) -> DataFrame:
    """rows with _s and _bucket."""
    out = meet(rows, _splitters(rows, by, value, every), by, "left", small=True)
    return out.withColumn("_bucket", _place(F.col(value), F.col("_s")))


def running(rows: DataFrame, by: list[str], value: str, n: str, out: str, every: int = EVERY) -> DataFrame:
    """rows with the sum of column n over all rows of the group whose value is not above the row's.

    value must not be null.  Rows are meant to be counts by value: those of equal values share a task.
    """
    dealt = _bucketed(rows, by, value, every)
    totals = dealt.where(F.size("_s") > 0).groupBy(*by, "_bucket").agg(F.sum(n).alias("_total"))
    # Few rows: a group has as many as splitters, and one.
    before = totals.withColumn("_before", F.sum("_total").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
    # A bucket holds its splitter, so that only the one before all splitters can be empty.
    before = before.where("_bucket > 0").groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_bucket", "_before"))), lambda x: F.coalesce(x["_before"], F.lit(0))).alias("_sums"))
    dealt = meet(dealt, before, by, "left", small=True)
    inside = F.sum(n).over(Window.partitionBy(*by, "_bucket").orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.coalesce(F.get("_sums", F.col("_bucket") - 1), F.lit(0))
    return dealt.withColumn(out, inside + ahead).drop("_s", "_sums", "_bucket")


def mean_ranks(counts: DataFrame, by: list[str], value: str, n: str = "n", out: str = "rank", every: int = EVERY) -> DataFrame:
    """counts (by, value, n), a row for each value, with the mean rank of that value's rows."""
    return running(counts, by, value, n, "_upto", every).withColumn(out, F.col("_upto") - (F.col(n) - 1) / F.lit(2.0)).drop("_upto")


def quantiles(df: DataFrame, by: list[str], value: str, at: list[float], out: str = "q", every: int = EVERY) -> DataFrame:
    """by and an array of exact quantiles, interpolated between neighbours; nulls are skipped, and a group of nulls has no row.

    One pass picks splitters, one counts by bucket (a sum that is made where the rows are), and the
    third counts the values of those buckets that hold a wanted rank.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    dealt = _bucketed(rows, by, "_v", every).drop("_s")
    totals = dealt.groupBy(*by, "_bucket").agg(F.count("*").alias("_total"))
    group = Window.partitionBy(*by)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_total").over(group))
    ranks = []
    for k, q in enumerate(at):
        rank = F.lit(float(q)) * (F.col("_n") - 1)
        ranks += [F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), f(rank).cast("long").alias("rank"), (rank - F.floor(rank)).alias("part")) for side, f in enumerate((F.floor, F.ceil))]
    wanted = F.filter(F.array(*ranks), lambda x: (x["rank"] >= F.col("_before")) & (x["rank"] < F.col("_before") + F.col("_total")))
    wanted = totals.withColumn("_wanted", wanted).where(F.size("_wanted") > 0).drop("_total", "_n")
    counts = meet(dealt.groupBy(*by, "_bucket", "_v").agg(F.count("*").alias("_c")), wanted, [*by, "_bucket"])
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*by, "_bucket").orderBy("_v"))
    hit = F.filter("_wanted", lambda x: (x["rank"] < F.col("_upto")) & (x["rank"] >= F.col("_upto") - F.col("_c")))
    found = counts.withColumn("_upto", upto).select(*by, "_v", F.explode(hit).alias("_x"))
    side = lambda k, s: F.max(F.when((F.col("_x.k") == k) & (F.col("_x.side") == s), F.col("_v")))
    part = lambda k: F.max(F.when(F.col("_x.k") == k, F.col("_x.part")))
    # Of two equal neighbours nothing is computed, so that no rounding gets in.
    between = [F.when(side(k, 0) == side(k, 1), side(k, 0)).otherwise(side(k, 0) * (1 - part(k)) + side(k, 1) * part(k)) for k in range(len(at))]
    result = found.groupBy(*by).agg(F.array(*between).alias(out))
    return result if by else result.where(F.col(out)[0].isNotNull())


def medians(df: DataFrame, by: list[str], value: str, out: str = "median", every: int = EVERY) -> DataFrame:
    """by and the exact median."""
    return quantiles(df, by, value, [0.5], "_q", every).select(*by, F.col("_q")[0].alias(out))
