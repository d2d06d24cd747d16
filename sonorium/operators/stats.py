"""Rank tests and their helpers as relational operations.

Every test takes long rows and a list of group columns, so the tests of many
groups run side by side.  Ranks come from counts by value, so what is sorted is
the different values of a group, not its rows, and ties need no second look; a group's
values are sorted bucket by bucket (ranking.py), so no task has a whole group.
p-values are normal (or chi-square) approximations; erfc is a rational one with
relative error below 1.2e-7, in plain arithmetic so that SQL can repeat it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col
from .ranking import mean_ranks, medians, meet, running

# Coefficients of the Chebyshev fit to erfc(z) = t exp(-z^2 + P(t)), t = 1 / (1 + z / 2).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(z: Column) -> Column:
    """erfc of a number that is not negative."""
    t = 1.0 / (1.0 + 0.5 * z)
    p: Column = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        p = F.lit(c) + t * p
    return t * F.exp(-z * z + p)


def two_sided(z: Column) -> Column:
    """p of a normal deviate."""
    return F.least(F.lit(1.0), erfc(F.abs(z) / F.sqrt(F.lit(2.0))))


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, mean, median and sample deviation; nulls are skipped."""
    sums = df.groupBy(*by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    middle = medians(df, by, value)
    if not by:  # one row, also of an empty table
        middle = middle.agg(F.max("median").alias("median"))
    return meet(sums, middle, by, "left").select(*by, "count", "mean", "median", "std")


def ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, n and rank of each different value: ties have the mean of their ranks."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return mean_ranks(counts, by, value)


def wilcoxon(df: DataFrame, by: list[str], difference: str) -> DataFrame:
    """Signed-rank test of paired differences, two-sided; zeros are left out.

    n, w (the smaller rank sum), z, p, rank_biserial.  No continuity correction; the
    variance is corrected for ties.  Without a difference w, z and p are null and
    rank_biserial is 0.
    """
    d = F.col(difference)
    rows = df.select(*by, d.alias("_d")).where(d.isNotNull())
    counts = rows.groupBy(*by, F.abs("_d").alias("_v")).agg(F.count_if(F.col("_d") > 0).alias("_p"), F.count_if(F.col("_d") < 0).alias("_m"))
    counts = counts.withColumn("n", F.col("_p") + F.col("_m")).where("n > 0")
    counts = mean_ranks(counts, by, "_v", out="_r")
    n = F.col("n").cast("double")
    sums = counts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("_r") * F.col("_p")).alias("_up"), F.sum(F.col("_r") * F.col("_m")).alias("_down"), F.sum(n * n * n - n).alias("_ties"))
    all_ = meet(rows.select(*by).distinct(), sums, by, "left") if by else sums
    n = F.col("n").cast("double")
    w = F.least("_up", "_down")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_ties") / 48.0)
    z = F.when(sd > 0, (w - n * (n + 1) / 4.0) / sd)
    return all_.select(*by, F.coalesce("n", F.lit(0)).alias("n"), w.alias("w"), z.alias("z"), two_sided(z).alias("p"), F.coalesce(F.when(n > 0, (F.col("_up") - F.col("_down")) / (F.col("_up") + F.col("_down"))), F.lit(0.0)).alias("rank_biserial"))


def wilcoxon_against(df: DataFrame, by: list[str], value: str, scalar: Column | float) -> DataFrame:
    """The same test of values against one number."""
    return wilcoxon(df.withColumn("_d", F.col(value) - scalar), by, "_d")


def mann_whitney(df: DataFrame, by: list[str], value: str, first: Column) -> DataFrame:
    """U test of the rows where `first` holds against the others, two-sided.

    n1, n2, u (of the first sample), z, p, effect (2u / (n1 n2) - 1), median_diff.
    The normal approximation has a continuity correction of one half and one for ties.
    """
    rows = df.select(*by, F.col(value).alias("_v"), first.alias("_a")).where(F.col("_v").isNotNull() & F.col("_a").isNotNull())
    counts = rows.groupBy(*by, "_v").agg(F.count_if("_a").alias("_n1"), F.count("*").alias("n"))
    counts = mean_ranks(counts, by, "_v", out="_r")
    t = F.col("n").cast("double")
    sums = counts.groupBy(*by).agg(F.sum("_n1").alias("n1"), (F.sum("n") - F.sum("_n1")).alias("n2"), F.sum(F.col("_r") * F.col("_n1")).alias("_sum"), F.sum(t * t * t - t).alias("_ties"))
    sums = sums.withColumn("_u", F.col("_sum") - F.col("n1") * (F.col("n1") + 1) / F.lit(2.0))
    middle = medians(rows, [*by, "_a"], "_v", "_m").groupBy(*by).agg(F.max(F.when(F.col("_a"), F.col("_m"))).alias("_m1"), F.max(F.when(~F.col("_a"), F.col("_m"))).alias("_m2"))
    return _u_test(meet(sums, middle, by), by)


def mann_whitney_against(df: DataFrame, by: list[str], value: str, baseline: DataFrame) -> DataFrame:
    """The same test of each group's rows against one sample that all share: baseline, with the same value column.

    n2 is the size of the baseline, median_diff the group's median less the baseline's.  The baseline is
    counted by value and never repeated: in one order of all values a running sum says how
    many of its rows lie below each value of a group.
    """
    own = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n1"))
    base = baseline.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n0"))
    tagged = own.withColumn("_n0", F.lit(0).cast("long")).withColumn("_own", F.lit(True)).unionByName(base.select(*(F.lit(None).cast(df.schema[c].dataType).alias(c) for c in by), "_v", F.lit(0).cast("long").alias("_n1"), "_n0", F.lit(False).alias("_own")))
    placed = running(tagged, [], "_v", "_n0", "_upto").withColumn("_same", F.sum("_n0").over(Window.partitionBy("_v")))
    ties = lambda n: n.cast("double") * n * n - n
    whole = base.agg(F.coalesce(F.sum("_n0"), F.lit(0)).alias("n2"), F.coalesce(F.sum(ties(F.col("_n0"))), F.lit(0.0)).alias("_all"))
    more = ties(F.col("_n1") + F.col("_same")) - ties(F.col("_same"))
    sums = placed.where("_own").groupBy(*by).agg(F.sum("_n1").alias("n1"), F.sum(F.col("_n1") * (F.col("_upto") - F.col("_same") / F.lit(2.0))).alias("_u"), F.sum(more).alias("_more"))
    middle = medians(baseline, [], value, "_m2").agg(F.max("_m2").alias("_m2"))
    both = meet(meet(sums, whole, []), middle, []).withColumn("_ties", F.col("_all") + F.col("_more"))
    return _u_test(meet(both, medians(df, by, value, "_m1"), by), by)


def _u_test(sums: DataFrame, by: list[str]) -> DataFrame:
    """The columns of a U test from n1, n2, _u, _ties, _m1 and _m2."""
    a, b, u = F.col("n1").cast("double"), F.col("n2").cast("double"), F.col("_u")
    n = a + b
    sd = F.sqrt(a * b / 12.0 * (n + 1 - F.col("_ties") / (n * (n - 1))))
    z = F.when(sd > 0, (F.greatest(u, a * b - u) - a * b / 2.0 - 0.5) / sd)
    ok = (a > 0) & (b > 0)
    return sums.select(*by, "n1", "n2", F.when(ok, u).alias("u"), F.when(ok, z).alias("z"), F.when(ok, two_sided(F.greatest(z, F.lit(0.0)))).alias("p"), F.when(ok, 2 * u / (a * b) - 1).alias("effect"), (F.col("_m1") - F.col("_m2")).alias("median_diff"))


def friedman(df: DataFrame, by: list[str], block: list[str], condition: str, value: str) -> DataFrame:
    """Chi-square of ranks within blocks, corrected for ties: n (blocks), k (conditions), chi2, p.

    Blocks must have one value of each condition.  p is exact for 2 and 4 degrees of
    freedom and 1, and else the Wilson-Hilferty approximation.
    """
    keys = [*by, *block]
    own = Window.partitionBy(*keys)
    r = F.rank().over(own.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / F.lit(2.0)
    # ties: the sum of t^3 - t over tied values is the sum of t^2 - 1 over their rows.
    t = F.count("*").over(Window.partitionBy(*keys, value)).cast("double")
    rows = df.withColumn("_r", r).withColumn("_t", t * t - 1)
    sums = rows.groupBy(*by, condition).agg(F.sum("_r").alias("_sum"), F.count("*").alias("_n"), F.sum("_t").alias("_t"))
    out = sums.groupBy(*by).agg(F.max("_n").alias("n"), F.count("*").alias("k"), F.sum(F.col("_sum") * F.col("_sum")).alias("_ss"), F.sum("_t").alias("_ties"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    raw = 12.0 / (n * k * (k + 1)) * F.col("_ss") - 3 * n * (k + 1)
    chi = raw / F.nullif(1 - F.col("_ties") / (n * (k * k * k - k)), F.lit(0.0))  # null where all is tied
    return out.select(*by, "n", "k", chi.alias("chi2"), chi_square_p(chi, k - 1).alias("p"))


def chi_square_p(x: Column, df: Column) -> Column:
    """Upper tail of chi-square."""
    third = F.pow(F.greatest(x, F.lit(0.0)) / df, F.lit(1.0 / 3))
    z = (third - (1 - 2.0 / (9 * df))) / F.sqrt(2.0 / (9 * df))
    tail = F.when(z >= 0, 0.5 * erfc(F.abs(z) / F.sqrt(F.lit(2.0)))).otherwise(1 - 0.5 * erfc(F.abs(z) / F.sqrt(F.lit(2.0))))
    return F.when(df == 1, erfc(F.sqrt(F.greatest(x, F.lit(0.0)) / 2))).when(df == 2, F.exp(-x / 2)).when(df == 4, F.exp(-x / 2) * (1 + x / 2)).otherwise(tail)


def holm(df: DataFrame, by: list[str], p: str, out: str = "p_holm") -> DataFrame:
    """Step-down adjusted p-values: missing ones count for nothing and stay missing."""
    own = Window.partitionBy(*by)
    tie = [c for c in df.columns if c not in by]
    order = own.orderBy(F.col(p).asc_nulls_last(), *tie)
    raised = F.least(F.lit(1.0), F.col(p) * (F.count(p).over(own) - F.row_number().over(order) + 1))
    df = df.withColumn("_raised", F.when(F.col(p).isNotNull(), raised))
    return df.withColumn(out, F.when(F.col(p).isNotNull(), F.max("_raised").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_raised")


def krippendorff(df: DataFrame, by: list[str], unit: str, rating: str, level: str = "ordinal") -> DataFrame:
    """Alpha by group: n_units, n_values, alpha; null where it is undefined.

    Works on counts of values within units, so a unit with many raters costs no pairs
    of them: the coincidences of values c and k are the sum over units of
    n_c (n_k - [c = k]) / (m - 1).
    """
    rows = df.where(F.col(rating).isNotNull()).groupBy(*by, unit, F.col(rating).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    rows = rows.withColumn("_m", F.sum("_n").over(Window.partitionBy(*by, unit))).where("_m >= 2")
    total = rows.groupBy(*by, "_v").agg(F.sum("_n").cast("double").alias("_nv"))
    whole = Window.partitionBy(*by)
    # From the marginals: the number, and twice the rank of a value's middle, whose differences are the ordinal metric.
    total = total.withColumn("_all", F.sum("_nv").over(whole)).withColumn("_values", F.count("*").over(whole)).withColumn("_mid", F.sum("_nv").over(whole.orderBy("_v")) - F.col("_nv") / 2)
    values = total.withColumnRenamed("_v", "_c").withColumnsRenamed({"_nv": "_nc", "_mid": "_mc"})
    other = total.select(*by, F.col("_v").alias("_k"), F.col("_nv").alias("_nk"), F.col("_mid").alias("_mk"))
    if level == "nominal":
        delta = F.when(F.col("_c") == F.col("_k"), 0.0).otherwise(1.0)
    elif level == "interval":
        delta = F.pow(F.col("_c") - F.col("_k"), F.lit(2.0))
    elif level == "ordinal":
        delta = F.pow(F.col("_mc") - F.col("_mk"), F.lit(2.0))
    else:
        raise ValueError(f"unknown level {level!r}")
    a = rows.select(*by, unit, F.col("_v").alias("_c"), F.col("_n").alias("_na"), "_m")
    b = rows.select(*by, unit, F.col("_v").alias("_k"), F.col("_n").alias("_nb"))
    both = a.join(b, [*by, unit]).groupBy(*by, "_c", "_k").agg(F.sum(F.col("_na") * (F.col("_nb") - F.when(F.col("_c") == F.col("_k"), 1).otherwise(0)) / (F.col("_m") - 1.0)).alias("_o"))
    # Values of a scale are few: all their pairs, by group, are the matrix itself.
    matrix = values.join(other, by) if by else values.join(other, F.lit(True))
    matrix = matrix.join(both, [*by, "_c", "_k"], "left").withColumn("_d", delta)
    n = F.first("_all")
    sums = matrix.groupBy(*by).agg((F.sum(F.coalesce("_o", F.lit(0.0)) * F.col("_d")) / n).alias("_do"), (F.sum(F.col("_nc") * F.col("_nk") * F.col("_d")) / (n * (n - 1))).alias("_de"), F.first("_values").alias("n_values"))
    units = rows.groupBy(*by).agg(F.countDistinct(unit).alias("n_units"))
    out = sums.join(units, by) if by else sums.join(units, F.lit(True))
    return out.select(*by, "n_units", "n_values", F.when((F.col("n_values") >= 2) & (F.col("_de") > 0), 1 - F.col("_do") / F.col("_de")).alias("alpha"))


def standard_error(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """sem: deviation over the root of n, 0 for fewer than two values."""
    return df.groupBy(*by).agg(F.coalesce(F.stddev_samp(value) / F.sqrt(F.count(value)), F.lit(0.0)).alias("sem"))


def half_width(std: Column | str, n: Column | str) -> Column:
    """Half of a 95 % confidence interval; null without a deviation."""
    return F.when(col(n) > 0, 1.96 * col(std) / F.sqrt(col(n)))


def error_bar(mean: Column | str, low: Column | str, high: Column | str) -> Column:
    """A symmetric deviation that fits inside an interval."""
    return F.greatest(F.lit(0.0), F.least(col(mean) - col(low), col(high) - col(mean))) / 1.96


def bootstrap(df: DataFrame, by: list[str], flag: str, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """Percentile interval of the mean of flags 0, 0.5 and 1: mean, ci_lo, ci_hi, n.

    A resample of n flags has multinomial counts of the three values, so a replicate
    costs three numbers whatever n is.  Rows reach Python as counts by group.
    """
    odd = F.when(~F.col(flag).isin(0.0, 0.5, 1.0), F.raise_error(F.lit(f"{flag} has values other than 0, 0.5 and 1")).cast("boolean"))
    kinds = df.where(F.col(flag).isNotNull() & F.coalesce(odd, F.lit(True))).groupBy(*by).agg(*(F.count_if(F.col(flag) == v).alias(f"_{k}") for k, v in enumerate((0.0, 0.5, 1.0))))
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.schema if f.name in by]

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                counts = np.array([row[len(by) + k] for k in range(3)], np.int64)
                n = int(counts.sum())
                if not n:
                    out.append((*row[: len(by)], None, None, None, 0))
                    continue
                draw = np.random.default_rng(seed).multinomial(n, counts / n, replicates)
                low, high = np.percentile((draw @ [0.0, 0.5, 1.0]) / n, [2.5, 97.5])
                out.append((*row[: len(by)], float(counts @ [0.0, 0.5, 1.0]) / n, low, high, n))
            yield pd.DataFrame(out, columns=[*by, "mean", "ci_lo", "ci_hi", "n"])

    return kinds.mapInPandas(run, ", ".join([*names, "mean double, ci_lo double, ci_hi double, n long"]))


# Coefficients of the Lanczos approximation to the gamma function with g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
#: Half steps of the continued fraction: it needs about as many as the root of the larger parameter.
TERMS = 2000


def log_gamma(x: Column) -> Column:
    """Of a positive number."""
    z = x - 1
    total = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        total = total + c / (z + k)
    t = z + 7.5
    return 0.5 * float(np.log(2 * np.pi)) + (z + 0.5) * F.ln(t) - t + F.ln(total)


def beta_column(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function, by its continued fraction: a fold over the fraction's partial numerators, from the side where these converge."""
    swap = x > (a + 1) / (a + b + 2)
    # As the elements of an array both sides are made once.
    sides = F.array(F.struct(F.when(swap, b).otherwise(a).alias("a"), F.when(swap, a).otherwise(b).alias("b"), F.when(swap, 1 - x).otherwise(x).alias("x")))

    def fraction(s: Column) -> Column:
        a, b, x = s["a"], s["b"], s["x"]

        def numerator(i: Column) -> Column:
            m = F.floor(i / 2).cast("double")
            return F.when(i % 2 == 0, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))).otherwise(-(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))

        def state(c: Column, d: Column, h: Column) -> Column:
            return F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

        def step(t: Column, k: Column) -> Column:
            return state(1 + k / t["c"], 1 / (1 + k * t["d"]), t["h"] * (1 + k / t["c"]) / (1 + k * t["d"]))

        first = 1 / (1 - (a + b) * x / (a + 1))
        value = F.aggregate(F.transform(F.sequence(F.lit(2), F.lit(TERMS)), numerator), state(F.lit(1.0), first, first), step, lambda t: t["h"])
        return F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x)) / a * value

    part = F.get(F.transform(sides, fraction), F.lit(0))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(F.when(swap, 1 - part).otherwise(part))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The same of three numbers, on the driver."""
    from math import exp, lgamma, log

    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    value = d
    for i in range(2, TERMS + 1):
        m = i // 2
        k = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)) if i % 2 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        c, d = 1 + k / c, 1 / (1 + k * d)
        value *= c * d
    return exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a * value


def f_tail(f: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def f_tail_column(f: Column, d1: Column, d2: Column) -> Column:
    """Upper tail of the F distribution; null without degrees of freedom."""
    d1, d2 = d1.cast("double"), d2.cast("double")
    return F.when((d1 > 0) & (d2 > 0) & f.isNotNull(), F.when(f > 0, beta_column(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))).otherwise(1.0))


def anova(df: DataFrame, by: list[str], condition: str, value: str) -> DataFrame:
    """One-way analysis of variance between conditions: f, df1, df2, p."""
    sums = df.where(F.col(value).isNotNull()).groupBy(*by, condition).agg(F.count("*").alias("_n"), F.avg(value).alias("_m"), F.coalesce(F.var_pop(value), F.lit(0.0)).alias("_v"))
    n, own = F.sum("_n"), Window.partitionBy(*by)  # a row for each condition
    away = F.col("_m") - F.sum(F.col("_n") * F.col("_m")).over(own) / F.sum("_n").over(own)
    sums = sums.withColumn("_away", F.col("_n") * away * away)
    between = F.sum("_away")
    out = sums.groupBy(*by).agg((F.count("*") - 1).alias("df1"), (n - F.count("*")).alias("df2"), between.alias("_b"), F.sum(F.col("_n") * F.col("_v")).alias("_w"))
    f = (F.col("_b") / F.col("df1")) / (F.col("_w") / F.col("df2"))
    out = out.select(*by, F.when((F.col("df1") > 0) & (F.col("df2") > 0) & (F.col("_w") > 0), f).alias("f"), "df1", "df2")
    return out.withColumn("p", f_tail_column(F.col("f"), F.col("df1"), F.col("df2")))


def paired_t(df: DataFrame, by: list[str], difference: str) -> DataFrame:
    """t of paired differences: n, t, p (two-sided)."""
    out = df.groupBy(*by).agg(F.count(difference).alias("n"), (F.avg(difference) / F.nullif(F.stddev_samp(difference), F.lit(0.0)) * F.sqrt(F.count(difference))).alias("t"))
    return out.withColumn("p", f_tail_column(F.col("t") * F.col("t"), F.lit(1), F.col("n") - 1))


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """W and p after Royston's approximation (1995), for 3 to 5000 values."""
    from math import erf, exp, log, sqrt
    from statistics import NormalDist

    x = np.sort(np.asarray(x, float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return float("nan"), float("nan")
    inverse = NormalDist().inv_cdf
    m = np.array([inverse((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, size = 1 / sqrt(n), float(m @ m)
    a = m / sqrt(size)
    if n == 3:
        a = np.array([-sqrt(0.5), 0.0, sqrt(0.5)])
    else:
        last = a[-1] + np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0.0], u)
        if n > 5:
            second = a[-2] + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0], u)
            rest = (size - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = m / sqrt(rest)
            a[-2], a[1] = second, -second
        else:
            a = m / sqrt((size - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a[-1], a[0] = last, -last
    w = min(1.0, float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()))
    if n == 3:
        from math import asin, pi

        return w, max(0.0, 6 / pi * (asin(sqrt(w)) - asin(sqrt(0.75))))
    if n <= 11:
        g = -2.273 + 0.459 * n
        y = -log(max(g - log(max(1 - w, 1e-300)), 1e-300))
        mu, sigma = np.polyval([-0.0006714, 0.025054, -0.39978, 0.544], n), exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        y, k = log(max(1 - w, 1e-300)), log(n)
        mu, sigma = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], k), exp(np.polyval([0.0030302, -0.082676, -0.4803], k))
    return w, 0.5 * (1 - erf((y - mu) / sigma / sqrt(2)))


def normality(df: DataFrame, by: list[str], value: str, most: int = 5000, seed: int = 0) -> DataFrame:
    """Shapiro-Wilk by group: n (values), w, p.  The test is made for at most `most` values: of a larger group it sees that many, picked by a seeded hash."""
    # By a hash of the whole row, the same on every run; equal rows stand for each other.
    keyed = rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"), F.xxhash64(*df.columns, F.lit(seed)).alias("_h"))
    own = Window.partitionBy(*by)
    kept = keyed.withColumn("_i", F.row_number().over(own.orderBy("_h", "_v"))).where(F.col("_i") <= most)
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
    test = F.udf(lambda v: tuple(None if x != x else float(x) for x in shapiro_wilk(np.array(v))), "w double, p double")
    tested = kept.groupBy(*by).agg(test(F.sort_array(F.collect_list("_v"))).alias("_t"))
    both = sizes.join(tested, by) if by else sizes.crossJoin(tested)  # one row each
    return both.select(*by, "n", "_t.w", "_t.p")


def guarded(tests: DataFrame, n: str, results: list[str], least: int = 5) -> DataFrame:
    """Test results with `status`: those of fewer than `least` cases are null and insufficient."""
    enough = F.coalesce(F.col(n) >= least, F.lit(False))
    return tests.withColumns({c: F.when(enough, F.col(c)) for c in results} | {"status": F.when(enough, "ok").otherwise("insufficient")})
