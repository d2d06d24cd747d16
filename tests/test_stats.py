import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonorium.operators import stats as S


def one(df):
    return df.first()


def test_wilcoxon(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", -2.0), ("a", 3.0), ("a", 0.0), ("b", 0.0)], "g string, d double")
    out = {r.g: r for r in S.wilcoxon(df, ["g"], "d").collect()}
    assert (out["a"].n, out["a"].w, round(out["a"].rank_biserial, 4)) == (3, 2.0, 0.3333)
    assert (out["b"].n, out["b"].w, out["b"].rank_biserial) == (0, None, 0.0)


def test_mann_whitney(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True), (3.0, False), (4.0, False)], "v double, a boolean")
    r = one(S.mann_whitney(df.withColumn("g", F.lit(1)), ["g"], "v", F.col("a")))
    assert (r.u, r.effect, r.median_diff, r.n1, r.n2) == (0.0, -1.0, -2.0, 2, 2)


def test_friedman(spark):
    df = spark.createDataFrame([(b, c, float(c)) for b in range(3) for c in range(3)], "b int, c int, v double")
    r = one(S.friedman(df, [], ["b"], "c", "v"))
    assert r.chi2 == pytest.approx(6) and r.p == pytest.approx(math.exp(-3))


@pytest.mark.parametrize(("chi", "p"), [(168.051, 3.22e-37), (89.736, 3.27e-20), (5.936, 0.0514)])
def test_chi_square(spark, chi, p):
    assert one(spark.range(1).select(S.chi_square_p(F.lit(chi), F.lit(2.0)).alias("p"))).p == pytest.approx(p, rel=2e-3)


@pytest.mark.parametrize(("w", "p"), [(2549077, 9.18e-37), (2882531, 8.48e-14), (3275098, 0.181), (3295531, 0.308), (2748046, 1.17e-21), (3197261, 0.0107)])
def test_signed_rank_p(spark, w, p):
    n = 3666
    z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    assert one(spark.range(1).select(S.two_sided(F.lit(z)).alias("p"))).p == pytest.approx(p, rel=5e-3)


def test_holm(spark):
    df = spark.createDataFrame([("x", "c", 0.573), ("x", "a", 0.181), ("x", "b", 0.497), ("x", "d", None)], "g string, k string, p double")
    out = {r.k: r.p_holm for r in S.holm(df, ["g"], "p").collect()}
    assert out["d"] is None and [round(out[k], 6) for k in "abc"] == [0.543, 0.994, 0.994]


@pytest.mark.parametrize(("units", "alpha"), [([[1, 1], [2, 2], [1, 2]], 0.4444444), ([[1, 2], [2, 3], [3, 3], [1, 1, 3]], 0.229629), ([[3, 3], [3, 3]], None), ([[1], [2]], None)])
def test_krippendorff(spark, units, alpha):
    rows = [("g", u, float(v)) for u, vs in enumerate(units) for v in vs] + [("g", 0, None)]
    got = S.krippendorff(spark.createDataFrame(rows, "g string, u int, v double"), ["g"], "u", "v").collect()
    assert (got[0].alpha if got else None) == (pytest.approx(alpha, abs=1e-5) if alpha is not None else None)


def test_bootstrap(spark):
    df = spark.createDataFrame([("a", float(k % 2)) for k in range(400)] + [("b", None)], "g string, f double")
    out = S.bootstrap(df, ["g"], "f", 500).collect()
    assert len(out) == 1 and out[0].mean == 0.5 and 0.4 < out[0].ci_lo < 0.5 < out[0].ci_hi < 0.6
    assert out == S.bootstrap(df, ["g"], "f", 500).collect()


def test_tails():
    assert S.f_tail(4.0, 1, 10) == pytest.approx(0.0734, abs=1e-4)
    assert S.incomplete_beta(2, 3, 0.5) == pytest.approx(0.6875)


def test_shapiro():
    x = np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float)
    w, p = S.shapiro_wilk(x)
    assert w == pytest.approx(0.79, abs=0.01) and p == pytest.approx(0.0067, abs=0.002)
    assert all(math.isnan(v) for v in S.shapiro_wilk(np.ones(5)))


def test_anova_and_t(spark):
    df = spark.createDataFrame([("g", c, v) for c, vs in (("a", (1.0, 2.0, 3.0)), ("b", (2.0, 3.0, 4.0)), ("c", (5.0, 6.0, 7.0))) for v in vs], "g string, c string, v double")
    r = one(S.anova(df, ["g"], "c", "v"))
    assert (round(r.f, 6), r.df1, r.df2) == (13.0, 2, 6) and r.p == pytest.approx(0.00659, abs=1e-4)
    d = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", 3.0)], "g string, d double")
    assert one(S.paired_t(d, ["g"], "d")).t == pytest.approx(3.4641, abs=1e-4)


def test_anova_with_a_large_mean_and_ties(spark):
    df = spark.createDataFrame([(k // 3, float(x) + 1e9) for k, x in enumerate((0, 1, 2, 1, 2, 3))], "c int, v double")
    assert abs(S.anova(df, [], "c", "v").first().f - 1.5) < 1e-9
    tied = spark.createDataFrame([(b, c, 1.0) for b in range(3) for c in "xyz"], "b int, c string, v double")
    r = S.friedman(tied, [], ["b"], "c", "v").first()
    assert r.chi2 is None and r.p is None
    few = S.guarded(S.summary(df, ["c"], "v"), "count", ["mean"]).collect()
    assert all(x.status == "insufficient" and x["mean"] is None for x in few)


def test_normality_without_groups_and_flags_that_are_none(spark):
    df = spark.range(50).selectExpr("cast(id as double) v", "0.25D f")
    assert S.normality(df, [], "v").first().n == 50
    with pytest.raises(Exception, match="other than"):
        S.bootstrap(df, [], "f").collect()


@pytest.mark.parametrize(("f", "d1", "d2"), [(4.0, 1, 10), (0.2, 3, 7), (13.0, 2, 6), (1.01, 4, 100_000), (900.0, 1, 5), (0.0, 2, 2), (1e-9, 1, 1), (3.0, 40, 40), (2.0, 0, 5)])
def test_tail_columns(spark, f, d1, d2):
    """The column is the number's, and that of a plain sum over the density."""
    got = one(spark.range(1).select(S.f_tail_column(F.lit(f), F.lit(d1), F.lit(d2)).alias("p"))).p
    assert got is None if not d1 else got == pytest.approx(S.f_tail(f, d1, d2), rel=1e-9)
    if d1 > 1 and 0 < f < 10:
        x = np.linspace(0, d1 * f / (d2 + d1 * f), 200_001)
        log = (d1 / 2 - 1) * np.log(np.maximum(x, 1e-300)) + (d2 / 2 - 1) * np.log1p(-x)
        below = np.trapezoid(np.exp(log + math.lgamma((d1 + d2) / 2) - math.lgamma(d1 / 2) - math.lgamma(d2 / 2)), x)
        assert got == pytest.approx(1 - below, abs=1e-5)
