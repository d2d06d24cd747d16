"""Ranks and quantiles by buckets against numpy; every value a bucket, few buckets, and none."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonorium.operators import ranking
from sonorium.operators import stats as S

SCHEMA = "g string, h int, v double"


def rows(seed=1, n=900):
    r = random.Random(seed)
    out = [(r.choice(["a", "a", "a", "b", None]), r.choice([1, None]), r.choice([round(r.gauss(0, 3), 1), float(r.randint(0, 3)), None])) for _ in range(n)]
    return [*out, ("one", 1, 5.0), ("nulls", 1, None), ("same", 2, 1.5), ("same", 2, 1.5), ("inf", 3, float("inf")), ("inf", 3, -1e300)]


@pytest.mark.parametrize("every", [1, 3, 50, 1 << 16])
@pytest.mark.parametrize("by", [[], ["g"], ["g", "h"]])
def test_quantiles_and_ranks(spark, by, every):
    data = rows() if by else rows()[:-2]
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    at = [0.0, 0.25, 0.5, 0.9, 1.0]
    groups = {}
    for r in data:
        if r[2] is not None:
            groups.setdefault(tuple(r[: len(by)]), []).append(r[2])
    got = {tuple(r[c] for c in by): r.q for r in ranking.quantiles(df, by, "v", at, every=every).collect()}
    assert got.keys() == groups.keys()
    for k, v in groups.items():
        if not np.isinf(v).any():
            assert np.allclose(got[k], np.quantile(v, at), rtol=1e-12, atol=1e-12)
    counts = df.where("v is not null").groupBy(*by, "v").agg(F.count("*").alias("n"))
    ranked = ranking.mean_ranks(counts, by, "v", every=every).collect()
    assert len(ranked) == sum(len(set(v)) for v in groups.values())
    for r in ranked:
        v = groups[tuple(r[c] for c in by)]
        assert r.n == v.count(r.v) and r["rank"] == sum(x < r.v for x in v) + (r.n + 1) / 2


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    for by in ([], ["g"]):
        assert ranking.quantiles(none, by, "v", [0.5]).count() == 0
        assert S.ranks(none, by, "v").count() == 0
    assert S.summary(none, [], "v").first()["count"] == 0 and S.summary(none, ["g"], "v").count() == 0
    out = {r.g: r for r in S.summary(spark.createDataFrame(rows(), SCHEMA), ["g"], "v").collect()}
    assert out["nulls"]["count"] == 0 and out["nulls"].median is None and out[None].median is not None and out["same"].median == 1.5


@pytest.mark.parametrize("every", [2, 1 << 16])
def test_u_against_a_baseline(spark, monkeypatch, every):
    """One shared baseline is the same as the baseline repeated for each group."""
    monkeypatch.setattr(ranking, "EVERY", every)
    monkeypatch.setattr(ranking.running, "__defaults__", (every,))
    r = random.Random(4)
    own = spark.createDataFrame([(r.choice("abc"), float(r.randint(0, 12))) for _ in range(200)] + [("d", None), (None, 2.0)], "g string, v double")
    base = spark.createDataFrame([(float(r.randint(3, 15)),) for _ in range(70)] + [(None,)], "v double")
    both = own.withColumn("a", F.lit(True)).unionByName(own.select("g").distinct().crossJoin(base).withColumn("a", F.lit(False)))
    plain = lambda d: sorted(str([x if isinstance(x, str | int) or x is None else round(x, 9) for x in row]) for row in d.where("n1 > 0").collect())
    got = S.mann_whitney_against(own, ["g"], "v", base)
    assert plain(got) == plain(S.mann_whitney(both, ["g"], "v", F.col("a"))) and got.count() == 4
    assert S.mann_whitney_against(own, ["g"], "v", base.limit(0)).where("u is null").count() == 4


def test_no_window_over_a_whole_group(spark):
    """Windows of ranks are by bucket too; those by group alone run over bucket totals."""
    df = spark.createDataFrame(rows(), SCHEMA)
    for out in (S.ranks(df, ["g"], "v"), S.wilcoxon(df, ["g"], "v"), S.mann_whitney(df, ["g"], "v", F.col("h") == 1), S.summary(df, ["g"], "v")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.split("\n"):
            if "Window [" in line:
                assert "_bucket" in line or "_total" in line, line
        assert "percentile" not in plan and "median(" not in plan
