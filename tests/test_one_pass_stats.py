"""Pair sums, frequency sketches, density curves and limited sorts against direct computations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from featmart.operators import frequency as FR
from featmart.operators import gram as G
from featmart.operators import profile as PR
from featmart.operators import select as SE


def _jobs(spark, run):
    """How many jobs ``run`` starts, an action being one (adaptive execution makes each stage one)."""
    sc, group = spark.sparkContext, f"count-{id(run)}"
    sc.setJobGroup(group, group)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        run()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(group))


def test_correlations_match_pandas(spark):
    rng = np.random.default_rng(0)
    d = pd.DataFrame(rng.normal(size=(500, 6)) @ rng.normal(size=(6, 6)), columns=list("abcdef"))
    d["b"] = d["b"] + 1e9                     # a large mean beside a small spread
    d = d.mask(rng.random(d.shape) < 0.2)
    d["one"], d["none"], d["twice"] = 3.7, np.nan, d["a"] * 2
    df = spark.createDataFrame(d).repartition(5)
    got = {(r.a, r.b): r["corr"] for r in G.correlations(df, list(d.columns)).collect()}
    want = d.corr()
    assert len(got) == 36
    for (a, b), v in got.items():
        if np.isnan(want.loc[a, b]):
            assert v is None
        else:
            assert v == pytest.approx(want.loc[a, b], abs=1e-6 if "b" in (a, b) else 1e-9)


def test_correlations_of_many_columns_in_two_jobs(spark):
    """600 columns: one job for the means, one for the sums; no expression per pair."""
    cols = [f"c{i}" for i in range(600)]
    df = spark.range(400).select(*[F.rand(i).alias(c) for i, c in enumerate(cols)]).repartition(3)
    rows = []
    assert _jobs(spark, lambda: rows.extend(G.pair_sums(df, cols).select("ia", F.element_at("n", -1).alias("n")).collect())) == 2
    assert len(rows) == 600 and {r.n for r in rows} == {400.0}
    out = G.correlations(df, cols)
    assert out.count() == 600 * 599 // 2


def test_correlations_of_nothing(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert [r["corr"] for r in G.correlations(df, ["a", "b"]).collect()] == [None]


def test_frequency_bounds_hold(spark):
    n = 60_000
    df = spark.range(n).select(
        (F.col("id") % 3).alias("few"), (F.col("id") % 997).alias("some"), F.col("id").alias("unique"),
        F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("hot"), F.lit("x").alias("one"), F.lit(None).cast("string").alias("none"),
        F.floor(F.pow(F.rand(1), F.lit(8)) * 5000).alias("skewed"), F.when(F.col("id") < 2, F.col("id")).alias("two")).repartition(6)
    got = FR.variance_bounds(df, df.columns)
    pdf = df.toPandas()
    for c in df.columns:
        f = pdf[c].dropna().value_counts(normalize=True)
        if len(f) < 2:
            assert got[c] == (None, None)
            continue
        lo, hi = got[c]
        assert lo <= f.var() * (1 + 1e-9) + 1e-18 and f.var() <= hi * (1 + 1e-9) + 1e-18, c


def test_only_columns_near_the_threshold_are_counted(spark, monkeypatch):
    df = spark.range(20_000).select((F.col("id") % 2).alias("a"), F.col("id").alias("b"), (F.col("id") % 100).alias("c"),
                                    F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id")).alias("d"))
    exact = {t: {r.feature: r.keep for r in SE.frequency_variance(df, t, df.columns).collect()} for t in (1e-4, 0.4)}
    asked, count = [], SE.frequency_variance
    monkeypatch.setattr(SE, "frequency_variance", lambda d, t, cols, *k: asked.append(cols) or count(d, t, cols, *k))
    got = {t: {r.feature: r.keep for r in SE.select_by_frequency(df, t, df.columns).collect()} for t in exact}
    assert got == exact
    assert all(len(c) < 4 for c in asked)


def test_frequency_sketch_of_many_columns_is_one_job(spark):
    df = spark.range(2_000).select(*[(F.col("id") % (i + 2)).alias(f"c{i}") for i in range(500)])
    assert _jobs(spark, lambda: FR.variance_bounds(df, df.columns)) == 1


def test_density_is_near_the_direct_sum(spark):
    rng = np.random.default_rng(1)
    x = {0: rng.gamma(2, 100, 700), 1: np.concatenate((rng.normal(50, 5, 200), rng.normal(400, 30, 90)))}
    rows = [(k, float(v)) for k, vs in x.items() for v in vs] + [(None, 1.0), (0, None), (2, 5.0), (3, 7.0), (3, 7.0)]
    df = spark.createDataFrame(rows, "y int, v double")
    got = PR.density_curve(df, "v", "y", points=400).toPandas()
    assert set(got.y) == {0, 1}
    for k, vs in x.items():
        c = got[got.y == k].sort_values("i")
        h = len(vs) ** -0.2 * vs.std(ddof=1)
        direct = np.exp(-0.5 * ((c.x.to_numpy()[:, None] - vs[None, :]) / h) ** 2).sum(1) / (len(vs) * h * np.sqrt(2 * np.pi))
        assert np.abs(c.density.to_numpy() - direct).max() < 1e-3 * direct.max()
        assert np.trapezoid(c.density, c.x) == pytest.approx(1, abs=2e-3)
    assert PR.density_curve(df.where("y = 3"), "v", "y").count() == 0
