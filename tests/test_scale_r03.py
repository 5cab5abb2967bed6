"""Findings of round 3: what a query reads once, counts by hash, or holds in one task."""
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from featmart.operators import encode as EN
from featmart.operators import select as SE
from featmart.operators import seq as S

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_importances_read_written_rows(spark, monkeypatch):
    """Both ensembles read their input many times: it has to be written, not derived from the tables again each time."""
    read = []
    monkeypatch.setattr(SE, "fitted_forest", lambda df, *a: read.append(df) or pytest.skip.Exception)
    with pytest.raises(Exception):
        E.queries()["select_importance"](spark, SF)
    assert "lineitem" not in _plan(read[0]) and "Join" not in _plan(read[0])


def test_keys_are_counted_by_hash(spark):
    """A count that only has to find keys above a limit shuffles a bounded table; its answer is never too small."""
    df = spark.range(3000).select((F.col("id") % 500).alias("k"), F.col("id").alias("v")).union(spark.createDataFrame([(None, i) for i in range(40)], "k long, v long"))
    assert S.within(df, ["k"], 40 + 6 * 3) and not S.within(df, ["k"], 39)
    assert S.within(df.where("false"), ["k"], 1)
    exact = S.largest_keys({"a": (df, ("k", None), None)})["a"]
    assert exact == 40 and S.largest_keys({"a": (df, ("k", None), None)}, hashed=["a"])["a"] >= 40


def test_final_marts_do_not_shuffle_keys_to_count_them(spark, monkeypatch):
    from featmart.plans import catalog_marts
    said = {}
    real = S.largest_keys
    monkeypatch.setattr(S, "largest_keys", lambda parts, *a, **k: said.update(k) or real(parts, *a, **k))
    catalog_marts.q_mart_final(spark, SF)
    assert {"lines", "events"} <= set(said.get("hashed", ()))


def test_short_rolling_means_are_lags_with_the_same_bits(spark):
    vals = [0.1, None, 0.2, 0.3, 1e17, -0.0, -0.0, -0.0, 5.5, float("nan"), 1.0, 2.0, 3.0, 7.7]
    df = spark.createDataFrame([(k, i, v) for k in range(2) for i, v in enumerate(vals)], "k int, i int, v double")
    got = S.sequence_features(df, "k", ["i"], {"m": ("rolling_mean", "v", 3), "z": ("rolling_mean", "v", 2, 0.0)})
    w = "OVER (PARTITION BY k ORDER BY i ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
    df.createOrReplaceTempView("short_rolls")
    want = spark.sql("SELECT *, CASE WHEN count(v) {0} = 3 THEN avg(v) {0} END AS m, coalesce(CASE WHEN count(v) {1} = 2 THEN avg(v) {1} END, 0D) AS z FROM short_rolls".format(w.format(2), w.format(1)))
    assert sorted(map(str, got.select("k", "i", "m", "z").collect())) == sorted(map(str, want.select("k", "i", "m", "z").collect()))
    assert "avg(" not in _plan(got).lower()


def test_ewm_windows_share_sorts(spark):
    df = spark.range(600).select((F.col("id") % 3).alias("k"), F.col("id").alias("i"), F.when(F.col("id") % 7 != 0, F.col("id") * 0.5).alias("x"))
    plain = S.sequence_features(df, "k", ["i"], {"e": ("ewm", "x", 0.9)})
    assert plain._jdf.queryExecution().executedPlan().toString().count("Sort [") <= 3          # four before
    cut = S.sequence_features(df, "k", ["i"], {"e": ("ewm", "x", 0.9)}, chunk_rows=50, adaptive=False)
    few = S.sequence_features(df, "k", ["i"], {"e": ("ewm", "x", 0.9)}, largest=200)
    a, b, c = ({r["i"]: r["e"] for r in d.collect()} for d in (plain, cut, few))
    assert a == c and all(abs(a[i] - b[i]) < 1e-9 if a[i] is not None else b[i] is None for i in a)


def test_few_levels_do_not_shuffle_the_rows(spark):
    df = spark.range(400).select("id", (F.col("id") % 4).cast("string").alias("c"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    out = EN.binned_apply(df, EN.optimal_bins(df, "y", [], ["c"]))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in out.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert out.count() == 400
