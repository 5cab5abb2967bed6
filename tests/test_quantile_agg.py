"""Skew-safe percentiles / mode and the aggregate spec."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from featmart.operators import agg as A
from featmart.operators import quantile as Q


@pytest.mark.parametrize("adaptive", [True, False])
def test_percentiles_match_numpy_with_hot_key(spark, adaptive):
    rnd = random.Random(11)
    rows = [("hot" if i % 4 else f"k{i % 5}", rnd.choice([None, rnd.randint(0, 40) * 0.5])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: [r[f"p{i}"] for i in range(len(probs))] for r in Q.percentiles(df, ["k"], "v", probs, adaptive=adaptive).collect()}
    for k in {r[0] for r in rows}:
        vals = [v for kk, v in rows if kk == k and v is not None]
        if not vals:
            assert k not in got
            continue
        exp = np.percentile(vals, [p * 100 for p in probs])
        assert got[k] == pytest.approx(list(exp), rel=1e-12, abs=1e-12)


def test_hot_value_and_null_key(spark):
    df = spark.createDataFrame([(None, 5.0)] * 90 + [(None, float(i)) for i in range(10)] + [("a", None)], "k string, v double")
    r = Q.percentiles(df, ["k"], "v", [0.01, 0.5, 0.99], chunk_rows=4).collect()
    vals = [5.0] * 90 + [float(i) for i in range(10)]
    assert len(r) == 1 and [r[0].p0, r[0].p1, r[0].p2] == pytest.approx(list(np.percentile(vals, [1, 50, 99])))


def _shuffled_rows(spark, run):
    """Rows that went through exchanges, over all jobs of ``run``, from the plans that ran."""
    import featmart.operators.quantile as module
    seen, cut = [], module.cut_lineage

    def keep(df):
        out = cut(df)
        seen.append(out.count())
        return out
    module.cut_lineage = keep
    try:
        run()
    finally:
        module.cut_lineage = cut
    return sum(seen)


@pytest.mark.parametrize("n_groups", [1, 3])
def test_bracketed_percentiles_match_numpy(spark, n_groups):
    rnd = random.Random(n_groups)
    kinds = [lambda: rnd.gauss(0, 1), lambda: float(rnd.randint(0, 5)), lambda: rnd.choice([7.0] * 9 + [rnd.random() * 100])]
    rows = [(f"k{i % n_groups}" if i % n_groups else None, rnd.choice([None, kinds[i % n_groups]()])) for i in range(6_000)]
    df = spark.createDataFrame(rows, "k string, v double")
    for probs in ([0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0], [0.5], [1.0], [0.0], [i / 30 for i in range(31)]):
        got = {r.k: [r[f"p{i}"] for i in range(len(probs))] for r in Q.bracketed_percentiles(df, ["k"], "v", probs, accuracy=200).collect()}
        exact = {r.k: [r[f"p{i}"] for i in range(len(probs))] for r in Q.percentiles(df, ["k"], "v", probs).collect()}
        assert got == exact                                   # to the last bit
        for k in got:
            vals = [v for kk, v in rows if kk == k and v is not None]
            assert got[k] == pytest.approx(list(np.percentile(vals, [p * 100 for p in probs])), rel=1e-12, abs=1e-12)


def test_brackets_shuffle_few_rows_of_a_unique_column(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("f").alias("k"), F.xxhash64("id").cast("double").alias("v"))
    moved = _shuffled_rows(spark, lambda: Q.bracketed_percentiles(df, ["k"], "v", [0.25, 0.5, 0.75]).collect())
    assert moved < 0.02 * n
    hot = df.withColumn("v", F.when(F.col("v") > -8e18, 1.0).otherwise(F.col("v")))        # some 90 % equal values
    assert _shuffled_rows(spark, lambda: Q.bracketed_percentiles(hot, ["k"], "v", [0.01, 0.5, 0.99]).collect()) < 0.02 * n


def test_rows_are_not_shuffled_to_meet_their_brackets(spark, monkeypatch):
    """The brackets are broadcast whatever the planner thinks of their size; many groups take the other form."""
    plans, cut = [], Q.cut_lineage
    monkeypatch.setattr(Q, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    df = spark.range(5_000).select((F.col("id") % 3).alias("k"), F.xxhash64("id").cast("double").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.k: r.p0 for r in Q.bracketed_percentiles(df, ["k"], "v", [0.5]).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    (place,) = [p for p in plans if "BroadcastHashJoin" in p]
    assert "SortMergeJoin" not in place and place.count("Exchange hashpartitioning") == 1 and "partial_count" in place
    plans.clear()
    monkeypatch.setattr(Q, "BRACKET_GROUPS", 2)
    assert {r.k: r.p0 for r in Q.bracketed_percentiles(df, ["k"], "v", [0.5]).collect()} == got and not any("BroadcastHashJoin" in p for p in plans)


def test_brackets_fall_back_when_a_rank_is_outside(spark, monkeypatch):
    df = spark.createDataFrame([("a", float(i)) for i in range(500)], "k string, v double")
    monkeypatch.setattr(F, "percentile_approx", lambda c, p, a: F.array(*[F.lit(1.5) for _ in p]))       # a sketch that knows nothing
    (r,) = Q.bracketed_percentiles(df, ["k"], "v", [0.0, 0.5, 0.75]).collect()
    assert (r.p0, r.p1, r.p2) == (0.0, 249.5, 374.25)
    none = spark.createDataFrame([("a", None)], "k string, v double")
    assert Q.bracketed_percentiles(none, ["k"], "v", [0.5]).collect() == []


def test_global_column_quantiles(spark):
    df = spark.createDataFrame([(float(i), float(i % 3)) for i in range(101)], "a double, b double")
    q = Q.column_quantiles(df, ["a", "b"], [0.0, 0.5, 1.0])
    assert q["a"] == [0.0, 50.0, 100.0] and q["b"] == [0.0, 1.0, 2.0]


def test_mode_ties_smallest(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("a", "x"), ("a", None), ("b", "z")],
                               "k string, v string")
    r = {x.k: x.mode for x in Q.mode_by(df, ["k"], "v").collect()}
    assert r == {"a": "x", "b": "z"}


def test_aggspec_json_and_holistic(spark):
    spec = A.AggSpec([("v", ["sum", "median", "mode", "max"], "v")], order=["t"])
    assert A.AggSpec.from_json(spec.to_json()).to_json() == spec.to_json()
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("a", 3, 3.0), ("b", 1, 2.0)], "k string, t int, v double")
    r = {x.k: x for x in A.aggregate(df, "k", spec).collect()}
    assert r["a"].v_median == 3.0 and r["a"].v_mode == 3.0 and r["a"].v_sum == 7.0
    assert list(A.aggregate(df, "k", spec).columns) == ["k", "v_sum", "v_median", "v_mode", "v_max"]


def test_rollup_totals_equal_flat(spark):
    rnd = random.Random(5)
    rows = [(c, c * 100 + o, rnd.uniform(0, 10)) for c in range(6) for o in range(rnd.randint(1, 4))
            for _ in range(rnd.randint(1, 3))]
    df = spark.createDataFrame(rows, "cust int, ord int, x double")
    spec = A.AggSpec([("x", ["sum"], "x")])
    top = A.rollup(df, "ord", "cust", spec)
    flat = df.groupBy("cust").agg(F.sum("x").alias("s")).collect()
    t = {r.cust: r.x_sum_sum for r in top.collect()}
    for r in flat:
        assert t[r.cust] == pytest.approx(r.s)


def test_cond_agg_matches_filtered(spark):
    df = spark.createDataFrame([(1, "F", 1.0), (1, "O", 2.0), (1, None, 4.0), (2, "F", 8.0), (2, "P", 16.0)],
                               "k int, s string, x double")
    out = {r.k: r for r in A.cond_agg(df, "k", "s", ["F", "O"], A.AggSpec([("x", ["sum", "size"], "x")])).collect()}
    assert out[1].x_sum_f == 1.0 and out[1].x_sum_o == 2.0 and out[1].x_sum_rest == 4.0
    assert out[2].x_sum_o == 0 and out[2].x_size_o == 0 and out[2].x_sum_rest == 16.0


def test_last_nonnull(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, None), (1, 3, 7.0), (1, 4, None)], "k int, t int, v double")
    r = df.groupBy("k").agg(A.last_nonnull("v", ["t"]).alias("l"), A.first_nonnull("v", ["t"]).alias("f")).first()
    assert r.l == 7.0 and r.f == 5.0
