"""NULL / zero-division / rounding contract on hand-made frames."""

import math

from pyspark.sql import functions as F

from featmart.functions import exprs as X
from featmart.functions import nulls as N
from featmart.operators.agg import AggSpec, aggregate


def test_safe_div_and_pct(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0), (2, 0.0, 0.0), (3, None, 1.0), (4, 1.0, None), (5, -1.0, 0.0),
                                (6, 3.0, 2.0)], "k int, a double, b double")
    out = {r.k: (r.r, r.p) for r in df.select("k", N.safe_div("a", "b").alias("r"),
                                              N.pct_change("a", "b").alias("p")).collect()}
    assert out[1] == (None, None) and out[2] == (None, None) and out[5] == (None, None)
    assert out[3] == (None, None) and out[4] == (None, None)
    assert out[6] == (1.5, 50.0)


def test_flags_and_null_safe_ne(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, -1.0)], "k int, x double")
    r = {x.k: (x.f, x.ne) for x in df.select("k", N.flag(F.col("x") > 0).alias("f"),
                                             N.ne_null_safe("x", 5.0).alias("ne")).collect()}
    assert r[1] == (0, True) and r[2] == (1, False) and r[3] == (0, True)


def test_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (3.25,)], "x double")
    got = [r[0] for r in df.select(N.half_even("x")).collect()]
    assert got == [0.0, 2.0, 2.0, -0.0, 3.0]
    assert [r[0] for r in df.select(N.half_even("x", 1)).collect()][-1] == 3.2


def test_domain_guards(spark):
    df = spark.createDataFrame([(-2.0,), (-1.0,), (0.0,), (4.0,)], "x double")
    r = df.select(N.log1p_guarded("x").alias("l"), N.pow_guarded("x", 0.5).alias("p"),
                  N.sqrt_guarded("x").alias("s")).collect()
    assert r[0].l is None and r[1].l is None and r[2].l == 0.0
    assert r[0].p is None and r[2].p == 0.0 and r[3].p == 2.0 and r[3].s == 2.0


def test_group_semantics(spark):
    """all-NULL group sums to 0, one-row var is NULL, NULL key dropped, skew/kurt guarded."""
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0), (None, 5.0), ("c", 2.0), ("c", 2.0),
                                ("c", 2.0), ("c", 2.0)], "k string, v double")
    spec = AggSpec([("v", ["sum", "var", "count", "size", "skew", "kurt"], "v")])
    r = {x.k: x for x in aggregate(df, "k", spec).collect()}
    assert set(r) == {"a", "b", "c"}
    assert r["a"].v_sum == 0 and r["a"].v_count == 0 and r["a"].v_size == 2
    assert r["b"].v_var is None
    assert r["c"].v_skew == 0.0 and r["c"].v_kurt == 0.0      # constant group
    assert r["b"].v_skew is None


def test_bias_corrected_moments_match_pandas(spark):
    import pandas as pd
    vals = [1.0, 2.0, 2.5, 4.0, 7.5, 11.0, 0.5]
    df = spark.createDataFrame([("g", v) for v in vals], "k string, v double")
    spec = AggSpec([("v", ["skew", "kurt", "std"], "v")])
    r = aggregate(df, "k", spec).first()
    s = pd.Series(vals)
    assert math.isclose(r.v_skew, s.skew(), rel_tol=1e-9)
    assert math.isclose(r.v_kurt, s.kurt(), rel_tol=1e-9)
    assert math.isclose(r.v_std, s.std(), rel_tol=1e-12)


def test_row_stats_skip_nulls(spark):
    import pandas as pd
    rows = [(1.0, None, 3.0, 10.0), (None, None, None, None), (2.0, 2.0, 2.0, 2.0), (1.0, 5.0, 2.0, 9.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    cols = ["a", "b", "c", "d"]
    got = df.select(X.row_sum(cols).alias("s"), X.row_mean(cols).alias("m"), X.row_std(cols).alias("sd"),
                    X.row_nulls(cols).alias("n"), X.row_kurtosis(cols).alias("k")).collect()
    p = pd.DataFrame(rows, columns=cols)
    assert [g.s for g in got] == list(p.sum(axis=1))
    assert got[1].m is None and got[0].m == p.mean(axis=1)[0]
    assert math.isclose(got[0].sd, p.std(axis=1)[0], rel_tol=1e-12)
    assert [g.n for g in got] == [1, 4, 0, 0]
    assert got[2].k == 0.0
    assert math.isclose(got[3].k, p.kurt(axis=1)[3], rel_tol=1e-9)


def test_large_offsets_and_small_scales_do_not_cancel(spark):
    import pandas as pd
    df = spark.createDataFrame([(1e9, 1e9 + 1, 1e9 + 2, 1e9 + 7)], "a double, b double, c double, d double")
    r = df.select(X.row_std(["a", "b", "c"]).alias("s"), X.row_kurtosis(["a", "b", "c", "d"]).alias("k"), X.row_prod(["a"]).alias("p")).first()
    assert math.isclose(r.s, 1.0, rel_tol=1e-9) and math.isclose(r.k, pd.Series([0.0, 1, 2, 7]).kurt(), rel_tol=1e-6) and r.p == 1e9
    tiny = spark.createDataFrame([("g", 1e-8 * v) for v in (1.0, 2.0, 3.0, 9.0)], "k string, v double")
    t = aggregate(tiny, "k", AggSpec([("v", ["skew", "kurt"], "v")])).first()
    assert math.isclose(t.v_skew, pd.Series([1.0, 2, 3, 9]).skew(), rel_tol=1e-6)
    assert math.isclose(t.v_kurt, pd.Series([1.0, 2, 3, 9]).kurt(), rel_tol=1e-6)


def test_skipping_product_and_unit_flag(spark):
    from featmart.operators.clean import within_unit
    df = spark.createDataFrame([(2.0, None), (None, None), (3.0, 4.0)], "a double, b double")
    assert [r.p for r in df.select(X.row_prod(["a", "b"]).alias("p")).collect()] == [2.0, 1.0, 12.0]
    assert [r.f for r in df.select(within_unit("b", 2.0, 1.0).alias("f")).collect()] == [0, 0, 0]


def test_null_order_values_are_last(spark):
    from featmart.operators.agg import first_nonnull, last_nonnull
    df = spark.createDataFrame([("a", None, 1.0), ("a", 1, 2.0), ("a", 2, 3.0), ("a", 3, None)], "k string, o int, v double")
    r = df.groupBy("k").agg(first_nonnull("v", ["o"]).alias("f"), last_nonnull("v", ["o"]).alias("l")).first()
    assert (r.f, r.l) == (2.0, 1.0)


def test_mode_of_typed_columns(spark):
    from featmart.operators.clean import fill_statistic
    df = spark.createDataFrame([(10, "b", None), (9, "a", None), (None, None, None)], "x int, y string, z double")
    r = fill_statistic(df, ["x", "y", "z"], "mode").where("x = 9 AND y = 'a'").count()
    assert r == 2
