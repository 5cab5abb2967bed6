"""Encoders, binning, selection and model metrics on hand-made frames."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from featmart.operators import encode as EN
from featmart.operators import model as MD
from featmart.operators import select as SE
from featmart.sources import split_by_label


def test_bin_index_edges(spark):
    edges = [1.0, 2.0, 4.0]
    df = spark.createDataFrame([(0.5,), (1.0,), (1.5,), (2.0,), (3.0,), (4.0,), (4.5,), (None,)], "x double")
    got = [r[0] for r in df.select(EN.bin_index("x", edges)).collect()]
    assert got == [None, 0, 0, 0, 1, 1, None, None]


def test_quantile_edges_drop_duplicates(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 0, 0, 0, 0, 0, 1, 2, 3, 4]], "x double")
    e = EN.quantile_edges_fit(df, ["x"], q=10)["x"]
    assert e == sorted(set(e)) and e[0] == 0.0 and e[-1] == 4.0


def test_one_hot_nulls_unseen(spark):
    tr = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    lv = EN.one_hot_fit(tr)
    te = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    out, new = EN.one_hot_apply(te, lv)
    assert new == ["c_a", "c_b", "c_nan"]
    assert [tuple(r) for r in out.collect()] == [(1, 0, 0), (0, 0, 0), (0, 0, 1)]


def test_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",), ("c",), (None,)], "c string")
    assert {r.level: r.code for r in EN.sorted_codes_fit(df, "c").collect()} == {"a": 0, "b": 1, "c": 2}
    codes = EN.frequency_codes_fit(df, "c")
    assert {r.level: r.code for r in codes.collect()} == {"b": 0, "c": 1, "a": 2}
    got = sorted((r.c or "", r.c_code) for r in EN.codes_apply(df, "c", codes).collect())
    assert got == [("", -1), ("a", 2), ("b", 0), ("b", 0), ("c", 1), ("c", 1)]


def test_woe_roundtrip_and_unseen(spark):
    rows = [("x", 1), ("x", 0), ("x", 0), ("y", 1), ("y", 1), (None, 0), ("z", 0)]
    df = spark.createDataFrame(rows, "c string, y int")
    t = EN.woe_fit(df, "y", cat_cols=["c"]).collect()
    woe = {r.value: r.woe for r in t}
    assert set(woe) == {"x", "y", "z", "Missing"}
    m = 3 / 7 + 0.5
    base = m / (1 - m + 0.5)
    assert woe["x"] == pytest.approx(math.log((1 + 1e-10) / (3 + 1e-10) / base))
    test = spark.createDataFrame([("x", 0), ("q", 0), (None, 0)], "c string, y int")
    test = test.withColumn("k", test["c"])
    woes = {r.k: r.c for r in EN.woe_apply(test, EN.woe_fit(df, "y", cat_cols=["c"])).collect()}
    got = [woes["x"], woes["q"], woes[None]]
    assert got[0] == pytest.approx(woe["x"]) and got[1] is None and got[2] == pytest.approx(woe["Missing"])


def test_information_value_nonnegative(spark):
    rnd = random.Random(1)
    rows = [(rnd.uniform(0, 10), int(rnd.random() < 0.3)) for _ in range(300)]
    df = spark.createDataFrame(rows, "x double, y int")
    bins = EN.optimal_bins_fit(df, "y", ["x"], prebins=10, min_share=0.05)
    b = bins.collect()
    assert all(r.iv >= -1e-12 for r in b)
    assert sum(r["count"] for r in b) == 300
    counts = [r["count"] for r in sorted(b, key=lambda r: r.bin)]
    assert all(c >= 0.05 * 300 for c in counts)
    rates = [r.events / r["count"] for r in sorted(b, key=lambda r: r.bin)]
    d = [b2 - a for a, b2 in zip(rates, rates[1:]) if b2 != a]
    assert all(x > 0 for x in d) or all(x < 0 for x in d)
    iv = SE.information_value(bins, 0.02).first()
    assert iv.stat >= 0


def test_risk_groups_equal_limits(spark):
    rows = [("a", 1)] * 1 + [("a", 0)] * 9 + [("b", 0)] * 5 + [("c", 1)] * 1 + [("c", 0)] * 99
    df = spark.createDataFrame(rows, "c string, y int")
    t = {r.c: r for r in EN.risk_groups_fit(df, "c", "y", upper=10.0, lower=10.0).collect()}
    assert (t["a"].high, t["a"].low) == (1, 1)         # exactly at the limit: both
    assert (t["b"].high, t["b"].low) == (0, 0)         # no target rows: neither
    assert (t["c"].high, t["c"].low) == (0, 1)


def test_selectors(spark):
    df = spark.createDataFrame([(1.0, 1.0, None, 5.0), (2.0, 2.1, None, 5.0), (3.0, 2.9, 1.0, 5.0)],
                               "a double, b double, c double, d double")
    miss = {r.feature: r.keep for r in SE.missing_share(df, 0.5).collect()}
    assert miss == {"a": True, "b": True, "c": False, "d": True}
    const = {r.feature: r.keep for r in SE.constant_columns(df).collect()}
    assert const["d"] is False and const["a"] is True
    corr = {r.feature: r.keep for r in SE.correlated(df, ["a", "b", "d"], 0.9).collect()}
    assert corr == {"a": True, "b": False, "d": True}


def test_auc_matches_brute_force(spark):
    rnd = random.Random(9)
    rows = [(float(rnd.randint(0, 20)), int(rnd.random() < 0.4)) for _ in range(200)]
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    brute = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg)) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "s double, y int")
    r = MD.auc(df, "s", "y", chunk_rows=4).first()
    assert r.auc == pytest.approx(brute, rel=1e-12) and r.gini == pytest.approx(2 * brute - 1, rel=1e-12)


def test_hash_fold_stable(spark):
    import duckdb
    df = spark.createDataFrame([(i,) for i in range(50)], "id long")
    got = [r.f for r in df.select(MD.hash_fold("id").alias("f")).collect()]
    con = duckdb.connect()
    exp = [con.execute(f"SELECT CAST(('0x' || substr(md5('{i}-42'), 1, 8)) AS BIGINT) % 5").fetchone()[0]
           for i in range(50)]
    assert got == exp


def test_oof_covers_each_labelled_row_once(spark):
    rnd = random.Random(2)
    rows = [(i, i // 3, rnd.uniform(0, 1), int(rnd.random() < 0.5) if i < 90 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, ent long, x double, y int")
    s = MD.oof_scores(df, "id", "ent", "y", ["x"], k=3, max_iter=20)
    c = s.groupBy("id").count().collect()
    assert len(c) == 100 and all(r["count"] == 1 for r in c)
    folds = s.filter(F.col("y").isNotNull()).groupBy("ent").agg(F.countDistinct("fold").alias("n")).collect()
    assert all(r.n == 1 for r in folds)


def test_split_union_is_input(spark):
    df = spark.createDataFrame([(1, 1), (2, None), (3, 0)], "id int, y int")
    a, b = split_by_label(df, "y")
    assert sorted(a.unionByName(b).collect()) == sorted(df.collect())


def test_many_levels(spark):
    """50,000 levels: codes, WoE and risk groups are joins, with no limit on the levels."""
    n = 50_000
    df = spark.range(2 * n).select((F.col("id") % n).cast("string").alias("c"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    coded = EN.codes_apply(df, "c", EN.sorted_codes_fit(df, "c"))
    assert coded.agg(F.countDistinct("c_code"), F.min("c_code"), F.max("c_code")).first() == (n, 0, n - 1)
    assert EN.woe_apply(df, EN.woe_fit(df, "y", cat_cols=["c"])).where("c IS NULL").count() == 0
    assert EN.risk_groups_apply(df, "c", EN.risk_groups_fit(df, "c", "y")).agg(F.sum("c_high_risk")).first()[0] > 0
    bins = EN.optimal_bins(df, "y", cat_cols=["c"])
    assert bins.levels.count() == n and bins.table.count() <= 20


def test_categorical_bins(spark):
    rows = [(c, int(i < k)) for c, k in (("a", 5), ("b", 10), ("c", 60), ("d", 62)) for i in range(100)] + [("rare", 1), (None, 1), (None, 0)]
    df = spark.createDataFrame(rows, "c string, y int")
    bins = EN.optimal_bins(df, "y", cat_cols=["c"])
    t = sorted(bins.table.collect(), key=lambda r: r.bin)
    assert sum(r["count"] for r in t) == 401 and all(r["count"] >= 0.05 * 401 for r in t)
    woe = {r.c: r.c_binned for r in EN.binned_apply(df, bins, missing_value=0.05).collect()}
    assert woe["a"] <= woe["b"] < woe["c"] <= woe["d"] <= woe["rare"] and woe[None] == 0.05


def test_stratified_folds_keep_entities_together(spark):
    df = spark.createDataFrame([(e, int(e % 4 == 0)) for e in range(40) for _ in range(3)] + [(99, None)], "e int, y int")
    f = MD.stratified_folds(df, "e", "y", k=5)
    per = f.join(df.distinct(), "e").groupBy("fold", "y").count().collect()
    assert f.count() == 40 and {r["count"] for r in per if r.y == 1} == {2} and {r["count"] for r in per if r.y == 0} == {6}
