"""Cleaning rules and sources on hand-made frames."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from featmart.operators import clean as CL
from featmart.operators import joins as J
from featmart.session import checkpoint_dir
from featmart.sources import read_csv, write_table


def test_sentinels_and_caps(spark):
    df = spark.createDataFrame([(365243, "XNA", -5, 50.0), (10, "ok", 3, 5.0), (None, "", 0, None)],
                               "DAYS_X int, s string, DAYS_Y int, c double")
    out = CL.sentinel_to_null(df, ["DAYS_X"])
    out = CL.string_sentinels_to_null(out)
    out = CL.nonnegative_to_null(out, "DAYS")
    out = CL.cap_to_null(out, {"c": 40})
    r = out.collect()
    assert r[0].DAYS_X is None and r[0].s is None and r[0].DAYS_Y == -5 and r[0].c is None
    assert r[1].DAYS_X is None and r[1].DAYS_Y is None and r[1].c == 5.0     # 10 >= 0 -> NULL
    assert r[2].s is None and r[2].DAYS_Y is None


def test_infinite_rules(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1.0,), (inf,), (-inf,), (5.0,), (float("nan"),)], "x double")
    assert [r.x for r in CL.infinite_to_null(df).collect()] == [1.0, None, None, 5.0, None]
    b = [r.x for r in CL.infinite_to_bounds(df).collect()]
    assert b[1] == 5.0 and b[2] == 1.0


def test_imputation(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, "b"), (10.0, None)], "x double, s string")
    assert [r.x for r in CL.fill_statistic(df, ["x"], "mean").collect()][1] == pytest.approx(14 / 3)
    assert [r.x for r in CL.fill_statistic(df, ["x"], "median").collect()][1] == 3.0
    assert [r.x for r in CL.fill_statistic(df, ["x"], "max_plus_one").collect()][1] == 11.0
    assert [r.s for r in CL.fill_statistic(df, ["s"], "mode").collect()][3] == "b"


def test_recodes(spark):
    df = spark.createDataFrame([("XNA", 9, "Business Entity Type 3", "Higher"), ("M", 20, "School", "Lower")],
                               "g string, h int, org string, edu string")
    r = df.select(CL.recode("g", {"XNA": "F"}).alias("g"), CL.int_set_label("h", [(8, 17, "work")], "off").alias("h"),
                  CL.substring_group("org", [("Business", "biz"), ("School", "edu")]).alias("o"),
                  CL.ordinal("edu", ["Lower", "Higher"]).alias("e")).collect()
    assert [tuple(x) for x in r] == [("F", "work", "biz", 1), ("M", "off", "edu", 0)]


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], "`a b` int, `c:d` int")
    assert CL.sanitize_names(df).columns == ["a_b", "c_d"]
    assert CL.sanitize_names(df, "json").columns == ["a b", "cd"]
    clash = spark.createDataFrame([(1, 2)], "`a b` int, `a_b` int")
    with pytest.raises(ValueError):
        CL.sanitize_names(clash)
    dup = df.select(F.col("`a b`").alias("k"), F.col("`c:d`").alias("k"))
    assert CL.drop_duplicate_names(dup).columns == ["k"]


def test_narrowest_types(spark):
    df = spark.createDataFrame([(1, 100000, 1.5), (-3, 5, 2.5)], "a bigint, b bigint, c double")
    t = {r.column: r.type for r in CL.narrowest_types(df).collect()}
    assert t == {"a": "tinyint", "b": "int", "c": "float"}


def test_csv_roundtrip_and_index_column(spark):
    base = os.path.join(checkpoint_dir(spark).replace("file:", ""), "test-io", next(tempfile._get_candidate_names()))
    df = spark.createDataFrame([(0, 1, "x"), (1, None, "y")], "_c0 int, v int, s string")
    write_table(df, base, fmt="csv")
    back = read_csv(spark, base, schema="_c0 INT, v INT, s STRING")
    assert back.columns == ["v", "s"]
    assert sorted((tuple(r) for r in back.collect()), key=lambda t: t[1]) == [(1, "x"), (None, "y")]


def test_union_named_and_semi_anti(spark):
    a = spark.createDataFrame([(1, 2.0)], "k int, x double")
    b = spark.createDataFrame([(2, "s")], "k int, y string")
    u = J.union_named([a, b]).collect()
    assert len(u) == 2 and u[1].x is None and u[0].y is None
    ids = spark.createDataFrame([(1,)], "k int")
    assert [r.k for r in J.semi(J.union_named([a, b]), ids, "k").collect()] == [1]
    assert [r.k for r in J.anti(J.union_named([a, b]), ids, "k").collect()] == [2]
    with pytest.raises(ValueError):
        J.star_join(a, "k", [a])


def test_spec_json_handoff_and_scored_file(spark):
    from featmart.operators.agg import AggSpec
    from featmart.sources import load_json, save_json, write_scores
    base = os.path.join(checkpoint_dir(spark).replace("file:", ""), "test-io", next(tempfile._get_candidate_names()))
    os.makedirs(base, exist_ok=True)
    spec = AggSpec([("x", ["sum", "median"], "x * 2")], order=["t"])
    save_json(spark, {"spec": spec.to_json()}, f"{base}/spec.json")
    back = AggSpec.from_json(load_json(spark, f"{base}/spec.json")["spec"])
    assert back.to_json() == spec.to_json() and back.names() == ["x_sum", "x_median"]
    df = spark.createDataFrame([(5, 0.25), (7, 0.75)], "id long, p double")
    write_scores(df, "id", "p", f"{base}/scores")
    got = read_csv(spark, f"{base}/scores", schema="id INT, p DOUBLE")
    assert dict(got.dtypes)["id"] == "int"
    assert sorted(tuple(r) for r in got.collect()) == [(5, 0.25), (7, 0.75)]


def test_bounded_collect(spark):
    df = spark.range(10)
    assert len(J.collect_bounded(df, 10)) == 10
    with pytest.raises(ValueError):
        J.collect_bounded(df, 9)
