"""Saved estimators, sparse one-hot, tree statistics, limited sorts and checked CSV reads."""

import os

import duckdb
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from featmart.operators import encode as EN
from featmart.operators import select as SE
from featmart.operators import seq as S
from featmart.operators import trees as TR
from featmart.operators.estimators import FiniteOrNull, LevelCoder, QuantileBinner, SupervisedBinner, WoeEncoder
from featmart.session import checkpoint_dir
from featmart.sources import read_csv_checked


def _rows(spark, n=400):
    return spark.range(n).select("id", F.when(F.col("id") % 11 == 0, float("inf")).when(F.col("id") % 13 == 0, None).otherwise((F.col("id") * 37 % 101).cast("double")).alias("x"),
                                 F.when(F.col("id") % 7 != 0, F.concat(F.lit("c"), (F.col("id") % 6).cast("string"))).alias("c"),
                                 F.when(F.col("id") % 5 != 0, (F.col("id") * 37 % 101 > 60).cast("int")).alias("y"))


def test_estimators_saved_in_a_pipeline_score_alike_in_a_new_session(spark, tmp_path):
    df = _rows(spark)
    stages = [FiniteOrNull(inputCols=["x"]), QuantileBinner(inputCols=["x"], bins=4), WoeEncoder(inputCols=["c"], numericCols=["x"], labelCol="y", missingValue=0.1),
              LevelCoder(inputCols=["c"], order="frequency"), SupervisedBinner(inputCols=["c"], numericCols=["x"], labelCol="y", prebins=8, missingValue=0.5),
              VectorAssembler(inputCols=["x_woe", "c_woe", "x_binned", "c_binned"], outputCol="v")]
    model = Pipeline(stages=stages).fit(df)
    want = sorted(map(str, model.transform(df).collect()))
    path = str(tmp_path / "model")
    model.write().save(path)
    other = spark.newSession()
    loaded = PipelineModel.load(path)
    assert [type(a) for a in loaded.stages] == [type(a) for a in model.stages] and [a.uid for a in loaded.stages] == [a.uid for a in model.stages]
    got = loaded.transform(other.createDataFrame(df.collect(), df.schema))
    assert sorted(map(str, got.collect())) == want
    # what the functions give
    t = EN.woe_apply(FiniteOrNull(inputCols=["x"]).transform(df), EN.woe_fit(FiniteOrNull(inputCols=["x"]).transform(df), "y", ["c"], ["x"]), "_woe", 0.1)
    a, b = ({r.id: (r.x_woe, r.c_woe) for r in d.collect()} for d in (t, got))
    assert a == b
    unseen = other.createDataFrame([(1, None, "new", None)], "id long, x double, c string, y int")
    (r,) = loaded.transform(unseen).collect()
    assert (r.x_bin, r.c_woe, r.c_code, r.x_binned, r.c_binned) == (None, 0.1, -1, 0.5, 0.5)


def test_a_fitted_model_can_be_saved_alone(spark, tmp_path):
    df = _rows(spark)
    model = LevelCoder(inputCols=["c"]).fit(df)
    model.write().save(str(tmp_path / "m"))
    again = type(model).load(str(tmp_path / "m"))
    assert sorted(map(str, again.transform(df).collect())) == sorted(map(str, model.transform(df).collect()))
    assert again.getInputCols() == ["c"]


def test_sparse_one_hot_of_fifty_thousand_levels(spark):
    n = 50_000
    df = spark.range(2 * n).select((F.col("id") % 10).alias("k"), (F.col("id") % n).cast("string").alias("c"), F.when(F.col("id") % 4 > 0, (F.col("id") % 3).cast("string")).alias("d"))
    counts = EN.level_counts(df, "k", ["c", "d"])
    assert counts.where("feature = 'c'").count() == n and counts.agg(F.sum("n")).first()[0] == 4 * n
    index = EN.one_hot_index(df, ["c", "d"])
    assert index.count() == n + 4 and index.agg(F.countDistinct("index"), F.min("index"), F.max("index")).first() == (n + 4, 0, n + 3)
    v = EN.one_hot_vector(df, ["c", "d"], index, "v")
    assert v.columns == ["k", "c", "d", "v"]
    some = v.where("c IN ('0', '17') AND k IN (0, 7)").collect()
    at = {(r.feature, r.level): r["index"] for r in index.where("feature = 'd' OR level IN ('0', '17')").collect()}
    assert len(some) == 4 and all(r.v.size == n + 4 and sorted(r.v.indices) == sorted([at["c", r.c], at["d", r.d]]) and set(r.v.values) == {1.0} for r in some)
    (r,) = EN.one_hot_vector(spark.createDataFrame([(0, "unseen", "0")], "k long, c string, d string"), ["c", "d"], index, "v").collect()
    assert list(r.v.indices) == [at["d", "0"]]


def test_first_last_limit_comes_before_the_exchange(spark):
    df = spark.range(1_000).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"), F.col("id").alias("id2"), F.rand(1).alias("v")).repartition(4)
    out = S.first_last_k(df, "k", ["t"], first_k=2, last_k=3)
    got = out.collect()
    for k in range(3):
        ts = sorted(r.t for r in df.where(F.col("k") == k).collect())
        assert sorted(r.t for r in got if r.k == k and r._first) == ts[:2] and sorted(r.t for r in got if r.k == k and r._last) == ts[-3:]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4          # either end: in the tasks, and after the exchange
    for end in plan.split("Exchange hashpartitioning(k")[1:]:
        assert "WindowGroupLimit" in end and "Partial" in end
    short = spark.createDataFrame([(1, 1), (1, None), (None, 5)], "k int, t int")
    rows = S.first_last_k(short, "k", ["t"], 1, 2).collect()
    assert sorted((r.k or 0, r.t or 0, r._first) for r in rows) == [(0, 5, False), (0, 5, True), (1, 0, False), (1, 1, False), (1, 1, True)]


@pytest.mark.parametrize("kind", ["forest", "boosting"])
def test_tree_statistics_by_sql_over_the_written_nodes(spark, tmp_path, kind):
    cols = ["a", "b", "c"]
    df = spark.range(800).select((F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), F.lit(1.0).alias("c"),
                                 ((F.col("id") % 17 > 8) | (F.col("id") % 5 == 0)).cast("int").alias("y"))
    model = SE.fitted_forest(df, cols, "y", trees=7) if kind == "forest" else SE.fitted_boosting(df, cols, "y", iters=6)
    nodes, path = TR.stored_nodes(model, str(tmp_path / "m"))
    got = {r.feature: (r.n_splits, r.n_trees, r.gain, r.cover) for r in TR.split_statistics(nodes, cols).collect()}
    sql = duckdb.sql(f"""SELECT nodeData.split.featureIndex AS f, count(*), count(DISTINCT treeID), sum(nodeData.gain), sum(nodeData.rawCount)
        FROM '{path}/data/*.parquet' WHERE nodeData.leftChild >= 0 GROUP BY 1""").fetchall()
    want = {c: (0, 0, 0.0, 0) for c in cols} | {cols[f]: tuple(x) for f, *x in sql}
    assert got.keys() == want.keys()
    for c in cols:
        assert got[c][:2] == want[c][:2] and got[c][3] == want[c][3] and got[c][2] == pytest.approx(want[c][2])
    assert got["c"] == (0, 0, 0.0, 0) and got["a"][0] > 0
    said = model.featureImportances.toArray()
    imp = {r.feature: r.importance for r in TR.gain_importances(nodes, cols, kind == "forest").collect()}
    assert [imp[c] for c in cols] == pytest.approx(list(said), abs=1e-9)
    if kind == "boosting":
        t = {r.feature: r.stat for r in SE.boosting_importance(df, cols, "y", iters=6).collect()}
        top = max(g[0] for g in got.values())
        assert t == {c: got[c][0] / top for c in cols}


def test_csv_with_broken_rows(spark, tmp_path):
    path = tmp_path / "t.csv"
    good = [f"{i},{i * 10},name {i},{i}.5,2020-01-{i % 28 + 1:02},{str(i % 2 == 0).lower()}" for i in range(60)]
    path.write_text("\n".join([",id,name,x,day,flag", *good[:20], "20,200,too,few", *good[20:40], "40,400,bad,abc,2020-01-01,true", "41,1,many,1.5,2020-01-01,true,9",
                               "42,420,two,xx,yesterday,true", "43,,,,,", *good[40:]]) + "\n")
    rows, bad = read_csv_checked(spark, str(path), quarantine=str(tmp_path / "bad"))
    assert [(c, t) for c, t in rows.dtypes] == [("id", "int"), ("name", "string"), ("x", "double"), ("day", "date"), ("flag", "boolean")]
    assert rows.count() == 61 and rows.where("id IS NULL").count() == 1
    assert rows.agg(F.sum("x")).first()[0] == sum(i + 0.5 for i in range(60))
    got = {r.reason: r.line for r in bad.collect()}
    assert got.keys() == {"not 6 fields", "x: not double", "x: not double; day: not date"} and bad.count() == 4
    assert all(r.file.endswith("t.csv") for r in bad.collect()) and os.path.isdir(tmp_path / "bad")
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("x", T.IntegerType()),
                           T.StructField("day", T.DateType()), T.StructField("flag", T.BooleanType())])
    rows, bad = read_csv_checked(spark, str(path), schema)
    assert dict(rows.dtypes)["id"] == "bigint" and rows.count() == 1 and bad.where("reason LIKE 'x: not int%'").count() == 62
    assert checkpoint_dir(spark)


def test_csv_types_tolerate_a_share_of_broken_values(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n" + "".join(f"{i if i % 10 else 'x'},{i}\n" for i in range(100)))
    assert dict(read_csv_checked(spark, str(path))[0].dtypes) == {"a": "string", "b": "int"}
    rows, bad = read_csv_checked(spark, str(path), tolerance=0.1)
    assert dict(rows.dtypes) == {"a": "int", "b": "int"} and (rows.count(), bad.count()) == (90, 10)
