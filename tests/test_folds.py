"""The models of all folds trained in shared passes, against separate fits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from featmart.operators import folds as FO
from featmart.operators import model as MD


def table(spark, n=600, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x, z, c = rnd.gauss(1e6, 3e5), rnd.choice([None, rnd.uniform(-1, 1)]), "rare" if i == 1 else rnd.choice(["a", "b", "b", "c", None])
        y = int(rnd.random() < 1 / (1 + np.exp(-((x - 1e6) / 3e5 + (c == "b") - 0.5)))) if i % 9 else None
        rows.append((i, i // 2, x, z, c, y))
    return spark.createDataFrame(rows, "id long, ent long, x double, z double, c string, y int")


def separate(rows, fold, k, C=1.0):
    """One model per fold by plain numpy Newton steps on its own training rows; scores by row."""
    lab = [r for r in rows if r["y"] is not None]
    out, weights = {}, []
    levels = sorted({r["c"] for r in lab if r["c"]})
    for f in range(k):
        train = [r for r in lab if fold[r["ent"]] != f]
        zs = [r["z"] for r in train if r["z"] is not None]
        fill = np.mean(zs)

        def raw(rs):
            return np.array([[r["x"], fill if r["z"] is None else r["z"], *[float(r["c"] == v) for v in levels]] for r in rs])
        t, y = raw(train), np.array([r["y"] for r in train], float)
        mean, std = t.mean(0), t.std(0, ddof=1)
        inv = np.divide(1, std, out=np.zeros_like(std), where=std > 0)
        a = np.hstack(((t - mean) * inv, np.ones((len(t), 1))))
        pen = np.append(np.full(a.shape[1] - 1, 1 / (C * len(lab))), 0)
        w = np.zeros(a.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-a @ w))
            w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a / len(a) + np.diag(pen + 1e-13), a.T @ (p - y) / len(a) + pen * w)
        weights.append(w)
        b = np.hstack(((raw(rows) - mean) * inv, np.ones((len(rows), 1))))
        out[f] = 1 / (1 + np.exp(-b @ w))
    score = {}
    for i, r in enumerate(rows):
        score[r["id"]] = out[fold[r["ent"]]][i] if r["y"] is not None else np.mean([out[f][i] for f in range(k)])
    return np.array(weights), score


def test_one_pass_folds_equal_separate_fits(spark):
    df = table(spark)
    k = 4
    folds = MD.stratified_folds(df, "ent", "y", k)
    fold = {r.ent: r.fold for r in folds.collect()}
    want_w, want = separate([r.asDict() for r in df.collect()], fold, k)
    m = FO.fit(df.join(folds, "ent", "left"), "y", "fold", ["x", "z"], ["c"], k)
    assert m.passes <= 10
    assert m.design.levels == [("c", "a"), ("c", "b"), ("c", "c"), ("c", "rare")]
    assert np.abs(m.weights - want_w).max() < 1e-6
    got = {r.id: r.score for r in MD.oof_scores(df, "id", "ent", "y", ["x", "z"], ["c"], k).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-8


def test_one_pass_folds_agree_with_spark_ml(spark):
    df = table(spark, 400, 5)
    a = {r.id: r.score for r in MD.oof_scores(df, "id", "ent", "y", ["x", "z"], ["c"], 3).collect()}
    b = {r.id: r.score for r in MD.oof_scores(df, "id", "ent", "y", ["x", "z"], ["c"], 3, max_columns=2).collect()}
    assert a.keys() == b.keys() and max(abs(a[i] - b[i]) for i in a) < 5e-3


def test_passes_do_not_grow_with_the_folds(spark):
    df = table(spark, 300, 7)
    passes = {}
    for k in (2, 8):
        d = df.join(MD.stratified_folds(df, "ent", "y", k), "ent", "left")
        passes[k] = FO.fit(d, "y", "fold", ["x"], ["c"], k).passes
    assert max(passes.values()) <= 10


def test_folds_without_numbers_or_variation(spark):
    df = table(spark, 200, 9).withColumns({"one": F.lit(1.0), "same": F.lit("s")})
    s = MD.oof_scores(df, "id", "ent", "y", ["one"], ["same"], 3)
    by = s.groupBy("fold").agg(F.min("score"), F.max("score")).collect()
    assert all(r[1] == pytest.approx(r[2], abs=1e-9) for r in by)          # nothing to learn from: the rate of the training rows
    assert MD.oof_scores(df, "id", "ent", "y", [], ["c"], 3).where("score between 0 and 1").count() == 200
