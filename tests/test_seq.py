"""Order-aware features: pandas semantics, and the chunked (skew-safe) plan equals the plain one."""

import math
import random

import pandas as pd
import pytest

from featmart.operators import seq as S

FEATS = {"d": ("diff", "v", 0.0), "run": ("running_sum", "v"), "cnt": ("running_count", "v"),
         "r3": ("rolling_mean", "v", 3), "up": ("increase", "v"), "e": ("ewm", "v", 0.7),
         "lag2": ("lag", "v", 2), "rn": ("row_number",)}


def _frame(spark, rows):
    return spark.createDataFrame(rows, "k string, t int, id int, v double")


def _collect(df):
    return {(r.k, r.t, r.id): r.asDict() for r in df.collect()}


SEQ_ROWS = [("a", 1, 1, None), ("a", 2, 2, 1.0), ("a", 2, 3, 4.0), ("a", 5, 4, None), ("a", 6, 5, 2.0),
            ("a", 7, 6, 3.0), ("a", 9, 7, None), ("b", 1, 8, 5.0)]


def test_plain_matches_pandas(spark):
    out = _collect(S.sequence_features(_frame(spark, SEQ_ROWS), "k", ["t", "id"], FEATS))
    p = pd.DataFrame(SEQ_ROWS, columns=["k", "t", "id", "v"]).sort_values(["k", "t", "id"])
    g = p.groupby("k")["v"]
    p["d"] = g.diff().fillna(0.0)
    p["r3"] = g.transform(lambda s: s.rolling(3).mean())
    p["e"] = g.transform(lambda s: s.ewm(alpha=0.7).mean())
    p["run"] = g.cumsum().fillna(0.0)
    for _, r in p.iterrows():
        got = out[(r.k, r.t, r.id)]
        assert got["d"] == pytest.approx(r.d)
        assert (got["r3"] is None) == math.isnan(r.r3)
        if got["r3"] is not None:
            assert got["r3"] == pytest.approx(r.r3)
        if math.isnan(r.e):
            assert got["e"] is None
        else:
            assert got["e"] == pytest.approx(r.e, rel=1e-12)
        assert got["run"] == pytest.approx(r.run)


@pytest.mark.parametrize("chunk", [3, 5, 8])
def test_chunked_equals_plain_on_hot_key(spark, chunk):
    rnd = random.Random(7)
    rows = []
    for i in range(300):
        k = "hot" if i % 3 else f"k{i % 11}"           # one key holds two thirds of the rows
        v = None if rnd.random() < 0.15 else round(rnd.uniform(-5, 5), 2)
        rows.append((k, rnd.randint(0, 50), i, v))
    feats = FEATS | {"ahead": ("lead", "v", 2), "n": ("key_count",), "all": ("key_sum", "v")}
    df = _frame(spark, rows)
    a = _collect(S.sequence_features(df, "k", ["t", "id"], feats))
    b = _collect(S.sequence_features(df, "k", ["t", "id"], feats, chunk_rows=chunk, adaptive=False))
    assert a.keys() == b.keys()
    for key in a:
        for n in feats:
            x, y = a[key][n], b[key][n]
            assert (x is None and y is None) or x == pytest.approx(y), (key, n, x, y)


@pytest.mark.parametrize("alpha", [0.7, 0.1, 0.01, 1.0])
@pytest.mark.parametrize("adaptive", [True, False])
def test_ewm_has_no_look_back_limit(spark, alpha, adaptive):
    """Long runs of NULL, thousands of rows, against pandas; every key cut into blocks or none."""
    rnd = random.Random(3)
    rows = [("hot", i, i, None if 40 < i < 640 or rnd.random() < 0.2 else rnd.uniform(0, 9)) for i in range(1500)]
    rows += [("gap", i, i, 10.0 + i if i < 3 else None) for i in range(60)] + [("none", i, i, None) for i in range(3)]
    got = _collect(S.sequence_features(_frame(spark, rows), "k", ["t", "id"], {"e": ("ewm", "v", alpha)}, chunk_rows=40, adaptive=adaptive))
    p = pd.DataFrame(rows, columns=["k", "t", "id", "v"])
    p["e"] = p.groupby("k")["v"].transform(lambda s: s.ewm(alpha=alpha).mean() if alpha < 1 else s.ffill())
    for _, r in p.iterrows():
        x = got[(r.k, r.t, r.id)]["e"]
        assert x is None if math.isnan(r.e) else x == pytest.approx(r.e, rel=1e-11), (r.k, r.t)


@pytest.mark.parametrize("chunk, adaptive", [(None, True), (2, True), (2, False)])
def test_null_keys_and_null_order(spark, chunk, adaptive):
    rows = [(None, None, 1, 1.0), (None, 2, 2, 2.0), (None, 1, 3, 3.0), (None, None, 4, 4.0), (None, 3, 5, 5.0), ("a", None, 6, 6.0), ("a", 1, 7, 7.0)]
    out = S.sequence_features(_frame(spark, rows), "k", ["t", "id"], {"rn": ("row_number",), "prev": ("lag", "v", 1), "run": ("running_sum", "v")}, chunk, adaptive)
    assert {r.id: (r.rn, r.prev, r.run) for r in out.collect()} == {
        3: (1, None, 3.0), 2: (2, 3.0, 5.0), 5: (3, 2.0, 10.0), 1: (4, 5.0, 11.0), 4: (5, 1.0, 15.0), 7: (1, None, 7.0), 6: (2, 7.0, 13.0)}


def test_only_large_keys_are_cut(spark):
    df = _frame(spark, [("hot", i, i, 1.0) for i in range(50)] + [(f"k{i}", 0, i, 1.0) for i in range(20)])
    hot = S.large_keys(df, ["k"], 10)
    assert [r.k for r in hot.collect()] == ["hot"]


def test_positions_exact(spark):
    rows = [("x", i % 7, i, 0.0) for i in range(50)] + [("y", 0, 100, 0.0)]
    p = S.positions(_frame(spark, rows), ["k"], ["t", "id"]).collect()
    by = {}
    for r in p:
        by.setdefault(r.k, []).append(((r.t, r.id), r._pos))
    for k, lst in by.items():
        lst.sort()
        assert [pos for _, pos in lst] == list(range(1, len(lst) + 1))


def test_first_last_k(spark):
    rows = [("a", t, t, float(t)) for t in range(1, 8)]
    out = S.first_last_k(_frame(spark, rows), "k", ["t", "id"], first_k=2, last_k=3).collect()
    first = sorted(r.t for r in out if r._first)
    last = sorted(r.t for r in out if r._last)
    assert first == [1, 2] and last == [5, 6, 7]


def test_neighbours(spark):
    rows = [(1, "a", 10.0, 1), (2, "a", 5.0, 0), (3, "a", 7.0, 1), (4, "b", 1.0, 0)]
    df = spark.createDataFrame(rows, "id int, g string, age double, y int")
    cl = S.lookalike_clusters(df, ["g"], "id")
    for chunk in (None, 2):
        r = {x.id: (x.prev_label, x.next_label) for x in
             S.neighbour_labels(cl, "cluster", ["age", "id"], "y", chunk_rows=chunk, adaptive=False).collect()}
        assert r == {2: (None, 1), 3: (0, 1), 1: (1, None), 4: (None, None)}


def test_clusters_are_numbered_by_size(spark):
    df = spark.createDataFrame([(i, "big") for i in range(5)] + [(i, "small") for i in range(5, 7)] + [(i, "also") for i in range(7, 9)] + [(9, "one"), (10, None), (11, None), (12, None)],
                               "id int, g string")
    got = {(r.g, r.cluster, r.cluster_size) for r in S.lookalike_clusters(df, ["g"], "id").collect()}
    assert got == {("big", 1, 5), (None, 2, 3), ("also", 3, 2), ("small", 4, 2), ("one", None, None)}
