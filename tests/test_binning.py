"""The optimal partition of pre-bins against exhaustive enumeration."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from featmart.operators import binning as B
from featmart.operators import encode as EN


def partitions(n):
    for k in range(n):
        for cuts in itertools.combinations(range(1, n), k):
            yield [*cuts, n]


def follows(rates, trend):
    d = np.diff(rates)
    up, down = (d >= 0), (d <= 0)
    turn = lambda a, b: any(a[:i].all() and b[i:].all() for i in range(len(d) + 1))
    return {"rising": up.all(), "falling": down.all(), "monotone": up.all() or down.all(), "peak": turn(up, down), "valley": turn(down, up),
            "any_turn": turn(up, down) or turn(down, up)}[trend]


def brute(count, events, min_share, max_bins, trend):
    best = None
    for ends in partitions(len(count)):
        starts = [0, *ends[:-1]]
        c, e = np.add.reduceat(count, starts), np.add.reduceat(events, starts)
        if len(ends) > (max_bins or len(count)) or (c < min_share * count.sum()).any() or (c == 0).any() or not follows(e / c, trend):
            continue
        v = B.bin_values(c, e, len(ends), (events.sum(), (count - events).sum()), 0.5)[1].sum()
        if best is None or v > best[0] + B.SAME or (abs(v - best[0]) <= B.SAME and (len(ends), ends) < (len(best[1]), best[1])):
            best = (v, ends)
    return best


@pytest.mark.parametrize("trend", B.TRENDS)
def test_best_partition_is_the_best_of_all(trend):
    rng = np.random.default_rng(len(trend))
    for k in range(40):
        n = int(rng.integers(1, 10))
        count = rng.integers(0 if k % 4 == 0 else 1, 60, n).astype(float)
        if not count.sum():
            continue
        events = np.floor(count * rng.uniform(0, 1, n) if k % 3 else count * 0.5)
        share, most = float(rng.choice([0.0, 0.05, 0.2])), [None, 2, 4][k % 3]
        want = brute(count, events, share, most, trend)
        got = B.best_partition(count, events, share, most, trend)
        starts = [0, *got[:-1]]
        c, e = np.add.reduceat(count, starts), np.add.reduceat(events, starts)
        v = B.bin_values(c, e, len(got), (events.sum(), (count - events).sum()), 0.5)[1].sum()
        assert v == pytest.approx(want[0], abs=1e-9)
        if (count > 0).all():
            assert got == want[1]


def greedy(count, events, min_share):
    """Merging neighbours with the least loss until the bins are large enough and monotone: what the search replaces."""
    c, e = list(count), list(events)
    total = (sum(e), sum(c) - sum(e))
    iv = lambda a, b: B.bin_values(np.array(a), np.array(b), len(c), total, 0.5)[1]
    while len(c) > 1 and (min(c) < min_share * sum(c) or not follows(np.array(e) / np.array(c), "monotone")):
        i = min(range(len(c) - 1), key=lambda i: iv(c[i], e[i]) + iv(c[i + 1], e[i + 1]) - iv(c[i] + c[i + 1], e[i] + e[i + 1]))
        c[i:i + 2], e[i:i + 2] = [c[i] + c[i + 1]], [e[i] + e[i + 1]]
    return iv(c, e).sum()


def test_never_below_the_greedy_one():
    rng = np.random.default_rng(1)
    better = 0
    for _ in range(60):
        count = rng.integers(20, 60, 20).astype(float)
        events = np.floor(count * np.clip(np.linspace(0.1, 0.5, 20) + rng.normal(0, 0.1, 20), 0, 1))
        ends = B.best_partition(count, events, 0.05)
        starts = [0, *ends[:-1]]
        v = B.bin_values(np.add.reduceat(count, starts), np.add.reduceat(events, starts), len(ends), (events.sum(), (count - events).sum()), 0.5)[1].sum()
        g = greedy(count, events, 0.05)
        assert v >= g - 1e-12
        better += v > g + 1e-9
    assert better > 10


def test_labels_of_one_kind_and_unknown_trend():
    assert B.best_partition([10, 10, 10], [0, 0, 0]) == brute(np.full(3, 10.0), np.zeros(3), 0.05, None, "monotone")[1]
    assert B.best_partition([5], [2]) == [1]
    with pytest.raises(ValueError, match="trend"):
        B.best_partition([1, 2], [0, 1], trend="up")


def test_trends_over_a_table(spark):
    df = spark.range(6_000).select((F.col("id") % 100).cast("double").alias("x"), F.col("id"))
    df = df.select("x", (F.pmod(F.xxhash64("id"), F.lit(100)) < F.when((F.col("x") > 30) & (F.col("x") < 60), 70).otherwise(10)).cast("int").alias("y"))
    iv = {t: EN.optimal_bins(df, "y", ["x"], trend=t).table.agg(F.sum("iv")).first()[0] for t in ("monotone", "peak", "valley")}
    assert iv["peak"] > 2 * iv["monotone"] and iv["peak"] > iv["valley"] >= iv["monotone"] - 1e-9
    assert EN.optimal_bins(df, "y", ["x"], max_bins=2, trend="peak").table.count() <= 2
