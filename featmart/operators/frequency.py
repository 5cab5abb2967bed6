"""Bounds for the variance of a column's relative frequencies from a sketch (Q2, Q5).

With k distinct values of counts c and n rows, the variance (ddof 1) of c / n is (F2 / n^2 - 1 / k) / (k - 1), F2 being
the second frequency moment, the sum of c^2. Two mergeable sketches of all columns come out of one pass over 64-bit
hashes of the values: a count sketch (``DEPTH`` rows of ``WIDTH`` signed counters; the median of the rows' square sums
estimates F2), and the ``SMALLEST`` smallest hashes (they give k; exactly while there are fewer). Tasks keep both per
column and hand on their sums and minima, so nothing grows with the number of distinct values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 5
WIDTH = 1 << 10
SMALLEST = 1 << 10
#: Tasks, and with them copies of the sketches, at most; beyond it a task reads several splits.
MAX_TASKS = 4_096
#: Standard errors that the bounds lie off the estimates.
ERRORS = 5.0
_TOP = float(2 ** 63)


def _mixed(h: np.ndarray, j: int) -> np.ndarray:
    """Another 64-bit hash of 64-bit hashes."""
    x = h + np.uint64((0x9E3779B97F4A7C15 * (j + 1)) % 2 ** 64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def sketch(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, n, counters array, smallest hashes) per column and task."""
    p = len(cols)
    hashes = df.select(*[F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(F.col(f"`{c}`").cast("string"))).alias(f"h{i}") for i, c in enumerate(cols)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, n = np.zeros((p, DEPTH, WIDTH)), np.zeros(p, np.int64)
        least = [np.empty(0, np.int64) for _ in range(p)]
        for b in batches:
            for i, c in enumerate(b.columns):
                h = c.drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                if not len(h):
                    continue
                n[i] += len(h)
                v, k = np.unique(h, return_counts=True)
                for j in range(DEPTH):
                    m = _mixed(v, j)
                    counters[i, j] += np.bincount((m >> np.uint64(1)) % np.uint64(WIDTH), np.where(m & np.uint64(1), k, -k), WIDTH)
                least[i] = np.union1d(least[i], (_mixed(v, DEPTH) >> np.uint64(1)).astype(np.int64))[:SMALLEST]
        yield pa.record_batch([pa.array(np.arange(p, dtype=np.int32)), pa.array(n), pa.FixedSizeListArray.from_arrays(
            pa.array(counters.ravel()), DEPTH * WIDTH).cast(pa.list_(pa.float64())), pa.array([x.tolist() for x in least], pa.list_(pa.int64()))],
            names=["i", "n", "c", "least"])

    return hashes.coalesce(MAX_TASKS).mapInArrow(run, "i int, n long, c array<double>, least array<long>")


def variance_bounds(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    """Column -> (low, high) around the variance of its relative frequencies; None with fewer than two distinct values.
    One job; what reaches the driver is a few numbers per column."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    parts = sketch(df, cols)
    merged = parts.groupBy("i").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("c"))).alias("c"),
                                    F.array_sort(F.array_distinct(F.flatten(F.collect_list("least")))).alias("least"))       # SMALLEST a task
    square = [F.aggregate(F.slice("c", j * WIDTH + 1, WIDTH), F.lit(0.0), lambda a, x: a + x * x) for j in range(DEPTH)]
    got = merged.select("i", "n", F.array(*square).alias("f2"), F.least(F.size("least"), F.lit(SMALLEST)).alias("held"),
                        F.when(F.size("least") >= SMALLEST, F.col("least")[SMALLEST - 1].cast("double")).alias("last")).collect()
    out: dict[str, tuple[float | None, float | None]] = {}
    for r in got:
        c, n = cols[r["i"]], r["n"]
        k_lo = k_hi = float(r["held"])
        if r["last"] is not None:
            k = (SMALLEST - 1) * _TOP / r["last"]
            k_lo, k_hi = k / (1 + ERRORS / SMALLEST ** 0.5), min(k / (1 - ERRORS / SMALLEST ** 0.5), float(n))
        if k_hi < 2:
            out[c] = (None, None)
            continue
        f2 = float(np.median(r["f2"]))
        off = ERRORS * (2.0 / WIDTH) ** 0.5
        # no count sketch knows F2 to nothing: it is at least n, and n^2 / k
        lo2, hi2 = max(f2 / (1 + off), float(n), n * n / k_hi), min(f2 / max(1 - off, 1e-9), float(n) * n)
        each = [(max(f / (n * n) - 1 / k, 0.0)) / (k - 1) for f in (lo2, max(hi2, lo2)) for k in (max(k_lo, 2.0), k_hi)]
        out[c] = (min(each), max(each))
    return out
