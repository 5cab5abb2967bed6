"""Pairwise-complete sums of all column pairs in one pass.

Correlations over the rows where both columns are known need, for every pair, the number of such rows, the
sums and square sums of either column over them, and the sum of products. Written as expressions that is several
aggregates a pair, a plan that grows with the square of the columns. Here a task keeps five square matrices and
adds, per Arrow batch, products of the value matrix (0 where a value is missing) and the presence matrix;
tasks hand on one row of vectors per column, which Spark's vector summarizer adds up. Values are taken relative to
the mean of the column's first rows, so that the differences of sums keep their digits beside a large offset.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks, and with them copies of the matrices, at most; beyond it a task reads several splits.
MAX_TASKS = 4_096
FIRST_ROWS = 1_000
_PARTS = ("n", "s", "t", "q", "r", "p")


def pair_sums(df: DataFrame, cols: Sequence[str], max_tasks: int = MAX_TASKS) -> DataFrame:
    """(ia, n, s, t, q, r, p): for each column its vectors over all columns j of the rows where both are known: their number, the
    sum of the column, of j, of the column's squares, of j's, of the products; all relative to a typical value. NaN is missing."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    p = len(cols)
    known = [F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in cols]
    x = df.select(*[k.alias(f"x{i}") for i, k in enumerate(known)])
    mean = F.array(*[F.avg(f"x{i}") for i in range(p)])
    shift = x.limit(FIRST_ROWS).agg(mean.alias("m")).first()["m"]          # one row; any value of the right size does
    if None in shift:
        shift = x.agg(mean.alias("m")).first()["m"]                         # a column that begins with NULLs
    shift = np.array([v if v is not None and np.isfinite(v) else 0.0 for v in shift])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(_PARTS), p, p))
        for b in batches:
            if not b.num_rows:
                continue
            v = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns], axis=1) - shift
            here = ~np.isnan(v)
            v = np.where(here, v, 0.0)
            m, sq = here.astype(float), v * v
            s, q = v.T @ m, sq.T @ m
            for k, add in enumerate((m.T @ m, s, s.T, q, q.T, v.T @ v)):
                out[k] += add
        yield pa.record_batch([pa.array(np.arange(p, dtype=np.int32)), pa.FixedSizeListArray.from_arrays(
            pa.array(out.transpose(1, 0, 2).ravel()), len(_PARTS) * p).cast(pa.list_(pa.float64()))], names=["ia", "v"])

    parts = x.coalesce(max_tasks).mapInArrow(run, "ia int, v array<double>")
    total = parts.groupBy("ia").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    return total.select("ia", *[F.slice("v", k * p + 1, p).alias(name) for k, name in enumerate(_PARTS)])


def correlations(df: DataFrame, cols: Sequence[str], max_tasks: int = MAX_TASKS) -> DataFrame:
    """(a, b, ia, ib, corr) for every pair, a before b; NULL where a column does not vary over the pair's rows."""
    cols = list(cols)
    g = pair_sums(df, cols, max_tasks)
    each = F.arrays_zip(*[F.col(k) for k in _PARTS])
    row = g.select("ia", F.posexplode(each).alias("ib", "e")).where("ib > ia").select("ia", "ib", "e.*")
    n = F.col("n")
    va, vb = (F.col(q) - F.col(s) * F.col(s) / n for q, s in (("q", "s"), ("r", "t")))
    # a spread that is rounding noise beside the squares it is the difference of counts as none
    flat = (n < 1) | (va <= F.col("q") * 1e-14) | (vb <= F.col("r") * 1e-14)
    corr = (F.col("p") - F.col("s") * F.col("t") / n) / F.sqrt(va * vb)
    names = F.array(*[F.lit(c) for c in cols])
    return row.select(names[F.col("ia")].alias("a"), names[F.col("ib")].alias("b"), "ia", "ib", F.when(~flat, corr).alias("corr"))
