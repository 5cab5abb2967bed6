"""Exact percentiles without holding a group in one task and without sorting detail rows.

Many groups (``percentiles``): Spark's exact ``percentile`` / ``median`` aggregate keeps every distinct value of a group in one
buffer. Here equal values are counted first (map-side), so a hot value is one row; the cumulative
counts over the distinct values of a group come from ``seq.sequence_features``, which cuts large
groups into blocks; and only the distinct values that hold a wanted rank are kept. The interpolation
``lo + (hi - lo) * frac`` (linear, as ``quantile_cont`` / pandas) is a small group-by.
``exact=False`` uses the fixed-size ``percentile_approx`` sketch (one pass, no sort).

Few groups of any size, such as the columns of a table (``bracketed_percentiles``): a mergeable quantile sketch
per group gives each wanted rank a bracket of two values in one pass. A second pass counts, map-side, what lies
below, on and between the bounds, and keeps values only strictly inside a bracket, so that a fraction of the rows
is shuffled and neither all rows nor all distinct values are sorted. A hot value is a bound or one row. Should a
rank lie outside its bracket, beyond the sketch's error, the group form takes over: the result is exact always. So it
does for more than ``BRACKET_GROUPS`` groups, whose brackets would be too many to broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featmart.operators.seq import sequence_features
from featmart.session import cut_lineage

APPROX_ACCURACY = 100_000
BRACKET_ACCURACY = 10_000      # the sketch's rank error is at most rows / BRACKET_ACCURACY
BRACKET_GROUPS = 10_000        # a row of about a kilobyte each is broadcast
RANK_CHUNK_ROWS = 1_000_000


def percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                exact: bool = True, names: Sequence[str] | None = None,
                chunk_rows: int = RANK_CHUNK_ROWS, adaptive: bool = True, largest: int | None = None) -> DataFrame:
    """One row per key with a column per probability (default names ``p0``, ``p1``, ...).
    NULL values are ignored; a key whose values are all NULL does not appear; a NULL key is a group
    like any other. ``adaptive=False`` cuts every group into blocks (for tests); ``largest``: the rows of the largest key,
    if they are known."""
    keys = list(keys)
    names = list(names or [f"p{i}" for i in range(len(probs))])
    d = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    if not exact:
        g = d.groupBy(*keys).agg(F.percentile_approx("_v", list(probs), APPROX_ACCURACY).alias("_q"))
        return g.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    kk = keys or ["_all"]
    if not keys:
        d = d.withColumn("_all", F.lit(0))
    c = d.groupBy(*kk, "_v").agg(F.count(F.lit(1)).alias("_c"))
    p = sequence_features(c, kk, ["_v"], {"_cum": ("running_sum", "_c"), "_n": ("key_sum", "_c")}, chunk_rows, adaptive,
                          sizes=d.select(*kk), largest=largest)
    # written as SQL text: one parse per expression instead of dozens of py4j round trips
    out = _picked(p, kk, probs, names)
    return out.drop("_all") if not keys else out


def _picked(p: DataFrame, keys: Sequence[str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Interpolated percentiles from rows (keys, _v, _c, _cum, _n): a value, its count, the cumulative count, the total."""
    want, cols, outs = [], [], []
    for i, q in enumerate(probs):
        h = f"((_n - 1) * CAST({float(q)!r} AS DOUBLE))"
        lo, hi = f"(floor({h}) + 1)", f"(ceil({h}) + 1)"            # 1-based ranks
        has = [f"({r} > _cum - _c AND {r} <= _cum)" for r in (lo, hi)]
        want += has
        cols += [F.expr(f"max(CASE WHEN {has[0]} THEN _v END)").alias(f"_a{i}"),
                 F.expr(f"max(CASE WHEN {has[1]} THEN _v END)").alias(f"_b{i}"),
                 F.expr(f"first({h} - floor({h}))").alias(f"_f{i}")]
        outs.append(F.expr(f"_a{i} + (_b{i} - _a{i}) * _f{i}").alias(names[i]))
    # only the <= 2 distinct values per probability survive the filter: the group-by is tiny
    return p.filter(F.expr(" OR ".join(want))).groupBy(*keys).agg(*cols).select(*keys, *outs)


def bracketed_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                          names: Sequence[str] | None = None, accuracy: int = BRACKET_ACCURACY) -> DataFrame:
    """``percentiles`` for few groups of any size (a sketch per group and task). The passes run when it is called."""
    keys, names = list(keys), list(names or [f"p{i}" for i in range(len(probs))])
    kk = keys or ["_all"]
    d = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    if not keys:
        d = d.withColumn("_all", F.lit(0))
    # a rank's bracket: the values that the sketch holds for two errors below and above it
    asked = [x for q in probs for x in (max(0.0, q - 2.0 / accuracy), min(1.0, q + 2.0 / accuracy))]
    sk = d.groupBy(*kk).agg(F.percentile_approx("_v", asked, accuracy).alias("_s"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
                            F.count(F.lit(1)).alias("_n"))
    bounds = [c for i, q in enumerate(probs) for c in (F.col("_lo") if q <= 2.0 / accuracy else F.col("_s")[2 * i],
                                                        F.col("_hi") if q >= 1 - 2.0 / accuracy else F.col("_s")[2 * i + 1])]
    pairs = F.array(*[F.struct(bounds[2 * i].alias("lo"), bounds[2 * i + 1].alias("hi")) for i in range(len(probs))])
    room = 1 << (len(bounds) - 1).bit_length()           # of the sorted bounds, for the binary search
    sk = sk.select(*kk, F.array_sort(F.array_distinct(F.array(*bounds))).alias("_b"), pairs.alias("_in"))
    between = F.expr(f"""transform(sequence(0, {room}), i -> i > 0 AND i < size(_b)
        AND exists(_in, p -> p.lo <= element_at(_b, i) AND p.hi >= element_at(_b, i + 1)))""") if len(bounds) > 1 else F.array(F.lit(False))
    pad = F.expr(f"slice(concat(_b, array_repeat(CAST(NULL AS DOUBLE), {room})), 1, {room})")
    sk = cut_lineage(sk.select(*kk, pad.alias("_b"), between.alias("_open")))
    if sk.limit(BRACKET_GROUPS + 1).count() > BRACKET_GROUPS:
        return percentiles(df, keys, value, probs, names=names)
    names_of = {k: f"_r_{i}" for i, k in enumerate(kk)}
    cond = F.lit(True)
    for k, n in names_of.items():
        cond = cond & d[k].eqNullSafe(F.col(n))
    # how many bounds lie below the value, by halving; place 2 i + 1 is on bound i, 2 i between the bounds i - 1 and i
    placed = d.join(F.broadcast(sk.withColumnsRenamed(names_of)), cond).withColumn("_i", F.lit(0))
    step = room // 2
    while step:
        placed = placed.withColumn("_i", F.col("_i") + F.when(F.col("_b")[F.col("_i") + (step - 1)] < F.col("_v"), step).otherwise(0))
        step //= 2
    placed = placed.withColumn("_i", F.col("_i") + F.when(F.col("_b")[F.col("_i")] < F.col("_v"), 1).otherwise(0))
    on = F.coalesce(F.when(F.col("_i") < room, F.col("_b")[F.least("_i", F.lit(room - 1))] == F.col("_v")), F.lit(False))
    held = placed.withColumn("_on", on).select(*kk, (F.col("_i") * 2 + F.col("_on").cast("int")).alias("_at"),
                                               F.when(F.col("_on") | F.col("_open")[F.col("_i")], F.col("_v")).alias("_v"))
    c = cut_lineage(held.groupBy(*kk, "_at", "_v").agg(F.count(F.lit(1)).alias("_c")))
    p = sequence_features(c, kk, ["_at", "_v"], {"_cum": ("running_sum", "_c"), "_n": ("key_sum", "_c")}, largest=c.count())
    out = _picked(p, kk, probs, names)
    short = F.lit(False)
    for n in names:
        short = short | F.col(n).isNull()
    if not out.filter(short).isEmpty():
        return percentiles(df, keys, value, probs, names=names)
    return out.drop("_all") if not keys else out


def few_group_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], exact: bool = True,
                          names: Sequence[str] | None = None) -> DataFrame:
    """Percentiles of few large groups: rank brackets, or the sketch alone with ``exact=False``."""
    return bracketed_percentiles(df, keys, value, probs, names) if exact else percentiles(df, keys, value, probs, False, names)


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], exact: bool = True) -> dict:
    """Quantiles of several columns at once: the columns are unpivoted to (place, value), and a column is
    a group.  Returns {column: [q...]}."""
    cols = list(cols)
    # a column goes by its place: grouping by a name costs more
    arr = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(c).cast("double").alias("value")) for i, c in enumerate(cols)])
    u = df.select(F.explode(arr).alias("_kv")).select("_kv.feature", "_kv.value")
    q = few_group_percentiles(u, ["feature"], "value", probs, exact)
    out = {c: [] for c in cols}
    for r in q.collect():                         # one row per column
        out[cols[r["feature"]]] = [r[f"p{i}"] for i in range(len(probs))]
    return out


def median_by(df: DataFrame, keys: Sequence[str], value: str, name: str = "median", exact: bool = True,
              few: bool = False) -> DataFrame:
    """(keys, median) per group, skew-safe (A20); ``few``: the groups are few and large."""
    return (few_group_percentiles if few else percentiles)(df, keys, value, [0.5], exact, names=[name])


def mode_by(df: DataFrame, keys: Sequence[str], value: str, name: str = "mode") -> DataFrame:
    """Most frequent non-NULL value per group, ties -> smallest value, as two aggregations:
    (keys, value) counts first (pre-aggregated map-side), then a fixed-size ``min_by`` per
    group - no group's distinct values are ever held in one buffer."""
    c = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    return c.groupBy(*keys).agg(F.min_by(F.col(value), F.struct((-F.col("_c")).alias("c"), F.col(value).alias("v")))
                                .alias(name))
