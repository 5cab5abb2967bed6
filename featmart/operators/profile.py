"""Data profiles: the tables behind exploratory charts.

All profiles are single aggregate passes (unpivot + group-by where a per-column table is
needed); the results are small tables, charts are left to the caller.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featmart.operators.encode import unpivot_values

QUARTILES = [0.25, 0.5, 0.75]


def missing_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n_missing, pct_missing) for columns with at least one NULL."""
    cols = list(cols or df.columns)
    a = df.agg(F.count(F.lit(1)).alias("_n"),
               *[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"m{i}") for i, c in enumerate(cols)])
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("n_missing")) for i, c in enumerate(cols)])
    t = a.select("_n", F.explode(arr).alias("x")).select("x.column", "x.n_missing", "_n")
    return (t.filter(F.col("n_missing") > 0)
            .select("column", "n_missing", (F.col("n_missing") * 100.0 / F.col("_n")).alias("pct_missing")))


def describe(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """Count, mean, std (ddof=1), min, quartiles (linear interpolation), max per column.
    Quartiles come from rank brackets (a column is one huge group)."""
    from featmart.operators.quantile import few_group_percentiles
    u = unpivot_values(df.select(*cols), cols, as_string=False)
    m = u.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    q = few_group_percentiles(u, ["feature"], "value", QUARTILES, exact, names=["p25", "p50", "p75"])
    return m.join(q, "feature", "left").select("feature", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def schema_listing(df: DataFrame) -> DataFrame:
    """(column, type, non_null) with the non-NULL counts from one aggregate."""
    cols = df.columns
    a = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(cols)])
    types = dict(df.dtypes)
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("type"), F.col(f"n{i}").alias("non_null"))
                    for i, c in enumerate(cols)])
    return a.select(F.explode(arr).alias("x")).select("x.*")


def counts_by_label(df: DataFrame, cat: str, label: str) -> DataFrame:
    """Counts per (category, label) with the share of each label inside the category."""
    c = df.groupBy(cat, label).agg(F.count(F.lit(1)).alias("n"))
    tot = c.groupBy(cat).agg(F.sum("n").alias("_t"))
    return c.join(tot, cat).select(cat, label, "n", (F.col("n") / F.col("_t")).alias("share_in_category"))


def label_share_wide(df: DataFrame, cat: str, label: str, labels: Sequence = (0, 1)) -> DataFrame:
    """X5 unstacked: one row per category, one share column per label value (shares within the
    category).  The label values are given, so the pivot needs no distinct pre-pass."""
    lab = df.filter(F.col(label).isNotNull())
    wide = lab.groupBy(cat).pivot(label, list(labels)).agg(F.count(F.lit(1)))
    tot = sum((F.coalesce(F.col(f"`{v}`"), F.lit(0)) for v in labels), F.lit(0))
    return wide.select(cat, *[(F.coalesce(F.col(f"`{v}`"), F.lit(0)) / tot).alias(f"share_{v}") for v in labels],
                       tot.alias("n"))


def rate_by_category(df: DataFrame, cat: str, label: str) -> DataFrame:
    """Percent of positive labels per category (labelled rows only) and the row count."""
    lab = df.filter(F.col(label).isNotNull())
    return lab.groupBy(cat).agg(F.count(F.lit(1)).alias("n"), (F.avg(label) * 100.0).alias("rate_pct"))


def conditional_rate(df: DataFrame, label: str, cond, positive: bool = True):
    """Share of rows with label == 1 (or 0) among rows meeting ``cond`` (a Column)."""
    target = F.lit(1) if positive else F.lit(0)
    sub = df.filter(cond & F.col(label).isNotNull())
    return sub.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(label) == target).cast("double")).alias("rate"))


def quantiles_by_label(df: DataFrame, col: str, label: str,
                       probs: Sequence[float] = (0.5, 0.75, 0.9, 0.95, 0.99), exact: bool = True) -> DataFrame:
    """Quantiles (linear interpolation) of ``col`` per label class; a class is a huge group,
    so ranks are bracketed first."""
    from featmart.operators.quantile import few_group_percentiles
    names = [f"q{int(round(p * 100))}" for p in probs]
    return few_group_percentiles(df.filter(F.col(label).isNotNull()), [label], col, probs, exact, names=names)


def five_numbers(df: DataFrame, col: str, label: str, exact: bool = True) -> DataFrame:
    """Min, quartiles, max and the 1.5 IQR fences per label class."""
    from featmart.operators.quantile import few_group_percentiles
    lab = df.filter(F.col(label).isNotNull())
    mm = lab.groupBy(label).agg(F.min(col).alias("min"), F.max(col).alias("max"))
    q = few_group_percentiles(lab, [label], col, QUARTILES, exact, names=["q1", "median", "q3"])
    g = mm.join(q, label)
    q1, q3 = F.col("q1"), F.col("q3")
    return g.select(label, "min", "q1", "median", "q3", "max",
                    (q1 - (q3 - q1) * 1.5).alias("fence_low"), (q3 + (q3 - q1) * 1.5).alias("fence_high"))


def histogram(df: DataFrame, col: str, bins: int | None = None, by: str | None = None,
              lo: float | None = None, hi: float | None = None, density: bool = False) -> DataFrame:
    """Equal-width histogram between the smallest and largest value, the last bin closed,
    optionally split by a label. ``bins=None`` takes int(1 + log2 of the rows of ``df``). Only values
    strictly between ``lo`` and ``hi`` count, where given. ``density`` normalises each class to
    integrate to one."""
    x = F.col(col).cast("double")
    d = df.filter(x.isNotNull())
    if lo is not None:
        d = d.filter(x > F.lit(lo))
    if hi is not None:
        d = d.filter(x < F.lit(hi))
    if bins is None:
        bins = int(1 + math.log2(max(1, df.count())))
    mm = d.agg(F.min(x).alias("a"), F.max(x).alias("b")).first()
    a, b = mm["a"], mm["b"]
    if a is None:
        a = b = 0.0
    width = (b - a) / bins if b > a else 1.0
    idx = F.least(F.floor((x - F.lit(a)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    keys = [by] if by else []
    h = d.groupBy(*keys, idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    h = h.select(*keys, "bin", (F.lit(a) + F.col("bin") * F.lit(width)).alias("left"),
                 (F.lit(a) + (F.col("bin") + 1) * F.lit(width)).alias("right"), "n")
    if density:
        w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        h = h.withColumn("density", F.col("n") / (F.sum("n").over(w) * F.lit(width)))
    return h


DENSITY_POINTS = 200
DENSITY_CUT = 3.0


def density_curve(df: DataFrame, col: str, by: str, points: int = DENSITY_POINTS, cut: float = DENSITY_CUT) -> DataFrame:
    """X11: Gaussian kernel density of ``col`` per class of ``by`` on a common grid of ``points`` (by, i, x, density).

    The bandwidth is Scott's rule per class, n^(-1/5) times the sample deviation; the grid runs ``cut`` of the largest
    bandwidths beyond the data. Linear binning: a row adds to its two neighbouring grid points by its nearness, a
    map-side count of at most ``points`` rows a class; the kernel is then summed over the grid, not over the rows. A class
    without spread or with one row has no curve; NULL classes and values take no part."""
    x = F.col(col).cast("double")
    d = df.filter(x.isNotNull() & ~F.isnan(x) & F.col(by).isNotNull()).select(F.col(by).alias("_by"), x.alias("_x"))
    per = d.groupBy("_by").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("_x").alias("sd"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    per = per.filter("sd > 0").withColumn("h", F.pow(F.col("n").cast("double"), F.lit(-0.2)) * F.col("sd"))
    ends = per.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("h").alias("h")).first()             # one row
    if ends["lo"] is None:
        return d.filter("false").select(F.col("_by").alias(by), F.lit(0).alias("i"), F.col("_x").alias("x"), F.col("_x").alias("density"))
    left = ends["lo"] - cut * ends["h"]
    step = (ends["hi"] + cut * ends["h"] - left) / (points - 1)
    at = (F.col("_x") - F.lit(left)) / F.lit(step)
    i = F.least(F.floor(at).cast("int"), F.lit(points - 2))
    two = F.array(F.struct(i.alias("j"), (1 - (at - i)).alias("w")), F.struct((i + 1).alias("j"), (at - i).alias("w")))
    grid = d.select("_by", F.explode(two).alias("g")).groupBy("_by", "g.j").agg(F.sum("g.w").alias("w"))
    held = grid.groupBy("_by").agg(F.collect_list(F.struct("j", "w")).alias("g"))                                 # at most ``points`` a class
    curve = held.join(per.select("_by", "n", "h"), "_by").select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    z = F.lit(step) / F.col("h")
    total = F.aggregate("g", F.lit(0.0), lambda a, e: a + e["w"] * F.exp(-0.5 * F.pow((F.col("i") - e["j"]) * z, F.lit(2))))
    return curve.select(F.col("_by").alias(by), "i", (F.lit(left) + F.col("i") * F.lit(step)).alias("x"),
                        (total / (F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi)))).alias("density"))


def distinct_per_entity(df: DataFrame, entity: str, label: str, attr: str) -> DataFrame:
    """Distinct count (and max) of an attribute per (entity, label), then its distribution
    per label: two group-bys."""
    per = df.groupBy(entity, label).agg(F.countDistinct(attr).alias("n_distinct"))
    return per.groupBy(label, "n_distinct").agg(F.count(F.lit(1)).alias("n_entities"))
