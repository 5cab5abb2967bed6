"""Feature selection as aggregate queries over columns.

Each selector makes ONE pass over the data for all candidate columns (never a loop of
per-column jobs) and returns a small (feature, stat, keep) DataFrame; ``apply_selection``
drops the rejected columns lazily.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featmart.operators.encode import unpivot_values


def _table(spark, rows, stat_name: str = "stat"):
    return spark.createDataFrame(rows, f"feature string, {stat_name} double, keep boolean")


def _stat_table(agg_row_df: DataFrame, cols: Sequence[str], keep_expr) -> DataFrame:
    """Turn a one-row aggregate (one column per feature, same order as ``cols``) into a long
    (feature, stat, keep) table without leaving Spark."""
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"s{i}").cast("double").alias("stat"))
                    for i, c in enumerate(cols)])
    t = agg_row_df.select(F.explode(arr).alias("x")).select("x.feature", "x.stat")
    return t.withColumn("keep", keep_expr(F.col("stat")))


def missing_share(df: DataFrame, threshold: float, cols: Sequence[str] | None = None) -> DataFrame:
    """Q1: share of NULL per column; keep when share <= threshold."""
    cols = list(cols or df.columns)
    a = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(f"s{i}") for i, c in enumerate(cols)])
    return _stat_table(a, cols, lambda s: s <= F.lit(threshold))


def numeric_variance(df: DataFrame, threshold: float, cols: Sequence[str]) -> DataFrame:
    """Q3: sample variance per numeric column; keep when variance >= threshold."""
    a = df.agg(*[F.var_samp(F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(cols)])
    return _stat_table(a, cols, lambda s: F.coalesce(s >= F.lit(threshold), F.lit(False)))


def frequency_variance(df: DataFrame, threshold: float, cols: Sequence[str], keep_above: bool = False) -> DataFrame:
    """Q2 / Q5: variance (ddof=1) of the relative frequencies of a column's values (NULL not
    counted).  Q2 drops columns with variance < threshold; Q5 keeps those with variance >
    threshold (``keep_above``).  One unpivot + one (feature, value) count pass, so every distinct value is
    shuffled; ``select_by_frequency`` decides most columns without."""
    u = unpivot_values(df.select(*cols), cols).filter(F.col("value").isNotNull())
    cnt = u.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    tot = cnt.groupBy("feature").agg(F.sum("n").alias("t"))
    freq = cnt.join(tot, "feature").withColumn("f", F.col("n") / F.col("t"))
    v = freq.groupBy("feature").agg(F.var_samp("f").alias("stat"))
    keep = (F.col("stat") > F.lit(threshold)) if keep_above else (F.col("stat") >= F.lit(threshold))
    return v.withColumn("keep", F.coalesce(keep, F.lit(False)))


def select_by_frequency(df: DataFrame, threshold: float, cols: Sequence[str], keep_above: bool = False) -> DataFrame:
    """Q2 / Q5 at scale: (feature, low, high, exact, keep). A sketch of second frequency moments and of distinct
    counts bounds each column's variance of relative frequencies (``frequency``); a column whose bounds lie on one
    side of the threshold is decided, the others are counted exactly, and their bounds are that value."""
    from featmart.operators.frequency import variance_bounds
    found = variance_bounds(df, cols)                        # a row per column
    over = (lambda v: v > threshold) if keep_above else (lambda v: v >= threshold)
    near = [c for c, (lo, hi) in found.items() if lo is not None and over(lo) != over(hi)]
    exact = {r["feature"]: r["stat"] for r in frequency_variance(df, threshold, near, keep_above).collect()} if near else {}      # a row per column
    rows = []
    for c, (lo, hi) in found.items():
        if c in exact:
            lo = hi = exact[c]
        rows.append((c, lo, hi, c in exact, lo is not None and over(lo)))
    return df.sparkSession.createDataFrame(rows, "feature string, low double, high double, exact boolean, keep boolean")


def constant_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Q6: columns with at most one distinct non-NULL value are dropped; ``min < max`` in one
    pass is cheaper than counting distinct values.  stat = 1 if the column varies."""
    cols = list(cols or df.columns)
    a = df.agg(*[(F.min(F.col(f"`{c}`")) < F.max(F.col(f"`{c}`"))).cast("double").alias(f"s{i}")
                 for i, c in enumerate(cols)])
    return _stat_table(a, cols, lambda s: F.coalesce(s == 1.0, F.lit(False)))


def correlation_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair (pairwise-complete rows, as pandas ``corr``) from the pair sums of one
    pass (``gram``); long form (a, b, ia, ib, corr) with a before b in column order; NULL for a constant column."""
    from featmart.operators.gram import correlations
    return correlations(df, cols)


def correlated(df: DataFrame, cols: Sequence[str], threshold: float) -> DataFrame:
    """Q4: drop the later column of any pair with |corr| > threshold.  stat = max |corr| with an
    earlier column."""
    long = correlation_long(df, cols)
    worst = long.groupBy(F.col("b").alias("feature")).agg(F.max(F.abs("corr")).alias("stat"))
    base = df.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    t = base.join(worst, "feature", "left")
    return t.withColumn("keep", ~F.coalesce(F.col("stat") > F.lit(threshold), F.lit(False)))


def information_value(bin_table: DataFrame, threshold: float = 0.02) -> DataFrame:
    """Q7: IV per feature = sum of the per-bin IV of a fitted bin table; keep IV >= threshold."""
    return (bin_table.groupBy("feature").agg(F.sum("iv").alias("stat"))
            .withColumn("keep", F.col("stat") >= F.lit(threshold)))


def _assemble(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    va = VectorAssembler(inputCols=list(cols), outputCol="_features", handleInvalid="keep")
    return va.transform(df.select(*cols, F.col(label).cast("double").alias("_label")).fillna(0.0, subset=list(cols)))


def forest_importance(df: DataFrame, cols: Sequence[str], label: str, threshold: float = 0.001,
                      trees: int = 100, seed: int = 0) -> DataFrame:
    """Q8: random-forest importances (Spark ML, distributed training); keep >= threshold."""
    imp = fitted_forest(df, cols, label, trees, seed).featureImportances.toArray()
    return _table(df.sparkSession, [(c, float(imp[i]), bool(imp[i] >= threshold)) for i, c in enumerate(cols)])


def boosting_importance(df: DataFrame, cols: Sequence[str], label: str, threshold: float = 0.005,
                        scale: str = "max", iters: int = 50, seed: int = 0, rank_by: str = "n_splits") -> DataFrame:
    """Q9: gradient-boosted-tree importances, scaled by the maximum ('max') or divided by 10 ('tenth'); keep
    >= threshold. ``rank_by``: 'n_splits' (how often a column splits), 'gain' or 'cover', from the node table."""
    from featmart.operators import trees as TR
    stats = TR.split_statistics(TR.stored_nodes(fitted_boosting(df, cols, label, iters, seed))[0], cols)
    vals = {r["feature"]: float(r[rank_by]) for r in stats.collect()}          # a row per column
    mx = max(vals.values(), default=0.0) or 1.0
    div = mx if scale == "max" else 10.0
    return _table(df.sparkSession, [(c, vals[c] / div, bool(vals[c] / div >= threshold)) for c in cols])


def fitted_forest(df: DataFrame, cols: Sequence[str], label: str, trees: int = 100, seed: int = 0):
    from pyspark.ml.classification import RandomForestClassifier
    data = _assemble(df.filter(F.col(label).isNotNull()), cols, label)
    return RandomForestClassifier(featuresCol="_features", labelCol="_label", numTrees=trees, seed=seed).fit(data)


def fitted_boosting(df: DataFrame, cols: Sequence[str], label: str, iters: int = 50, seed: int = 0):
    from pyspark.ml.classification import GBTClassifier
    data = _assemble(df.filter(F.col(label).isNotNull()), cols, label)
    return GBTClassifier(featuresCol="_features", labelCol="_label", maxIter=iters, seed=seed).fit(data)


def apply_selection(df: DataFrame, table: DataFrame, always_keep: Sequence[str] = ()) -> DataFrame:
    """Drop the columns a selector rejected (the table is tiny: one row per feature)."""
    from featmart.operators.joins import collect_bounded
    drop = [r["feature"] for r in collect_bounded(table.filter(~F.col("keep")).select("feature"), len(df.columns),
                                                  "selector table")]
    return df.drop(*[c for c in drop if c not in always_keep])
