"""Encoding and binning fitted from data.

Every ``*_fit`` is one distributed pass. Tables with a row per category level (codes, WoE, risk
groups) stay DataFrames of any length, and applying them is an equi-join (AQE broadcasts a small
table and shuffles beyond). Tables with a row per bin are bounded by features x bins; their edges are
folded into the plan as literal arrays. One-hot as columns needs a driver-side list of levels by nature: pass one, or
let ``one_hot_fit`` collect them up to ``ONE_HOT_COLUMNS``; beyond that, ``one_hot_vector`` makes one sparse vector and
``level_counts`` counts per key, of any number of levels.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featmart.functions.nulls import half_even

ONE_HOT_COLUMNS = 10_000      # width of a schema, not a limit on data
MISSING = "Missing"


# ------------------------------------------------------------------ unpivot helpers

def unpivot_values(df: DataFrame, cols: Sequence[str], extra: Sequence[str] = (), as_string: bool = True) -> DataFrame:
    """(extra..., feature, value) rows for every column in ``cols``: one narrow explode, no
    shuffle.  Values are cast to string (categorical) or double (numeric)."""
    t = "string" if as_string else "double"
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast(t).alias("value")) for c in cols])
    return df.select(*extra, F.explode(arr).alias("_kv")).select(*extra, "_kv.feature", "_kv.value")


# ------------------------------------------------------------------ E1 one-hot

def one_hot_fit(df: DataFrame, cols: Sequence[str] | None = None, max_columns: int = ONE_HOT_COLUMNS) -> dict[str, list]:
    """Levels of every string column (or ``cols``) in one distinct pass over an unpivot."""
    cols = list(cols or [c for c, t in df.dtypes if t == "string"])
    rows = unpivot_values(df, cols).filter(F.col("value").isNotNull()).distinct().limit(max_columns + 1).collect()
    if len(rows) > max_columns:
        raise ValueError(f"one-hot would add more than {max_columns} columns; use one_hot_vector or level_counts, or pass the levels to keep")
    out: dict[str, list] = {c: [] for c in cols}
    for r in rows:
        out[r["feature"]].append(r["value"])
    return {c: sorted(v) for c, v in out.items()}


def one_hot_apply(df: DataFrame, levels: Mapping[str, list], dummy_na: bool = True,
                  drop_source: bool = True) -> tuple[DataFrame, list[str]]:
    """0/1 indicator per level (NULL -> all zeros), optional ``_nan`` indicator; returns the new
    column names.  Unseen levels at apply time -> all zeros."""
    new, exprs = [], []
    for c, vals in levels.items():
        for v in vals:
            name = f"{c}_{v}"
            exprs.append(F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(name))
            new.append(name)
        if dummy_na:
            exprs.append(F.col(c).isNull().cast("int").alias(f"{c}_nan"))
            new.append(f"{c}_nan")
    keep = [F.col(f"`{c}`") for c in df.columns if not (drop_source and c in levels)]
    return df.select(*keep, *exprs), new


def one_hot_index(df: DataFrame, cols: Sequence[str], dummy_na: bool = True) -> DataFrame:
    """(feature, level, index): a place for every level of every column, of any number; with ``dummy_na`` a NULL level
    per column that has NULLs. Places follow the columns' order, then the levels (NULL first)."""
    u = unpivot_values(df, cols)
    levels = (u if dummy_na else u.filter(F.col("value").isNotNull())).distinct()
    at = F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("feature"))
    from featmart.operators.seq import positions
    p = positions(levels.withColumns({"_one": F.lit(0), "_at": at, "_null": F.col("value").isNotNull()}), ["_one"], [F.col("_at").asc(), F.col("_null").asc(), F.col("value").asc()])
    return p.select("feature", F.col("value").alias("level"), (F.col("_pos") - 1).alias("index"))


def one_hot_vector(df: DataFrame, cols: Sequence[str], index: DataFrame, name: str = "one_hot") -> DataFrame:
    """E1 without a column per level: ``name`` is one sparse vector with a 1 at the place of each column's level (none
    for a level that ``index`` lacks). A column's place comes from an equi-join; Spark's encoder makes the vector."""
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler
    from featmart.session import cut_lineage
    spark, index = df.sparkSession, cut_lineage(index)
    spans = {r["feature"]: (r["lo"], r["n"]) for r in index.groupBy("feature").agg(F.min("index").alias("lo"), F.count(F.lit(1)).alias("n")).collect()}     # a row per column
    used = [c for c in cols if c in spans]
    out = df
    for c in used:
        lo, n = spans[c]
        t = index.where(F.col("feature") == c).select(F.col("level").alias(f"_level_{c}"), (F.col("index") - lo).cast("double").alias(f"_at_{c}"))
        out = out.join(F.broadcast(t) if n <= 50_000 else t, out[c].cast("string").eqNullSafe(F.col(f"_level_{c}")), "left").withColumn(f"_at_{c}", F.coalesce(f"_at_{c}", F.lit(float(n)))).drop(f"_level_{c}")
    # the encoder learns each column's number of places from its largest; the place behind them is 'none'
    largest = spark.createDataFrame([tuple(float(spans[c][1] - 1) for c in used)], [f"_at_{c}" for c in used])
    enc = OneHotEncoder(inputCols=[f"_at_{c}" for c in used], outputCols=[f"_hot_{c}" for c in used], handleInvalid="keep", dropLast=True).fit(largest)
    out = VectorAssembler(inputCols=[f"_hot_{c}" for c in used], outputCol=name).transform(enc.transform(out))
    return out.drop(*[f"_at_{c}" for c in used], *[f"_hot_{c}" for c in used])


def level_counts(df: DataFrame, key: str, cols: Sequence[str], dummy_na: bool = True) -> DataFrame:
    """(key, feature, level, n): the sums of the one-hot columns per key that are not zero (E1, A11), counted map-side;
    of any number of levels."""
    u = unpivot_values(df, cols, extra=[key])
    return (u if dummy_na else u.filter(F.col("value").isNotNull())).groupBy(key, "feature", F.col("value").alias("level")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ E2 E3 codes

def _numbered(levels: DataFrame, order: Sequence[Column]) -> DataFrame:
    """(level, code): 0-based position of each level, numbered over range partitions."""
    from featmart.operators.seq import positions
    p = positions(levels.withColumn("_one", F.lit(0)), ["_one"], order)
    return p.select("level", (F.col("_pos") - 1).cast("int").alias("code"))


def sorted_codes_fit(df: DataFrame, col: str) -> DataFrame:
    """(level, code) with levels in sorted order."""
    return _numbered(df.filter(F.col(col).isNotNull()).select(F.col(col).alias("level")).distinct(), [F.col("level").asc()])


def frequency_codes_fit(df: DataFrame, col: str) -> DataFrame:
    """(level, code) with levels by frequency desc, then value asc (Spark has no order of first
    appearance)."""
    n = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return _numbered(n, [F.desc("n"), F.asc("level")])


def codes_apply(df: DataFrame, col: str, codes: DataFrame, name: str | None = None, missing: int = -1) -> DataFrame:
    """Add ``name`` (default ``<col>_code``): the level's code by an equi-join; NULL and unseen -> ``missing``."""
    t = codes.select(F.col("level").alias("_level"), F.col("code").alias("_code"))
    out = df.join(t, df[col] == F.col("_level"), "left").withColumn(name or f"{col}_code", F.coalesce("_code", F.lit(missing)))
    return out.drop("_level", "_code")


# ------------------------------------------------------------------ E4 quantile bins

def quantile_edges_fit(df: DataFrame, cols: Sequence[str], q: int = 10, exact: bool = True) -> dict[str, list[float]]:
    """Quantile edges of every column (pandas ``qcut``: linear interpolation, duplicate edges
    dropped).  Exact edges come from the skew-safe ranked percentiles (each column is spread
    over many tasks); ``exact=False`` uses the fixed-memory sketch."""
    from featmart.operators.quantile import column_quantiles
    probs = [i / q for i in range(q + 1)]
    qs = column_quantiles(df, cols, probs, exact=exact)
    return {c: sorted({float(v) for v in qs[c] if v is not None}) for c in cols}


def bin_index(col: str | Column, edges: Sequence[float]) -> Column:
    """Bin of x for edges e0 < e1 < ... : (e_i, e_{i+1}] -> i, the first bin closed [e0, e1];
    outside [e0, e_last] or NULL -> NULL."""
    x = F.col(col) if isinstance(col, str) else col
    if not edges:
        return F.lit(None).cast("int")
    if len(edges) == 1:
        return F.when(x == F.lit(float(edges[0])), F.lit(0))
    arr = F.array(*[F.lit(float(e)) for e in edges])
    below = F.size(F.filter(arr, lambda e: e < x.cast("double")))
    return (F.when(x.isNull() | (x < F.lit(edges[0])) | (x > F.lit(edges[-1])), F.lit(None).cast("int"))
            .when(x == F.lit(edges[0]), F.lit(0)).otherwise(below - 1))


def _bin_lookup(b: Column, values: Sequence[float]) -> Column:
    """bin index -> value through a literal map (a NULL or unknown index gives NULL).
    (``element_at(array, NULL + 1)`` is avoided: it has returned a non-NULL element in
    Spark 4.1 when the index expression is a CASE with a NULL branch.)"""
    m = F.create_map(*[x for i, v in enumerate(values) for x in (F.lit(i), F.lit(float(v)))])
    return m[b]


# ------------------------------------------------------------------ E5 E6 E7 WoE

def _woe_expr(events: Column, count: Column, base: float, formula: str, tot_ev: float, tot_ne: float,
              eps: float = 1e-10) -> Column:
    if formula == "rate_odds":
        # an empty bin counts as one row (the denominator is never zero)
        denom = F.greatest(count, F.lit(1))
        return F.log(((events + F.lit(eps)) / (denom + F.lit(eps))) / F.lit(base))
    if formula == "standard":
        ne = count - events
        return F.log(F.try_divide(F.try_divide(events + F.lit(eps), F.lit(tot_ev)),
                                  F.try_divide(ne + F.lit(eps), F.lit(tot_ne))))
    raise ValueError(formula)


def woe_fit(df: DataFrame, label: str, cat_cols: Sequence[str] = (), num_cols: Sequence[str] = (),
            bins: int = 10, smoothing: float = 0.5, formula: str = "rate_odds") -> DataFrame:
    """Fit WoE tables for categorical and numeric columns.

    Returns one small DataFrame (feature, kind, bin, value, lo, hi, fill, count, events, woe):
    categorical rows carry ``value`` (NULL -> 'Missing'); numeric rows carry the bin index and its
    (lo, hi] edges, and ``fill`` = max + 1 used for NULLs.  Base odds for 'rate_odds' follow the
    smoothed form rate+ = mean(y) + s, rate- = 1 - rate+ + s."""
    spark = df.sparkSession
    lab = df.filter(F.col(label).isNotNull())
    stats = lab.agg(F.avg(label).alias("m"), F.sum(label).alias("e"), F.count(F.lit(1)).alias("n")).first()
    ev_rate = stats["m"] + smoothing
    base = ev_rate / (1.0 - ev_rate + smoothing)
    tot_ev, tot_ne = float(stats["e"]), float(stats["n"] - stats["e"])
    parts = []
    if cat_cols:
        u = unpivot_values(lab.select(label, *cat_cols), cat_cols, extra=[label])
        u = u.withColumn("value", F.coalesce("value", F.lit(MISSING)))
        g = u.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("count"), F.sum(label).alias("events"))
        parts.append(g.select("feature", F.lit("cat").alias("kind"), F.lit(None).cast("int").alias("bin"), "value",
                              F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
                              F.lit(None).cast("double").alias("fill"), "count", "events"))
    if num_cols:
        mx = lab.agg(*[F.max(c).cast("double").alias(f"m{i}") for i, c in enumerate(num_cols)]).first()
        fills = {c: (mx[f"m{i}"] + 1.0 if mx[f"m{i}"] is not None else 0.0) for i, c in enumerate(num_cols)}
        filled = lab.select(label, *[F.coalesce(F.col(c).cast("double"), F.lit(fills[c])).alias(c) for c in num_cols])
        edges = quantile_edges_fit(filled, num_cols, q=bins)
        binned = filled.select(label, *[bin_index(c, edges[c]).alias(c) for c in num_cols])
        u = unpivot_values(binned, num_cols, extra=[label], as_string=False)
        g = u.groupBy("feature", F.col("value").cast("int").alias("bin")).agg(
            F.count(F.lit(1)).alias("count"), F.sum(label).alias("events"))
        edge_rows = [(c, i, float(e[i]), float(e[i + 1]), float(fills[c]))
                     for c, e in edges.items() for i in range(len(e) - 1)]
        et = spark.createDataFrame(edge_rows, "feature string, bin int, lo double, hi double, fill double")
        # every fitted bin is kept, empty ones with zero counts (edges stay contiguous)
        parts.append(et.join(g, ["feature", "bin"], "left").select(
            "feature", F.lit("num").alias("kind"), "bin", F.lit(None).cast("string").alias("value"),
            "lo", "hi", "fill", F.coalesce("count", F.lit(0)).alias("count"),
            F.coalesce("events", F.lit(0)).alias("events")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = out.withColumn("woe", _woe_expr(F.col("events"), F.col("count"), base, formula, tot_ev, tot_ne))
    return out


def woe_apply(df: DataFrame, table: DataFrame, suffix: str = "", missing_value: float | None = None) -> DataFrame:
    """Replace (or add with ``suffix``) every fitted column by its WoE (E7); ``table`` is ``woe_fit``'s
    result.

    Categorical: an equi-join on the level, NULL being 'Missing'; numeric: NULL -> fill, bin by the
    fitted edges, bin -> WoE.  Unseen category or a value outside the fitted range -> NULL (or
    ``missing_value``)."""
    from featmart.session import cut_lineage
    table = cut_lineage(table)                 # read once per categorical column
    kinds = {r["feature"]: r["kind"] for r in table.select("feature", "kind").distinct().collect()}     # a row per column
    bins: dict[str, list] = {}
    for r in table.filter("kind = 'num'").collect():                                                    # columns x bins
        bins.setdefault(r["feature"], []).append(r)
    rules = {}
    out = df
    for i, (feat, kind) in enumerate(sorted(kinds.items())):
        if kind == "cat":
            t = table.filter((F.col("feature") == feat) & (F.col("kind") == "cat")).select(
                F.col("value").alias(f"_value{i}"), F.col("woe").alias(f"_woe{i}"))
            out = out.join(t, F.coalesce(df[feat].cast("string"), F.lit(MISSING)) == F.col(f"_value{i}"), "left")
            v = F.col(f"_woe{i}")
        else:
            rows = sorted(bins[feat], key=lambda r: r["bin"])
            edges = [rows[0]["lo"]] + [r["hi"] for r in rows]
            b = bin_index(F.coalesce(df[feat].cast("double"), F.lit(rows[0]["fill"])), edges)
            v = _bin_lookup(b, [r["woe"] for r in rows])
        if missing_value is not None:
            v = F.coalesce(v, F.lit(float(missing_value)))
        rules[feat + suffix] = v
    if suffix:
        return out.select(*[df[c] for c in df.columns], *[e.alias(n) for n, e in rules.items()])
    return out.select(*[rules[c].alias(c) if c in rules else df[c] for c in df.columns])


# ------------------------------------------------------------------ E10 break table

def break_table(df: DataFrame, col: str, label: str, breaks: Sequence[float], missing_bin: bool = True) -> DataFrame:
    """Manual breaks (-inf, b1], (b1, b2], ..., (bk, inf) with an optional 'missing' bin: count,
    events, bad rate, WoE = ln(dist_events / dist_nonevents), IV contribution (E10)."""
    x = F.col(col)
    lab = df.filter(F.col(label).isNotNull())
    edges = [-math.inf, *breaks, math.inf]
    b = None
    for i in range(len(edges) - 1):
        cond = x <= F.lit(edges[i + 1]) if i < len(edges) - 2 else x.isNotNull()
        tag = f"{i:02d}:({edges[i]}, {edges[i + 1]}]"
        b = F.when(cond, F.lit(tag)) if b is None else b.when(cond, F.lit(tag))
    b = b.otherwise(F.lit("missing") if missing_bin else F.lit(None))
    g = lab.select(b.alias("bin"), F.col(label).alias("y")).filter(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.count(F.lit(1)).alias("count"), F.sum("y").alias("events"))
    tot = g.agg(F.sum("events").alias("te"), F.sum("count").alias("tc")).first()
    te, tne = float(tot["te"]), float(tot["tc"] - tot["te"])
    de = F.try_divide(F.col("events"), F.lit(te))
    dn = F.try_divide(F.col("count") - F.col("events"), F.lit(tne))
    woe = F.log(F.try_divide(de, dn))
    return g.select("bin", "count", "events", (F.col("events") / F.col("count")).alias("bad_rate"),
                    woe.alias("woe"), ((de - dn) * woe).alias("iv"))


# ------------------------------------------------------------------ E11 risk groups

def risk_groups_fit(df: DataFrame, col: str, label: str, target=1, upper: float = 8.2,
                    lower: float = 8.2) -> DataFrame:
    """Per category: percent of labelled rows with ``label == target``, rounded half-even to one
    decimal, and its high / medium / low membership (E11).  Categories with no target rows are
    in no group; with ``upper == lower`` there is no medium group and a category exactly at the
    limit is both high and low."""
    lab = df.filter(F.col(label).isNotNull() & F.col(col).isNotNull())
    g = lab.groupBy(col).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(label) == target, 1)).alias("k"))
    pct = half_even(F.col("k") * 100.0 / F.col("n"), 1)
    has = F.col("k") > 0
    out = g.select(col, pct.alias("pct"), (has & (pct >= upper)).cast("int").alias("high"),
                   (has & (pct <= lower)).cast("int").alias("low"),
                   (has & (pct < upper) & (pct > lower)).cast("int").alias("medium"))
    return out


def risk_groups_apply(df: DataFrame, col: str, table: DataFrame, upper: float = 8.2, lower: float = 8.2,
                      drop_source: bool = True) -> DataFrame:
    """0/1 columns by an equi-join with ``risk_groups_fit``'s table; NULL and unseen categories get 0."""
    groups = ["high", "medium", "low"] if upper != lower else ["high", "low"]
    t = table.select(F.col(col).alias("_category"), *[F.col(g).alias(f"_{g}") for g in groups])
    out = df.join(t, df[col] == F.col("_category"), "left")
    keep = [df[c] for c in df.columns if not (drop_source and c == col and dict(df.dtypes)[c] == "string")]
    return out.select(*keep, *[F.coalesce(f"_{g}", F.lit(0)).alias(f"{col}_{g}_risk") for g in groups])


# ------------------------------------------------------------------ E12 scaling

def standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population std from one aggregate (E12); constant columns -> NULL."""
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    rules = {}
    for i, c in enumerate(cols):
        m, s = row[f"m{i}"], row[f"s{i}"]
        rules[c] = F.when(F.lit(s is not None and s > 0), (F.col(c) - F.lit(m)) / F.lit(s if s else 1.0))
    return df.select(*[rules[c].alias(c) if c in rules else F.col(f"`{c}`") for c in df.columns])


# ------------------------------------------------------------------ E8 E9 optimal binning
#
# A pre-bin is a quantile interval (numeric) or a group of categories (categorical): categories are
# ranked by event rate (ties by name) and cut into at most ``prebins`` groups of about equal size, so
# any number of levels reduces to a bounded table. The search for the best bins then works on that table alone.

BIN_SCHEMA = T.StructType([
    T.StructField("feature", T.StringType()), T.StructField("bin", T.IntegerType()),
    T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()),
    T.StructField("count", T.LongType()), T.StructField("events", T.LongType()),
    T.StructField("woe", T.DoubleType()), T.StructField("iv", T.DoubleType()),
])
WOE_EPS = 0.5


def _best_bins(pdf, min_share: float, max_bins: int | None, trend: str, eps: float = WOE_EPS):
    """The optimal bins of one feature's pre-bin table (tiny; runs inside applyInPandas)."""
    import numpy as np
    import pandas as pd

    from featmart.operators.binning import best_partition, bin_values
    pdf = pdf.sort_values("bin").reset_index(drop=True)
    count, events = pdf["count"].to_numpy(float), pdf["events"].to_numpy(float)
    ends = best_partition(count, events, min_share, max_bins, trend, eps)
    starts = [0, *ends[:-1]]
    cnt, ev = np.add.reduceat(count, starts), np.add.reduceat(events, starts)
    woe, iv = bin_values(cnt, ev, len(ends), (ev.sum(), cnt.sum() - ev.sum()), eps)
    number = pdf["bin"].to_numpy()
    return pd.DataFrame({"feature": pdf["feature"].iloc[0], "bin": np.arange(len(ends)), "first": number[starts], "last": number[[e - 1 for e in ends]],
                         "count": cnt.astype(int), "events": ev.astype(int), "woe": woe, "iv": iv})[[f.name for f in BIN_SCHEMA.fields]]


class Bins:
    """Fitted supervised bins: ``edges`` (numeric pre-bin edges by column), ``levels`` (feature, value,
    prebin: the pre-bin of every category) and ``table`` (a row per final bin)."""

    def __init__(self, edges: dict[str, list[float]], levels: DataFrame | None, table: DataFrame, cats: list[str]):
        self.edges, self.levels, self.table, self.cats = edges, levels, table, cats


def _category_prebins(lab: DataFrame, cols: Sequence[str], prebins: int) -> DataFrame:
    """(feature, value, count, events, prebin) of every category."""
    from featmart.operators.seq import sequence_features
    u = unpivot_values(lab, cols, extra=["_y"]).filter(F.col("value").isNotNull())
    g = u.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("count"), F.sum("_y").alias("events"))
    g = g.withColumn("rate", F.col("events") / F.col("count"))
    s = sequence_features(g, "feature", ["rate", "value"], {"_cum": ("running_sum", "count"), "_all": ("key_sum", "count"),
                                                              "_rn": ("row_number",), "_n": ("key_count",)})
    # few categories: one each; many: equal shares of the rows before and halfway into the category
    share = F.floor((F.col("_cum") - F.col("count") / 2) * prebins / F.col("_all"))
    one = F.col("_n") <= prebins
    return s.select("feature", "value", "count", "events", F.when(one, F.col("_rn") - 1).otherwise(share).cast("int").alias("prebin"))


def optimal_bins(df: DataFrame, label: str, num_cols: Sequence[str] = (), cat_cols: Sequence[str] = (), prebins: int = 20,
                 min_share: float = 0.05, max_bins: int | None = None, trend: str = "monotone", written: bool = False) -> Bins:
    """Supervised binning (E8) on the labelled rows: (1) pre-bins of all columns; (2) one unpivot +
    ``groupBy(feature, bin)`` event table, the only pass over the data; (3) the optimal partition of each
    feature's at most ``prebins`` rows (``binning.best_partition``) via ``groupBy(feature).applyInPandas``,
    distributed over features. ``trend``: 'rising', 'falling', 'monotone' (the better of the two), 'peak', 'valley',
    'any_turn'. NULLs are not binned - they get a fixed value at apply time (E9). The labelled rows are read by the
    sketch, the ranks, the category counts and the event table, so they are written once first, unless ``df`` is
    ``written`` already."""
    from featmart.session import cut_lineage
    spark = df.sparkSession
    lab = df.filter(F.col(label).isNotNull()).select(F.col(label).cast("long").alias("_y"), *dict.fromkeys([*num_cols, *cat_cols]))
    lab = lab if written else cut_lineage(lab)
    parts, edges, levels = [], {}, None
    if num_cols:
        edges = quantile_edges_fit(lab, num_cols, q=prebins)
        binned = lab.select("_y", *[bin_index(c, edges[c]).alias(c) for c in num_cols])
        u = unpivot_values(binned, num_cols, extra=["_y"], as_string=False).filter(F.col("value").isNotNull())
        g = u.groupBy("feature", F.col("value").cast("int").alias("bin")).agg(
            F.count(F.lit(1)).alias("count"), F.sum("_y").alias("events"))
        every = spark.createDataFrame([(c, i) for c, e in edges.items() for i in range(max(1, len(e) - 1))] or [("", 0)], "feature string, bin int")
        # columns x prebins rows; empty pre-bins kept with zero counts
        parts.append(every.join(g, ["feature", "bin"], "left").select(
            "feature", "bin", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("events", F.lit(0)).alias("events")))
    if cat_cols:
        levels = cut_lineage(_category_prebins(lab, cat_cols, prebins))
        parts.append(levels.groupBy("feature", F.col("prebin").alias("bin")).agg(F.sum("count").alias("count"), F.sum("events").alias("events")))
        levels = levels.select("feature", "value", "prebin")
    pre = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    table = pre.groupBy("feature").applyInPandas(lambda p: _best_bins(p, min_share, max_bins, trend), BIN_SCHEMA)
    return Bins(edges, levels, cut_lineage(table), list(cat_cols))


def bin_edges(bins: Bins) -> DataFrame:
    """The table with (lo, hi] edges for numeric bins (NULL for categorical ones)."""
    rows = [(c, i, float(x)) for c, e in bins.edges.items() for i, x in enumerate(e)]
    et = bins.table.sparkSession.createDataFrame(rows or [("", 0, 0.0)], "feature string, i int, x double")
    lo = et.select("feature", F.col("i").alias("first"), F.col("x").alias("lo"))
    hi = et.select("feature", (F.col("i") - 1).alias("last"), F.col("x").alias("hi"))
    return bins.table.join(lo, ["feature", "first"], "left").join(hi, ["feature", "last"], "left").select(
        "feature", "bin", "lo", "hi", "count", "events", "woe", "iv")


def optimal_bins_fit(df: DataFrame, label: str, cols: Sequence[str], prebins: int = 20, min_share: float = 0.05,
                     max_bins: int | None = None, trend: str = "monotone") -> DataFrame:
    """Bins of numeric columns as one table (feature, bin, lo, hi, count, events, woe, iv)."""
    return bin_edges(optimal_bins(df, label, cols, (), prebins, min_share, max_bins, trend))


def binned_apply(df: DataFrame, bins: Bins, cols: Sequence[str] | None = None, suffix: str = "_binned", missing_value: float = 0.0,
                 keep: str = "both") -> DataFrame:
    """WoE of the fitted bin for every column (E9); NULL, out-of-range or unseen -> ``missing_value``.
    keep: 'both' (originals + binned), 'binned' (binned only)."""
    from featmart.operators.joins import few_rows
    woe: dict[str, list] = {}
    for r in bins.table.collect():                   # columns x prebins rows at most
        woe.setdefault(r["feature"], []).append(r)
    cols = [c for c in (cols or woe) if c in woe]
    out, exprs = df, {}
    for i, c in enumerate(cols):
        rows = sorted(woe[c], key=lambda r: r["bin"])
        by_prebin = [next((r["woe"] for r in rows if r["first"] <= b <= r["last"]), None) for b in range(rows[-1]["last"] + 1)]
        if c in bins.cats:
            # levels are written and mostly few: without a hint the rows are shuffled by the column before Spark sees that
            t = few_rows(bins.levels.filter(F.col("feature") == c).select(F.col("value").alias(f"_v{i}"), F.col("prebin").alias(f"_p{i}")))
            out = out.join(t, df[c].cast("string") == F.col(f"_v{i}"), "left")
            v = _bin_lookup(F.col(f"_p{i}"), [w if w is not None else missing_value for w in by_prebin])
        else:
            v = _bin_lookup(bin_index(df[c].cast("double"), bins.edges[c]), by_prebin)
        exprs[c] = F.coalesce(v, F.lit(float(missing_value))).alias(c + suffix)
    base = [df[c] for c in df.columns if keep == "both" or c not in exprs]
    return out.select(*base, *[exprs[c] for c in cols])
