"""Catalogue: feature selection and data profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from featmart.functions import nulls as N
from featmart.operators import profile as PR
from featmart.operators import select as SE
from featmart.plans.compare import rs
from featmart.plans.registry import query
from featmart.sources import load


def _li_nulls(spark, sf):
    li = load(spark, sf, "lineitem", ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                                      "l_returnflag", "l_linestatus"])
    return li.select("l_orderkey", "l_quantity", "l_extendedprice",
                     F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("disc"),
                     F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("tax"), "l_returnflag", "l_linestatus")


_LI_NULLS_SQL = ("SELECT l_orderkey, l_quantity, l_extendedprice, nullif(l_discount, 0) AS disc, "
                 "nullif(l_tax, 0) AS tax, l_returnflag, l_linestatus FROM lineitem")
_LI_COLS = ["l_quantity", "l_extendedprice", "disc", "tax", "l_returnflag"]


# ------------------------------------------------------------------ Q1
@query("select_missing", "WITH t AS (" + _LI_NULLS_SQL + ")\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, {rs(f'avg(CAST({c} IS NULL AS DOUBLE))')} AS stat, "
    f"avg(CAST({c} IS NULL AS DOUBLE)) <= 0.05 AS keep FROM t" for c in _LI_COLS))
def q_select_missing(spark, sf):
    """NULL share per column in one pass; keep share <= 5 % (Q1)."""
    return SE.missing_share(_li_nulls(spark, sf), 0.05, _LI_COLS)


# ------------------------------------------------------------------ Q2 Q3 Q5
_ORD_NUM = ("SELECT o_totalprice, CAST(left(o_orderpriority, 1) AS INTEGER) AS prio, "
            "CAST(o_orderstatus = 'F' AS INTEGER) AS done, o_orderstatus, o_orderpriority, "
            "CAST(year(o_orderdate) AS VARCHAR) AS yr FROM orders")


def _freq_var_sql(c):
    return (f"SELECT '{c}' AS feature, var_samp(f) AS stat FROM (SELECT count(*) / sum(count(*)) OVER () AS f "
            f"FROM o WHERE {c} IS NOT NULL GROUP BY {c})")


def _select_variance_sql():
    num = "\nUNION ALL\n".join(
        f"SELECT 'numeric' AS method, '{c}' AS feature, {rs(f'var_samp({c})')} AS stat, "
        f"coalesce(var_samp({c}) >= 0.05, false) AS keep FROM o" for c in ("o_totalprice", "prio", "done"))
    cats = ["o_orderstatus", "o_orderpriority", "yr"]
    fv = "\nUNION ALL\n".join(_freq_var_sql(c) for c in cats)
    return f"""
WITH o AS ({_ORD_NUM}), fv AS ({fv})
{num}
UNION ALL SELECT 'categorical', feature, {rs('stat')}, coalesce(stat >= 0.0001, false) FROM fv WHERE feature <> 'yr'
UNION ALL SELECT 'any_type', feature, {rs('stat')}, coalesce(stat > 0.0001, false) FROM fv
"""


@query("select_variance", _select_variance_sql())
def q_select_variance(spark, sf):
    """Numeric variance threshold (Q3), relative-frequency variance of string columns (Q2) and the
    any-type keep-above rule (Q5); each one pass for all columns."""
    o = load(spark, sf, "orders", ["o_totalprice", "o_orderpriority", "o_orderstatus", "o_orderdate"]).select(
        "o_totalprice", F.substring("o_orderpriority", 1, 1).cast("int").alias("prio"),
        (F.col("o_orderstatus") == "F").cast("int").alias("done"), "o_orderstatus", "o_orderpriority",
        F.year("o_orderdate").cast("string").alias("yr"))
    num = SE.numeric_variance(o, 0.05, ["o_totalprice", "prio", "done"]).withColumn("method", F.lit("numeric"))
    cat = SE.frequency_variance(o, 0.0001, ["o_orderstatus", "o_orderpriority"]).withColumn(
        "method", F.lit("categorical"))
    anyt = SE.frequency_variance(o, 0.0001, ["o_orderstatus", "o_orderpriority", "yr"], keep_above=True).withColumn(
        "method", F.lit("any_type"))
    return num.unionByName(cat).unionByName(anyt).select("method", "feature", "stat", "keep")


# ------------------------------------------------------------------ Q6
_CONST_COLS = ["l_quantity", "l_linestatus", "one", "disc"]


@query("select_constant", "WITH t AS (SELECT *, 1 AS one FROM (" + _LI_NULLS_SQL + "))\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, CAST(min({c}) < max({c}) AS DOUBLE) AS stat, coalesce(min({c}) < max({c}), false) AS keep FROM t"
    for c in _CONST_COLS))
def q_select_constant(spark, sf):
    """Columns with at most one distinct value are dropped, via min < max in one pass (Q6)."""
    d = _li_nulls(spark, sf).withColumn("one", F.lit(1))
    return SE.constant_columns(d, _CONST_COLS)


# ------------------------------------------------------------------ Q4 X8
_CORR_COLS = ["l_quantity", "l_extendedprice", "disc", "tax", "unit_price"]
_CORR_SQL_BASE = f"SELECT *, l_extendedprice / l_quantity AS unit_price FROM ({_LI_NULLS_SQL})"


def _corr_pairs():
    return [(i, j) for i in range(len(_CORR_COLS)) for j in range(i + 1, len(_CORR_COLS))]


@query("correlation_matrix", f"WITH t AS ({_CORR_SQL_BASE})\n" + "\nUNION ALL\n".join(
    f"SELECT '{_CORR_COLS[i]}' AS a, '{_CORR_COLS[j]}' AS b, {i} AS ia, {j} AS ib, "
    f"{rs(f'corr({_CORR_COLS[i]}, {_CORR_COLS[j]})')} AS corr FROM t" for i, j in _corr_pairs()))
def q_correlation_matrix(spark, sf):
    """Pairwise Pearson correlations, pairwise-complete, long form, one aggregate."""
    d = _li_nulls(spark, sf).withColumn("unit_price", N.safe_div("l_extendedprice", "l_quantity"))
    return SE.correlation_long(d, _CORR_COLS)


@query("select_correlated", f"""
WITH t AS ({_CORR_SQL_BASE}),
p AS ({" UNION ALL ".join(f"SELECT '{_CORR_COLS[j]}' AS b, abs(corr({_CORR_COLS[i]}, {_CORR_COLS[j]})) AS c FROM t" for i, j in _corr_pairs())}),
w AS (SELECT b AS feature, max(c) AS stat FROM p GROUP BY 1),
f AS (SELECT unnest({_CORR_COLS!r}) AS feature)
SELECT f.feature, {rs('w.stat')} AS stat, NOT coalesce(w.stat > 0.5, false) AS keep FROM f LEFT JOIN w USING (feature)
""")
def q_select_correlated(spark, sf):
    """Drop the later column of every pair with |corr| > 0.5 (Q4)."""
    d = _li_nulls(spark, sf).withColumn("unit_price", N.safe_div("l_extendedprice", "l_quantity"))
    return SE.correlated(d, _CORR_COLS, 0.5)


# ------------------------------------------------------------------ X1 X2 X13
@query("missing_report", "WITH t AS (" + _LI_NULLS_SQL + ")\n" + "\nUNION ALL\n".join(
    f"SELECT * FROM (SELECT '{c}' AS column, CAST(sum(CAST({c} IS NULL AS INTEGER)) AS BIGINT) AS n_missing, "
    f"{rs(f'sum(CAST({c} IS NULL AS INTEGER)) * 100.0 / count(*)')} AS pct_missing FROM t) WHERE n_missing > 0"
    for c in ["l_orderkey", *_LI_COLS, "l_linestatus"]))
def q_missing_report(spark, sf):
    """Missing-value report: count and percent per column, columns with NULLs only."""
    return PR.missing_report(_li_nulls(spark, sf))


_DESC_COLS = ["l_quantity", "l_extendedprice", "disc", "tax"]


@query("describe", "WITH t AS (" + _LI_NULLS_SQL + ")\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, count({c}) AS count, {rs(f'avg({c})')} AS mean, {rs(f'stddev_samp({c})')} AS std, "
    f"{rs(f'min({c})')} AS min, {rs(f'quantile_cont({c}, 0.25)')} AS p25, {rs(f'quantile_cont({c}, 0.5)')} AS p50, "
    f"{rs(f'quantile_cont({c}, 0.75)')} AS p75, {rs(f'max({c})')} AS max FROM t" for c in _DESC_COLS))
def q_describe(spark, sf):
    """describe(): count, mean, std, min, quartiles, max per numeric column."""
    return PR.describe(_li_nulls(spark, sf), _DESC_COLS)


@query("schema_listing", """
WITH t AS (SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT 'doc_id' AS column, 'bigint' AS type, count(doc_id) AS non_null FROM t
UNION ALL SELECT 'lang', 'string', count(lang) FROM t
UNION ALL SELECT 'n_chars', 'bigint', count(n_chars) FROM t
UNION ALL SELECT 'quality', 'int', count(quality) FROM t
UNION ALL SELECT 'toxic', 'int', count(toxic) FROM t
""")
def q_schema_listing(spark, sf):
    """Schema listing with non-NULL counts."""
    d = load(spark, sf, "documents", ["doc_id", "lang", "n_chars"]).join(
        load(spark, sf, "labels", ["doc_id", "quality", "toxic"]), "doc_id", "left")
    return PR.schema_listing(d)


# ------------------------------------------------------------------ X3 X4 X5 X6 X12
_CUST_Y = "SELECT c_custkey, c_mktsegment, c_nationkey, CAST(c_acctbal < 0 AS INTEGER) AS y FROM customer"


def _cust_y(spark, sf):
    return load(spark, sf, "customer", ["c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal"]).withColumn(
        "y", (F.col("c_acctbal") < 0).cast("int"))


@query("label_by_category", f"""
WITH c AS ({_CUST_Y}), g AS (SELECT c_mktsegment, y, count(*) AS n FROM c GROUP BY 1, 2)
SELECT c_mktsegment, y, n, {rs('n / sum(n) OVER (PARTITION BY c_mktsegment)')} AS share_in_category FROM g
""")
def q_label_by_category(spark, sf):
    """Counts by category x label and the label share within each category."""
    return PR.counts_by_label(_cust_y(spark, sf), "c_mktsegment", "y")


@query("label_share_wide", f"""
WITH c AS ({_CUST_Y}),
g AS (SELECT c_mktsegment, count(CASE WHEN y = 0 THEN 1 END) AS n0, count(CASE WHEN y = 1 THEN 1 END) AS n1
      FROM c WHERE y IS NOT NULL GROUP BY 1)
SELECT c_mktsegment, {rs('n0 / (n0 + n1)')} AS share_0, {rs('n1 / (n0 + n1)')} AS share_1, n0 + n1 AS n FROM g
""")
def q_label_share_wide(spark, sf):
    """Label distribution normalised within each category, unstacked with a pivot."""
    return PR.label_share_wide(_cust_y(spark, sf), "c_mktsegment", "y", [0, 1])


@query("rate_by_category", f"""
WITH c AS ({_CUST_Y})
SELECT c_nationkey, count(*) AS n, {rs('avg(y) * 100.0')} AS rate_pct FROM c WHERE y IS NOT NULL GROUP BY 1
""")
def q_rate_by_category(spark, sf):
    """Default rate per category."""
    return PR.rate_by_category(_cust_y(spark, sf), "c_nationkey", "y")


@query("conditional_rate", f"""
WITH c AS ({_CUST_Y})
SELECT 'building_default' AS cond, count(*) AS n, {rs('avg(CAST(y = 1 AS DOUBLE))')} AS rate FROM c WHERE c_mktsegment = 'BUILDING' AND y IS NOT NULL
UNION ALL
SELECT 'other_non_default', count(*), {rs('avg(CAST(y = 0 AS DOUBLE))')} FROM c WHERE c_mktsegment <> 'BUILDING' AND y IS NOT NULL
""")
def q_conditional_rate(spark, sf):
    """Conditional rates: defaults among one group, non-defaults among the rest."""
    c = _cust_y(spark, sf)
    a = PR.conditional_rate(c, "y", F.col("c_mktsegment") == "BUILDING", True).withColumn("cond", F.lit("building_default"))
    b = PR.conditional_rate(c, "y", F.col("c_mktsegment") != "BUILDING", False).withColumn("cond", F.lit("other_non_default"))
    return a.unionByName(b).select("cond", "n", "rate")


@query("distinct_per_entity", f"""
WITH c AS ({_CUST_Y}),
per AS (SELECT o.o_custkey, c.y, count(DISTINCT o.o_orderpriority) AS n_distinct
        FROM orders o JOIN c ON o.o_custkey = c.c_custkey GROUP BY 1, 2)
SELECT y, n_distinct, count(*) AS n_entities FROM per GROUP BY 1, 2
""")
def q_distinct_per_entity(spark, sf):
    """Distinct priorities per (customer, label), then their distribution per label."""
    o = load(spark, sf, "orders", ["o_custkey", "o_orderpriority"])
    c = _cust_y(spark, sf).select("c_custkey", "y")
    d = o.join(c, o.o_custkey == c.c_custkey)
    return PR.distinct_per_entity(d, "o_custkey", "y", "o_orderpriority")


# ------------------------------------------------------------------ X7 X10 X9 X11
_SPEND = f"""SELECT c.c_custkey, c.y, s.spend FROM ({_CUST_Y}) c
LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS spend FROM orders GROUP BY 1) s ON c.c_custkey = s.o_custkey"""


def _spend(spark, sf):
    s = load(spark, sf, "orders", ["o_custkey", "o_totalprice"]).groupBy("o_custkey").agg(
        F.sum("o_totalprice").alias("spend"))
    c = _cust_y(spark, sf).select("c_custkey", "y")
    return c.join(s, c.c_custkey == s.o_custkey, "left").select("c_custkey", "y", "spend")


_QPROBS = [0.5, 0.75, 0.9, 0.95, 0.99]


@query("quantiles_by_label", f"""
WITH s AS ({_SPEND})
SELECT y, {", ".join(f"{rs(f'quantile_cont(spend, {p})')} AS q{int(round(p * 100))}" for p in _QPROBS)}
FROM s WHERE y IS NOT NULL GROUP BY 1
""")
def q_quantiles_by_label(spark, sf):
    """Spend quantiles (0.5 ... 0.99) per label class."""
    return PR.quantiles_by_label(_spend(spark, sf), "spend", "y", _QPROBS)


@query("five_numbers", f"""
WITH s AS ({_SPEND}),
g AS (SELECT y, min(spend) AS mn, quantile_cont(spend, 0.25) AS q1, quantile_cont(spend, 0.5) AS q2,
             quantile_cont(spend, 0.75) AS q3, max(spend) AS mx FROM s WHERE y IS NOT NULL GROUP BY 1)
SELECT y, {rs('mn')} AS min, {rs('q1')} AS q1, {rs('q2')} AS median, {rs('q3')} AS q3, {rs('mx')} AS max,
       {rs('q1 - (q3 - q1) * 1.5')} AS fence_low, {rs('q3 + (q3 - q1) * 1.5')} AS fence_high
FROM g
""")
def q_five_numbers(spark, sf):
    """Box-plot table: five numbers and 1.5 IQR fences per label class."""
    return PR.five_numbers(_spend(spark, sf), "spend", "y")


@query("histogram_limits", f"""
WITH s AS ({_SPEND}), p AS (SELECT spend FROM s WHERE spend > 500000 AND spend < 2500000),
m AS (SELECT min(spend) AS a, (max(spend) - min(spend)) / (SELECT floor(1 + log2(count(*))) FROM s) AS w,
             (SELECT floor(1 + log2(count(*))) FROM s) AS k FROM p)
SELECT bin, {rs('a + bin * w')} AS "left", {rs('a + (bin + 1) * w')} AS "right", count(*) AS n
FROM (SELECT CAST(least(floor((spend - a) / w), k - 1) AS INTEGER) AS bin, a, w FROM p, m) GROUP BY bin, a, w
""")
def q_histogram_limits(spark, sf):
    """Histogram with 1 + log2 N bins over the values strictly inside the limits."""
    return PR.histogram(_spend(spark, sf), "spend", lo=500_000.0, hi=2_500_000.0)


@query("histogram_by_label", f"""
WITH s AS (SELECT * FROM ({_SPEND}) WHERE spend IS NOT NULL),
m AS (SELECT min(spend) AS a, max(spend) AS b FROM s),
h AS (SELECT y, CAST(least(floor((spend - a) / ((b - a) / 20)), 19) AS INTEGER) AS bin, count(*) AS n, any_value(a) AS a,
             any_value((b - a) / 20) AS w FROM s, m GROUP BY 1, 2)
SELECT y, bin, {rs('a + bin * w')} AS "left", {rs('a + (bin + 1) * w')} AS "right", n,
       {rs('n / (sum(n) OVER (PARTITION BY y) * w)')} AS density
FROM h
""")
def q_histogram_by_label(spark, sf):
    """20-bin equal-width histogram on [min, max] split by label, with per-class density
    (X9, X11)."""
    return PR.histogram(_spend(spark, sf), "spend", 20, by="y", density=True)


# ------------------------------------------------------------------ X11
@query("density_by_label", f"""
WITH s AS (SELECT * FROM ({_SPEND}) WHERE spend IS NOT NULL AND y IS NOT NULL),
p AS (SELECT y, count(*) AS n, pow(count(*)::DOUBLE, -0.2::DOUBLE) * stddev_samp(spend) AS h, min(spend) AS lo, max(spend) AS hi FROM s GROUP BY 1),
e AS (SELECT min(lo) - 3 * max(h) AS a, (max(hi) + 3 * max(h) - (min(lo) - 3 * max(h))) / 199 AS d FROM p),
b AS (SELECT y, (spend - a) / d AS t, least(floor((spend - a) / d), 198) AS i FROM s, e),
g AS (SELECT y, j, sum(w) AS w FROM (SELECT y, i AS j, 1 - (t - i) AS w FROM b UNION ALL SELECT y, i + 1, t - i FROM b) GROUP BY 1, 2),
c AS (SELECT unnest(range(0, 200)) AS i)
SELECT g.y, CAST(c.i AS INTEGER) AS i, {rs('any_value(e.a + c.i * e.d)')} AS x,
  {rs('round(sum(g.w * exp(-0.5::DOUBLE * pow((c.i - g.j) * e.d / p.h, 2))) / (any_value(p.n) * any_value(p.h) * sqrt(2 * pi())) * 1e6, 9)')} AS density
FROM c, e, g JOIN p USING (y) GROUP BY g.y, c.i
""")
def q_density_by_label(spark, sf):
    """Gaussian kernel density of spend per label class on a grid of 200 points, Scott's bandwidth (X11); per million,
    to nine decimals."""
    d = PR.density_curve(_spend(spark, sf), "spend", "y")
    return d.withColumn("density", F.round(F.col("density") * 1e6, 9))


# ------------------------------------------------------------------ Q2 Q5 by sketch
def _wide_orders(spark, sf):
    """String columns of few and of very many values."""
    o = load(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate"])
    return o.select("o_orderstatus", "o_orderpriority", F.year("o_orderdate").cast("string").alias("yr"), F.col("o_custkey").cast("string").alias("cust"),
                    F.col("o_orderkey").cast("string").alias("okey"), F.to_date("o_orderdate").cast("string").alias("day"),
                    F.when(F.col("o_orderkey") % 10 > 0, "most").otherwise(F.col("o_orderkey").cast("string")).alias("hot"))


_WIDE_SQL = """SELECT o_orderstatus, o_orderpriority, CAST(year(o_orderdate) AS VARCHAR) AS yr, CAST(o_custkey AS VARCHAR) AS cust, CAST(o_orderkey AS VARCHAR) AS okey,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CASE WHEN o_orderkey % 10 > 0 THEN 'most' ELSE CAST(o_orderkey AS VARCHAR) END AS hot FROM orders"""
_WIDE_COLS = ["o_orderstatus", "o_orderpriority", "yr", "cust", "okey", "day", "hot"]


@query("select_frequency_sketch", f"WITH o AS ({_WIDE_SQL})\n" + "\nUNION ALL\n".join(
    f"SELECT feature, coalesce(stat {op} {t!r}, false) AS keep, true AS bounds_hold, '{m}' AS method FROM ({_freq_var_sql(c)})"
    for c in _WIDE_COLS for m, op, t in (("Q2", ">=", 1e-4), ("Q5", ">", 1e-6))))
def q_select_frequency_sketch(spark, sf):
    """Frequency-variance selection by sketch: the same columns as the exact count, which only columns near the
    threshold get, and bounds that hold the exact value (Q2, Q5)."""
    o = _wide_orders(spark, sf)
    a = SE.select_by_frequency(o, 1e-4, _WIDE_COLS).withColumn("method", F.lit("Q2"))
    b = SE.select_by_frequency(o, 1e-6, _WIDE_COLS, keep_above=True).withColumn("method", F.lit("Q5"))
    exact = SE.frequency_variance(o, 0.0, _WIDE_COLS).select("feature", "stat")
    hold = F.col("stat").between(F.col("low") * (1 - 1e-9), F.col("high") * (1 + 1e-9))
    return a.unionByName(b).join(exact, "feature").select("feature", "keep", hold.alias("bounds_hold"), "method")
