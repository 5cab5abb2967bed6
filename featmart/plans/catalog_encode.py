"""Catalogue: encoders and binning."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from featmart.operators import encode as EN
from featmart.plans.compare import rs
from featmart.plans.registry import query
from featmart.sources import load

PROBS10 = [i / 10 for i in range(11)]
_P10 = "[" + ", ".join(repr(p) for p in PROBS10) + "]"
_PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_STATUS = ["F", "O", "P"]


def _bin_sql(x, edges="edges"):
    return (f"CASE WHEN {x} IS NULL OR {x} < {edges}[1] OR {x} > {edges}[len({edges})] THEN NULL "
            f"WHEN {x} = {edges}[1] THEN 0 ELSE CAST(len(list_filter({edges}, lambda v: v < {x})) - 1 AS INTEGER) END")


# ------------------------------------------------------------------ E1
def _onehot_sql():
    cols = []
    for c, vals in (("o_orderstatus", _STATUS), ("o_orderpriority", _PRIOS)):
        for v in vals:
            cols.append(f"CAST(sum(coalesce(CAST({c} = '{v}' AS INTEGER), 0)) AS BIGINT) AS \"{c}_{v}\"")
        cols.append(f"CAST(sum(CAST({c} IS NULL AS INTEGER)) AS BIGINT) AS \"{c}_nan\"")
    return f"SELECT o_custkey, {', '.join(cols)} FROM orders GROUP BY 1"


@query("one_hot", _onehot_sql())
def q_one_hot(spark, sf):
    """One-hot of all string columns with a missing-value indicator, levels fitted in one pass,
    then summed per customer (E1)."""
    o = load(spark, sf, "orders", ["o_custkey", "o_orderstatus", "o_orderpriority"])
    levels = EN.one_hot_fit(o)
    enc, new = EN.one_hot_apply(o, levels, dummy_na=True)
    return enc.groupBy("o_custkey").agg(*[F.sum(F.col(f"`{c}`")).alias(c) for c in new])


_CUST_LAB = ("SELECT c_custkey, c_mktsegment, CAST(c_nationkey AS VARCHAR) AS c_nationkey, "
             "CAST(c_acctbal < 0 AS INTEGER) AS y FROM customer")
_WOE_CAT_FIT = f"""
WITH b AS ({_CUST_LAB}),
s AS (SELECT avg(y) + 0.5 AS er, sum(y) AS te, count(*) - sum(y) AS tn FROM b),
u AS (SELECT 'c_mktsegment' AS feature, coalesce(c_mktsegment, 'Missing') AS value, y FROM b
      UNION ALL SELECT 'c_nationkey', coalesce(c_nationkey, 'Missing'), y FROM b),
g AS (SELECT feature, value, count(*) AS count, CAST(sum(y) AS BIGINT) AS events FROM u GROUP BY 1, 2)
SELECT feature, value, count, events,
  ln(((events + 1e-10) / (count + 1e-10)) / (er / (1 - er + 0.5))) AS woe_rate_odds,
  ln(((events + 1e-10) / te) / ((count - events + 1e-10) / tn)) AS woe_standard
FROM g, s
"""


_HOT_COLS = ["o_orderstatus", "o_orderpriority", "day"]
_HOT_SQL = """WITH o AS (SELECT o_custkey, o_orderstatus, nullif(o_orderpriority, '5-LOW') AS o_orderpriority, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders),
u AS (SELECT o_custkey, 'o_orderstatus' AS feature, o_orderstatus AS level FROM o UNION ALL SELECT o_custkey, 'o_orderpriority', o_orderpriority FROM o
  UNION ALL SELECT o_custkey, 'day', day FROM o)"""


def _hot_orders(spark, sf):
    """Columns of three, four (and NULL) and some thousand levels."""
    return load(spark, sf, "orders", ["o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"]).select(
        "o_custkey", "o_orderstatus", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"), F.to_date("o_orderdate").cast("string").alias("day"))


@query("one_hot_counts", f"{_HOT_SQL}\nSELECT o_custkey, feature, level, count(*) AS n FROM u GROUP BY 1, 2, 3")
def q_one_hot_counts(spark, sf):
    """One-hot sums per customer as keyed counts, no column per level."""
    return EN.level_counts(_hot_orders(spark, sf), "o_custkey", _HOT_COLS)


@query("one_hot_vector", f"""{_HOT_SQL}, n AS (SELECT feature, level, count(*) AS n FROM u GROUP BY 1, 2)
SELECT row_number() OVER (ORDER BY list_position(['o_orderstatus', 'o_orderpriority', 'day'], feature), level NULLS FIRST) - 1 AS index, feature, level, n FROM n
""")
def q_one_hot_vector(spark, sf):
    """One sparse vector per order for all levels of all columns, added up: how often each place holds a 1."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer
    o = _hot_orders(spark, sf)
    index = EN.one_hot_index(o, _HOT_COLS)
    total = EN.one_hot_vector(o, _HOT_COLS, index, "v").agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("s"))      # one row
    sums = total.select(F.posexplode("s").alias("index", "n"))
    return index.join(sums, "index").select("index", "feature", "level", F.round("n").cast("long").alias("n"))


# ------------------------------------------------------------------ F7: saved estimators
@query("saved_estimators", f"""
WITH f AS (SELECT * FROM ({_WOE_CAT_FIT})),
e AS (SELECT list_sort(list_distinct(quantile_cont(c_acctbal, [0, 0.25, 0.5, 0.75, 1]))) AS edges FROM customer),
k AS (SELECT c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL))
SELECT c.c_custkey, {rs('f.woe_rate_odds')} AS c_mktsegment_woe, CAST({_bin_sql('c.c_acctbal')} AS INTEGER) AS c_acctbal_bin,
  CAST(coalesce(k.code, -1) AS INTEGER) AS c_mktsegment_code
FROM customer c CROSS JOIN e LEFT JOIN f ON f.feature = 'c_mktsegment' AND f.value = coalesce(c.c_mktsegment, 'Missing') LEFT JOIN k ON k.c_mktsegment = c.c_mktsegment
""")
def q_saved_estimators(spark, sf):
    """A pipeline of the library's estimators fitted and saved by one session, loaded from the folder and applied by
    another (F7, M4, M6)."""
    from pyspark.ml import Pipeline, PipelineModel

    from featmart.operators.estimators import FiniteOrNull, LevelCoder, QuantileBinner, WoeEncoder
    from featmart.session import checkpoint_dir

    def customers(session):
        return load(session, sf, "customer", ["c_custkey", "c_mktsegment", "c_acctbal"]).withColumn("y", (F.col("c_acctbal") < 0).cast("int"))

    stages = [FiniteOrNull(inputCols=["c_acctbal"]), QuantileBinner(inputCols=["c_acctbal"], bins=4), WoeEncoder(inputCols=["c_mktsegment"], labelCol="y"),
              LevelCoder(inputCols=["c_mktsegment"])]
    path = f"{checkpoint_dir(spark)}/estimators-{uuid.uuid4().hex}"
    Pipeline(stages=stages).fit(customers(spark)).write().save(path)
    scored = PipelineModel.load(path).transform(customers(spark))
    return scored.select("c_custkey", "c_mktsegment_woe", "c_acctbal_bin", "c_mktsegment_code")


# ------------------------------------------------------------------ E2 E3
@query("label_codes", """
WITH p AS (SELECT o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS prio_code
           FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL)),
s AS (SELECT o_orderstatus, row_number() OVER (ORDER BY n DESC, o_orderstatus) - 1 AS status_code
      FROM (SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1))
SELECT CAST(coalesce(p.prio_code, -1) AS INTEGER) AS prio_code, CAST(coalesce(s.status_code, -1) AS INTEGER) AS status_code,
       count(*) AS n
FROM orders o LEFT JOIN p USING (o_orderpriority) LEFT JOIN s USING (o_orderstatus)
GROUP BY 1, 2
""")
def q_label_codes(spark, sf):
    """Codes by sorted level (E2) and by frequency desc / value asc (E3); missing -> -1."""
    o = load(spark, sf, "orders", ["o_orderpriority", "o_orderstatus"])
    prio = EN.sorted_codes_fit(o, "o_orderpriority")
    stat = EN.frequency_codes_fit(o, "o_orderstatus")
    c = EN.codes_apply(EN.codes_apply(o, "o_orderpriority", prio, "prio_code"), "o_orderstatus", stat, "status_code")
    return c.groupBy("prio_code", "status_code").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ E4
def _qbins_sql(col):
    return f"""SELECT '{col}' AS feature, bin, {rs('edges[bin + 1]')} AS lo, {rs('edges[bin + 2]')} AS hi, count(*) AS n
FROM (SELECT {_bin_sql(col)} AS bin, edges FROM lineitem,
      (SELECT list_sort(list_distinct(quantile_cont({col}, {_P10}))) AS edges FROM lineitem))
GROUP BY bin, edges"""


@query("quantile_bins", f"{_qbins_sql('l_extendedprice')}\nUNION ALL\n{_qbins_sql('l_discount')}")
def q_quantile_bins(spark, sf):
    """Decile edges of two columns in one aggregate, duplicate edges dropped, (lo, hi] bins with
    the lowest edge included (E4)."""
    li = load(spark, sf, "lineitem", ["l_extendedprice", "l_discount"])
    cols = ["l_extendedprice", "l_discount"]
    edges = EN.quantile_edges_fit(li, cols, q=10)
    binned = EN.unpivot_values(li.select(*[EN.bin_index(c, edges[c]).alias(c) for c in cols]), cols, as_string=False)
    g = binned.groupBy("feature", F.col("value").cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    et = spark.createDataFrame([(c, i, e[i], e[i + 1]) for c, e in edges.items() for i in range(len(e) - 1)],
                               "feature string, bin int, lo double, hi double")
    return g.join(et, ["feature", "bin"], "left").select("feature", "bin", "lo", "hi", "n")


# ------------------------------------------------------------------ E5 E7 categorical
@query("woe_categorical", f"""
SELECT feature, value, count, events, {rs('woe_rate_odds')} AS woe_rate_odds, {rs('woe_standard')} AS woe_standard
FROM ({_WOE_CAT_FIT})
""")
def q_woe_categorical(spark, sf):
    """Categorical WoE tables (segment, nation) against label A with the smoothed rate-odds
    formula and the textbook formula (E5)."""
    c = load(spark, sf, "customer", ["c_mktsegment", "c_nationkey", "c_acctbal"]).select(
        "c_mktsegment", F.col("c_nationkey").cast("string").alias("c_nationkey"),
        (F.col("c_acctbal") < 0).cast("int").alias("y"))
    cols = ["c_mktsegment", "c_nationkey"]
    a = EN.woe_fit(c, "y", cat_cols=cols, formula="rate_odds").select(
        "feature", "value", "count", "events", F.col("woe").alias("woe_rate_odds"))
    b = EN.woe_fit(c, "y", cat_cols=cols, formula="standard").select(
        "feature", "value", F.col("woe").alias("woe_standard"))
    return a.join(b, ["feature", "value"])


@query("woe_apply_categorical", f"""
WITH f AS ({_WOE_CAT_FIT}), b AS ({_CUST_LAB})
SELECT b.c_custkey, {rs('fs.woe_rate_odds')} AS c_mktsegment, {rs('fn.woe_rate_odds')} AS c_nationkey
FROM b LEFT JOIN f fs ON fs.feature = 'c_mktsegment' AND fs.value = coalesce(b.c_mktsegment, 'Missing')
       LEFT JOIN f fn ON fn.feature = 'c_nationkey' AND fn.value = coalesce(b.c_nationkey, 'Missing')
""")
def q_woe_apply_categorical(spark, sf):
    """Fitted categorical WoE applied to every customer through joins with the fitted table."""
    c = load(spark, sf, "customer", ["c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal"]).select(
        "c_custkey", "c_mktsegment", F.col("c_nationkey").cast("string").alias("c_nationkey"),
        (F.col("c_acctbal") < 0).cast("int").alias("y"))
    table = EN.woe_fit(c, "y", cat_cols=["c_mktsegment", "c_nationkey"])
    return EN.woe_apply(c, table).select("c_custkey", "c_mktsegment", "c_nationkey")


# ------------------------------------------------------------------ E6 E7 numeric
_DOC_LAB = ("SELECT d.doc_id, CAST(d.n_chars AS DOUBLE) AS x, l.toxic AS y FROM documents d "
            "JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NOT NULL")
_WOE_NUM_FIT = f"""
WITH lab AS ({_DOC_LAB}),
s AS (SELECT avg(y) + 0.5 AS er, max(x) + 1 AS fill FROM lab),
e AS (SELECT list_sort(list_distinct(quantile_cont(coalesce(x, fill), {_P10}))) AS edges FROM lab, s),
bn AS (SELECT {_bin_sql('xx')} AS bin, y, edges FROM (SELECT coalesce(x, fill) AS xx, y FROM lab, s), e),
g AS (SELECT bin, count(*) AS count, CAST(sum(y) AS BIGINT) AS events, any_value(edges) AS edges FROM bn GROUP BY bin)
SELECT bin, edges[bin + 1] AS lo, edges[bin + 2] AS hi, fill, count, events,
       ln(((events + 1e-10) / (count + 1e-10)) / (er / (1 - er + 0.5))) AS woe
FROM g, s
"""


@query("woe_numeric", f"""
SELECT bin, {rs('lo')} AS lo, {rs('hi')} AS hi, count, events, {rs('woe')} AS woe FROM ({_WOE_NUM_FIT})
""")
def q_woe_numeric(spark, sf):
    """Numeric WoE: NULL -> max + 1, ten quantile bins with duplicate edges dropped, rate-odds
    WoE per bin (E6); fit on the labelled documents only."""
    d = load(spark, sf, "documents", ["doc_id", "n_chars"]).join(load(spark, sf, "labels", ["doc_id", "toxic"]),
                                                                  "doc_id")
    t = EN.woe_fit(d.select("n_chars", "toxic"), "toxic", num_cols=["n_chars"], bins=10)
    return t.select("bin", "lo", "hi", "count", "events", "woe")


@query("woe_apply_numeric", f"""
WITH f AS ({_WOE_NUM_FIT}), ed AS (SELECT list(lo ORDER BY bin) || [max(hi)] AS edges, any_value(fill) AS fill FROM f)
SELECT d.doc_id, {rs('f.woe')} AS n_chars_woe
FROM documents d CROSS JOIN ed
LEFT JOIN f ON f.bin = {_bin_sql('coalesce(CAST(d.n_chars AS DOUBLE), ed.fill)', 'ed.edges')}
""")
def q_woe_apply_numeric(spark, sf):
    """Numeric WoE applied to all documents, labelled or not; values outside the fitted range ->
    NULL (E7)."""
    docs = load(spark, sf, "documents", ["doc_id", "n_chars"])
    lab = docs.join(load(spark, sf, "labels", ["doc_id", "toxic"]), "doc_id")
    table = EN.woe_fit(lab.select("n_chars", "toxic"), "toxic", num_cols=["n_chars"])
    return EN.woe_apply(docs, table, suffix="_woe").select("doc_id", "n_chars_woe")


# ------------------------------------------------------------------ E10
_BREAKS = [1_000_000.0, 2_000_000.0, 3_000_000.0]


def _break_sql():
    edges = [float("-inf"), *_BREAKS, float("inf")]
    whens = []
    for i in range(len(edges) - 1):
        tag = f"{i:02d}:({edges[i]}, {edges[i + 1]}]"
        cond = f"spend <= {edges[i + 1]!r}" if i < len(edges) - 2 else "spend IS NOT NULL"
        whens.append(f"WHEN {cond} THEN '{tag}'")
    case = "CASE " + " ".join(whens) + " ELSE 'missing' END"
    return f"""
WITH m AS (SELECT c.c_custkey, CAST(c.c_acctbal < 0 AS INTEGER) AS y, s.spend
           FROM customer c LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS spend FROM orders GROUP BY 1) s
           ON c.c_custkey = s.o_custkey),
g AS (SELECT {case} AS bin, count(*) AS count, CAST(sum(y) AS BIGINT) AS events FROM m GROUP BY 1),
t AS (SELECT sum(events) AS te, sum(count) - sum(events) AS tn FROM g),
r AS (SELECT bin, count, events, events / count AS bad_rate, events / te AS de, (count - events) / tn AS dn FROM g, t)
SELECT bin, count, events, {rs('bad_rate')} AS bad_rate,
  {rs('CASE WHEN de > 0 AND dn > 0 THEN ln(de / dn) END')} AS woe,
  {rs('CASE WHEN de > 0 AND dn > 0 THEN (de - dn) * ln(de / dn) END')} AS iv
FROM r
"""


@query("break_table", _break_sql())
def q_break_table(spark, sf):
    """Manual-break WoE / IV table with a missing bin over a customer-level order feature."""
    c = load(spark, sf, "customer", ["c_custkey", "c_acctbal"])
    spend = load(spark, sf, "orders", ["o_custkey", "o_totalprice"]).groupBy("o_custkey").agg(
        F.sum("o_totalprice").alias("spend"))
    m = c.join(spend, c.c_custkey == spend.o_custkey, "left").select(
        (F.col("c_acctbal") < 0).cast("int").alias("y"), "spend")
    return EN.break_table(m, "spend", "y", _BREAKS, missing_bin=True)


# ------------------------------------------------------------------ E11
@query("risk_groups", f"""
WITH g AS (SELECT c_nationkey, count(*) AS n, count(CASE WHEN c_acctbal < 0 THEN 1 END) AS k FROM customer GROUP BY 1)
SELECT c_nationkey, {rs('round_even(k * 100.0 / n, 1)')} AS pct,
  CAST(k > 0 AND round_even(k * 100.0 / n, 1) >= 8.2 AS INTEGER) AS high,
  CAST(k > 0 AND round_even(k * 100.0 / n, 1) <= 8.2 AS INTEGER) AS low,
  CAST(k > 0 AND round_even(k * 100.0 / n, 1) < 8.2 AND round_even(k * 100.0 / n, 1) > 8.2 AS INTEGER) AS medium
FROM g
""")
def q_risk_groups(spark, sf):
    """Risk grouping of nations by default percent (one decimal, half-even) with equal limits of
    8.2 % (E11)."""
    c = load(spark, sf, "customer", ["c_nationkey", "c_acctbal"]).withColumn(
        "y", (F.col("c_acctbal") < 0).cast("int"))
    return EN.risk_groups_fit(c, "c_nationkey", "y", target=1, upper=8.2, lower=8.2)


@query("risk_groups_apply", """
WITH g AS (SELECT c_mktsegment, count(*) AS n, count(CASE WHEN c_acctbal < 0 THEN 1 END) AS k FROM customer GROUP BY 1),
r AS (SELECT c_mktsegment, round_even(k * 100.0 / n, 1) AS pct, k FROM g)
SELECT c.c_custkey,
  CAST(coalesce(r.k > 0 AND r.pct >= 9.0, false) AS INTEGER) AS c_mktsegment_high_risk,
  CAST(coalesce(r.k > 0 AND r.pct < 9.0 AND r.pct > 7.0, false) AS INTEGER) AS c_mktsegment_medium_risk,
  CAST(coalesce(r.k > 0 AND r.pct <= 7.0, false) AS INTEGER) AS c_mktsegment_low_risk
FROM customer c LEFT JOIN r USING (c_mktsegment)
""")
def q_risk_groups_apply(spark, sf):
    """Risk groups with distinct limits (high >= 9 %, low <= 7 %, medium between) applied as 0/1
    columns replacing the string source (E11)."""
    c = load(spark, sf, "customer", ["c_custkey", "c_mktsegment", "c_acctbal"]).withColumn(
        "y", (F.col("c_acctbal") < 0).cast("int"))
    table = EN.risk_groups_fit(c, "c_mktsegment", "y", upper=9.0, lower=7.0)
    out = EN.risk_groups_apply(c, "c_mktsegment", table, upper=9.0, lower=7.0)
    return out.select("c_custkey", "c_mktsegment_high_risk", "c_mktsegment_medium_risk", "c_mktsegment_low_risk")


# ------------------------------------------------------------------ E12
def _std_sql(c):
    z = f"(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ())"
    return f"SELECT '{c}' AS feature, min(z) AS z_min, max(z) AS z_max, count(CASE WHEN abs(z) > 2 THEN 1 END) AS n_outside_2 FROM (SELECT {z} AS z FROM lineitem)"


@query("standardise", f"""
SELECT feature, {rs('z_min')} AS z_min, {rs('z_max')} AS z_max, n_outside_2 FROM (
{_std_sql('l_quantity')} UNION ALL {_std_sql('l_extendedprice')})
""")
def q_standardise(spark, sf):
    """Standard scaling with the population standard deviation from one aggregate."""
    li = load(spark, sf, "lineitem", ["l_quantity", "l_extendedprice"])
    z = EN.standardize(li, ["l_quantity", "l_extendedprice"])
    u = EN.unpivot_values(z, ["l_quantity", "l_extendedprice"], as_string=False)
    return u.groupBy("feature").agg(F.min("value").alias("z_min"), F.max("value").alias("z_max"),
                                    F.count(F.when(F.abs("value") > 2, 1)).alias("n_outside_2"))
