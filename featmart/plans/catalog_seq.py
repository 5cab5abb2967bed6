"""Catalogue: order-aware features, sorts, set operations.

Each sequence query is registered twice: the plain window plan and the skew-safe chunked plan
(``_chunked``), which must give identical results against the same oracle.  Chunk sizes in the
catalogue are small so that the test data really spans several blocks per entity.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from featmart.operators import agg as A
from featmart.operators import joins as J
from featmart.operators import quantile as Q
from featmart.operators import seq as S
from featmart.plans.compare import rs
from featmart.plans.registry import query
from featmart.sources import load

EV_ORDER = ["ts", "event_id"]
_W_EV = "PARTITION BY user_id ORDER BY ts, event_id"


def _events(spark, sf):
    return load(spark, sf, "events", ["event_id", "user_id", "ts", "event_type", "value"]).withColumn(
        "ok_value", F.when(F.col("event_type") != "error", F.col("value")))


_EV_SQL = ("SELECT event_id, user_id, ts, value, CASE WHEN event_type <> 'error' THEN value END AS ok_value "
           "FROM events")

# ------------------------------------------------------------------ W2 W4 W5
SEQ_DIFF_SQL = f"""
WITH e AS ({_EV_SQL})
SELECT event_id,
  {rs(f'coalesce(value - lag(value) OVER ({_W_EV}), 0.0)')} AS value_diff,
  {rs(f'CASE WHEN ok_value IS NULL THEN 0.0 ELSE coalesce(sum(ok_value) OVER ({_W_EV} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) END')} AS ok_running,
  count(ok_value) OVER ({_W_EV} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ok_count,
  CAST(coalesce(value > lag(value) OVER ({_W_EV}), false) AS INTEGER) AS value_up
FROM e
"""

_DIFF_FEATS = {"value_diff": ("diff", "value", 0.0), "ok_running": ("running_sum", "ok_value"),
               "ok_count": ("running_count", "ok_value"), "value_up": ("increase", "value")}


def _seq_diff(spark, sf, chunk):
    e = _events(spark, sf)
    # the *_chunked variants force the chunked plan (adaptive=False) so that it is what is checked
    out = S.sequence_features(e, "user_id", EV_ORDER, _DIFF_FEATS, chunk_rows=chunk, adaptive=chunk is None)
    return out.select("event_id", "value_diff", "ok_running", "ok_count", "value_up")


@query("seq_diff_running", SEQ_DIFF_SQL)
def q_seq_diff_running(spark, sf):
    """Difference to previous row (first = 0), running sum with NULL rows at 0, running count,
    increase flag, per user in time order (W2, W4, W5)."""
    return _seq_diff(spark, sf, None)


@query("seq_diff_running_chunked", SEQ_DIFF_SQL)
def q_seq_diff_running_chunked(spark, sf):
    """Same as seq_diff_running on the skew-safe chunked plan (blocks of 16 rows)."""
    return _seq_diff(spark, sf, 16)


# ------------------------------------------------------------------ W3
def _roll_sql(col, n, fill=None):
    fr = f"({_W_EV} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    e = f"CASE WHEN count({col}) OVER {fr} = {n} THEN avg({col}) OVER {fr} END"
    if fill is not None:
        e = f"coalesce({e}, {fill})"
    return rs(e)


SEQ_ROLL_SQL = f"""
WITH e AS ({_EV_SQL})
SELECT event_id, {_roll_sql('value', 3)} AS value_roll3, {_roll_sql('value', 12)} AS value_roll12,
       {_roll_sql('ok_value', 3, 0.0)} AS ok_roll3_filled
FROM e
"""

_ROLL_FEATS = {"value_roll3": ("rolling_mean", "value", 3), "value_roll12": ("rolling_mean", "value", 12),
               "ok_roll3_filled": ("rolling_mean", "ok_value", 3, 0.0)}


@query("seq_rolling", SEQ_ROLL_SQL)
def q_seq_rolling(spark, sf):
    """Rolling means of 3 and 12 rows, only over full windows of non-NULL values."""
    out = S.sequence_features(_events(spark, sf), "user_id", EV_ORDER, _ROLL_FEATS)
    return out.select("event_id", *_ROLL_FEATS)


@query("seq_rolling_chunked", SEQ_ROLL_SQL)
def q_seq_rolling_chunked(spark, sf):
    """Same as seq_rolling on the chunked plan (blocks of 20 rows, halo of 11)."""
    out = S.sequence_features(_events(spark, sf), "user_id", EV_ORDER, _ROLL_FEATS, chunk_rows=20, adaptive=False)
    return out.select("event_id", *_ROLL_FEATS)


# ------------------------------------------------------------------ W7
EWM_ALPHA = 0.7


def _ewm_sql(source: str, alphas: dict[str, float]) -> str:
    """The definition itself: every row of the user up to this one, weighted by its distance."""
    def part(name, alpha):
        w = f"pow({1 - alpha!r}, a.rn - b.rn)"
        return f"sum({w} * b.x) / nullif(sum(CASE WHEN b.x IS NOT NULL THEN {w} END), 0)", name
    exprs = [part(n, a) for n, a in alphas.items()]
    return f"""
WITH e AS (SELECT *, row_number() OVER ({_W_EV}) AS rn FROM ({source}))
SELECT a.event_id, {', '.join(f'{rs(e)} AS {n}' for e, n in exprs)}
FROM e a JOIN e b ON a.user_id IS NOT DISTINCT FROM b.user_id AND b.rn <= a.rn GROUP BY a.event_id
"""


EWM_SQL = _ewm_sql(f"SELECT *, ok_value AS x FROM ({_EV_SQL})", {"ok_ewm": EWM_ALPHA})


@query("ewm_mean", EWM_SQL)
def q_ewm_mean(spark, sf):
    """Exponentially weighted mean (alpha = 0.7, pandas adjust=True, NULLs skipped with their
    positional weights), exact over any look-back - no UDF, no collect_list (W7)."""
    out = S.sequence_features(_events(spark, sf), "user_id", EV_ORDER, {"ok_ewm": ("ewm", "ok_value", EWM_ALPHA)})
    return out.select("event_id", "ok_ewm")


@query("ewm_mean_chunked", EWM_SQL)
def q_ewm_mean_chunked(spark, sf):
    """Same as ewm_mean with every user cut into blocks."""
    out = S.sequence_features(_events(spark, sf), "user_id", EV_ORDER, {"ok_ewm": ("ewm", "ok_value", EWM_ALPHA)},
                              chunk_rows=40, adaptive=False)
    return out.select("event_id", "ok_ewm")


# long runs of NULL: users folded into seven, a value only every 45th event and in the first ten
_GAPS_SRC = ("SELECT event_id, user_id % 7 AS user_id, ts, CASE WHEN event_id % 45 = 0 OR value < 3 THEN value END AS x FROM events")
_GAP_ALPHAS = {"ewm_07": 0.7, "ewm_01": 0.1, "ewm_001": 0.01}


@query("ewm_mean_gaps", _ewm_sql(_GAPS_SRC, _GAP_ALPHAS))
def q_ewm_mean_gaps(spark, sf):
    """EWM for alpha 0.7, 0.1 and 0.01 over inputs with long runs of NULL: no look-back limit."""
    e = load(spark, sf, "events", ["event_id", "user_id", "ts", "value"]).select(
        "event_id", (F.col("user_id") % 7).alias("user_id"), "ts",
        F.when((F.col("event_id") % 45 == 0) | (F.col("value") < 3), F.col("value")).alias("x"))
    for name, alpha in _GAP_ALPHAS.items():
        e = S.sequence_features(e, "user_id", EV_ORDER, {name: ("ewm", "x", alpha)})
    return e.select("event_id", *_GAP_ALPHAS)


# ------------------------------------------------------------------ NULL keys and NULL order values
_W_NULL = "PARTITION BY k ORDER BY o NULLS LAST, event_id"
SEQ_NULLS_SQL = f"""
WITH e AS (SELECT event_id, nullif(user_id % 9, 4) AS k, CASE WHEN event_id % 5 <> 2 THEN ts END AS o, value FROM events)
SELECT event_id, row_number() OVER ({_W_NULL}) AS rn, {rs(f'lag(value, 2) OVER ({_W_NULL})')} AS back, {rs(f'lead(value) OVER ({_W_NULL})')} AS ahead,
  count(*) OVER (PARTITION BY k) AS n, {rs(f'sum(value) OVER ({_W_NULL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS total
FROM e
"""


def _seq_nulls(spark, sf, chunk):
    e = load(spark, sf, "events", ["event_id", "user_id", "ts", "value"]).select(
        "event_id", F.nullif(F.col("user_id") % 9, F.lit(4)).alias("k"), F.when(F.col("event_id") % 5 != 2, F.col("ts")).alias("o"), "value")
    out = S.sequence_features(e, "k", ["o", "event_id"], {"rn": ("row_number",), "back": ("lag", "value", 2), "ahead": ("lead", "value", 1),
                                                          "n": ("key_count",), "total": ("running_sum", "value")}, chunk, adaptive=chunk is None)
    return out.select("event_id", "rn", "back", "ahead", "n", "total")


@query("seq_null_keys", SEQ_NULLS_SQL)
def q_seq_null_keys(spark, sf):
    """NULL keys are an entity like any other and NULL order values sort last."""
    return _seq_nulls(spark, sf, None)


@query("seq_null_keys_chunked", SEQ_NULLS_SQL)
def q_seq_null_keys_chunked(spark, sf):
    """Same as seq_null_keys with every key cut into blocks of 16 rows."""
    return _seq_nulls(spark, sf, 16)


@query("quantile_null_keys", f"""
SELECT nullif(user_id % 9, 4) AS k, {rs('quantile_cont(v, 0.1)')} AS p0, {rs('quantile_cont(v, 0.5)')} AS p1, {rs('quantile_cont(v, 0.9)')} AS p2
FROM (SELECT user_id, CASE WHEN event_id % 3 > 0 THEN 1.5 ELSE value END AS v FROM events) GROUP BY 1
""")
def q_quantile_null_keys(spark, sf):
    """Exact quantiles with a NULL key and a value that two thirds of the rows share."""
    e = load(spark, sf, "events", ["event_id", "user_id", "value"]).select(
        F.nullif(F.col("user_id") % 9, F.lit(4)).alias("k"), F.when(F.col("event_id") % 3 > 0, F.lit(1.5)).otherwise(F.col("value")).alias("v"))
    return Q.percentiles(e, ["k"], "v", [0.1, 0.5, 0.9])


# ------------------------------------------------------------------ W6 O5
_W_O = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


def _flk_sql():
    def blk(cond, tag):
        x = f"CASE WHEN {cond} THEN o_totalprice END"
        return (f"{rs(f'coalesce(sum({x}), 0)')} AS price_sum_{tag}, {rs(f'avg({x})')} AS price_mean_{tag}, "
                f"{rs(f'max({x})')} AS price_max_{tag}")
    return f"""
WITH o AS (SELECT o_custkey, o_totalprice, row_number() OVER ({_W_O}) AS rn, count(*) OVER (PARTITION BY o_custkey) AS cnt
           FROM orders)
SELECT o_custkey, {blk('rn <= 2', 'first_2')}, {blk('rn > cnt - 5', 'last_5')}, {blk('true', 'all')}
FROM o GROUP BY 1
"""


def _ends(tag, cond):
    x = F.when(cond, F.col("o_totalprice"))
    return [A.agg_fn("sum", x).alias(f"price_sum_{tag}"), F.avg(x).alias(f"price_mean_{tag}"), F.max(x).alias(f"price_max_{tag}")]


@query("first_last_k", _flk_sql())
def q_first_last_k(spark, sf):
    """First 2 / last 5 / all orders per customer: either end by a limited rank, aggregated in one conditional pass, joined
    with the aggregate over all rows (W6, O5)."""
    o = load(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])
    s = S.first_last_k(o, "o_custkey", ["o_orderdate", "o_orderkey"], first_k=2, last_k=5)
    ends = s.groupBy("o_custkey").agg(*_ends("first_2", F.col("_first")), *_ends("last_5", F.col("_last")))
    return S.null_safe_join(ends, o.groupBy("o_custkey").agg(*_ends("all", F.lit(True))), ["o_custkey"])


@query("first_last_k_chunked", _flk_sql())
def q_first_last_k_chunked(spark, sf):
    """Same as first_last_k from every row's position, by the chunked plan (no window over the key)."""
    o = load(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])
    s = S.flag_first_last_k(o, "o_custkey", ["o_orderdate", "o_orderkey"], first_k=2, last_k=5, chunk_rows=4, adaptive=False)
    return s.groupBy("o_custkey").agg(*_ends("first_2", F.col("_first")), *_ends("last_5", F.col("_last")), *_ends("all", F.lit(True)))


# ------------------------------------------------------------------ W8 W9 A22
_LK_BASE = ("SELECT c_custkey, c_nationkey, c_mktsegment, CAST(floor(abs(c_acctbal) / 2500) AS BIGINT) AS bal_bucket, "
            "c_acctbal, CAST(c_acctbal < 0 AS INTEGER) AS label FROM customer")
_LK_W = "PARTITION BY b.c_nationkey, b.c_mktsegment, b.bal_bucket ORDER BY b.c_acctbal, b.c_custkey"
LOOKALIKE_SQL = f"""
WITH b AS ({_LK_BASE}),
g AS (SELECT c_nationkey, c_mktsegment, bal_bucket, count(*) AS n FROM b GROUP BY 1, 2, 3 HAVING count(*) > 1)
SELECT b.c_custkey, g.n AS cluster_size,
  CASE WHEN g.n IS NOT NULL THEN lag(b.label) OVER ({_LK_W}) END AS prev_label,
  CASE WHEN g.n IS NOT NULL THEN lead(b.label) OVER ({_LK_W}) END AS next_label
FROM b LEFT JOIN g ON b.c_nationkey = g.c_nationkey AND b.c_mktsegment = g.c_mktsegment AND b.bal_bucket = g.bal_bucket
"""


def _lookalike(spark, sf, chunk=None):
    c = load(spark, sf, "customer", ["c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"]).select(
        "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal",
        F.floor(F.abs("c_acctbal") / 2500).alias("bal_bucket"), (F.col("c_acctbal") < 0).cast("int").alias("label"))
    cl = S.lookalike_clusters(c, ["c_nationkey", "c_mktsegment", "bal_bucket"], "c_custkey")
    return S.neighbour_labels(cl, "cluster", ["c_acctbal", "c_custkey"], "label", chunk_rows=chunk,
                              adaptive=chunk is None)


@query("lookalike_neighbours", LOOKALIKE_SQL)
def q_lookalike_neighbours(spark, sf):
    """Look-alike clusters (equal on nation, segment, balance bucket; size > 1) and the previous /
    next neighbour's label inside the cluster (W8, W9)."""
    return _lookalike(spark, sf).select("c_custkey", "cluster_size", "prev_label", "next_label")


@query("lookalike_neighbours_chunked", LOOKALIKE_SQL)
def q_lookalike_neighbours_chunked(spark, sf):
    """Same as lookalike_neighbours on the chunked plan (clusters cut into blocks of 2 rows)."""
    return _lookalike(spark, sf, chunk=2).select("c_custkey", "cluster_size", "prev_label", "next_label")


@query("neighbour_label_summary", f"""
WITH n AS ({LOOKALIKE_SQL}), l AS (SELECT c_custkey, CAST(c_acctbal < 0 AS INTEGER) AS label FROM customer)
SELECT n.prev_label, count(*) AS n_rows, {rs('avg(l.label)')} AS own_label_mean,
       CAST(sum(CAST(l.label IS NULL AS INTEGER)) AS BIGINT) AS n_unlabelled
FROM n JOIN l USING (c_custkey) WHERE n.prev_label IS NOT NULL GROUP BY 1
""")
def q_neighbour_label_summary(spark, sf):
    """Per neighbour-label value: size, mean own label, unlabelled count."""
    d = _lookalike(spark, sf).filter(F.col("prev_label").isNotNull())
    return d.groupBy("prev_label").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("label").alias("own_label_mean"),
                                       F.sum(F.col("label").isNull().cast("long")).alias("n_unlabelled"))


# ------------------------------------------------------------------ O1-O4
@query("top_categories", f"""
WITH s AS (SELECT o_custkey, o_orderpriority, sum(o_totalprice) AS spend, count(*) AS n
           FROM orders GROUP BY 1, 2)
SELECT row_number() OVER (ORDER BY spend DESC, n DESC, o_custkey, o_orderpriority) AS rank,
       o_custkey, o_orderpriority, {rs('spend')} AS spend, n
FROM s ORDER BY spend DESC, n DESC, o_custkey, o_orderpriority LIMIT 20
""")
def q_top_categories(spark, sf):
    """Top-20 (customer, priority) by spend with a full tie-break: multi-key mixed-direction sort
    plus limit, planned as a per-partition top-k and a merge (O1-O4)."""
    o = load(spark, sf, "orders", ["o_custkey", "o_orderpriority", "o_totalprice"])
    s = o.groupBy("o_custkey", "o_orderpriority").agg(F.sum("o_totalprice").alias("spend"),
                                                      F.count(F.lit(1)).alias("n"))
    order = [F.desc("spend"), F.desc("n"), F.asc("o_custkey"), F.asc("o_orderpriority")]
    top = s.orderBy(*order).limit(20)
    # the ranking window runs over the 20 rows the top-k produced, not over the input
    return top.select(F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"), "*")


# ------------------------------------------------------------------ U1 U2
@query("union_named", """
WITH u AS (SELECT 'orders' AS source, o_orderkey AS k, o_totalprice, NULL::DOUBLE AS l_quantity FROM orders
           UNION ALL SELECT 'lineitem', l_orderkey, NULL::DOUBLE, l_quantity FROM lineitem)
SELECT source, count(*) AS n, count(o_totalprice) AS n_price, count(l_quantity) AS n_qty,
       count(DISTINCT k) AS n_ids
FROM u GROUP BY 1
""")
def q_union_named(spark, sf):
    """Union by column name with missing columns filled NULL, and concatenated id vectors."""
    o = load(spark, sf, "orders", ["o_orderkey", "o_totalprice"]).select(
        F.lit("orders").alias("source"), F.col("o_orderkey").alias("k"), "o_totalprice")
    li = load(spark, sf, "lineitem", ["l_orderkey", "l_quantity"]).select(
        F.lit("lineitem").alias("source"), F.col("l_orderkey").alias("k"), "l_quantity")
    u = J.union_named([o, li])
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("o_totalprice").alias("n_price"),
                                   F.count("l_quantity").alias("n_qty"), F.countDistinct("k").alias("n_ids"))


# ------------------------------------------------------------------ U3
@query("duplicate_rows", """
WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY 1, 2)
SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(c) - count(*) AS BIGINT) AS n_duplicates,
       count(CASE WHEN c > 1 THEN 1 END) AS n_dup_groups
FROM g
""")
def q_duplicate_rows(spark, sf):
    """Duplicate count on (order, line): rows minus distinct, via one group-by."""
    li = load(spark, sf, "lineitem", ["l_orderkey", "l_linenumber"])
    g = li.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("c"))
    return g.agg(F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"),
                 (F.sum("c") - F.count(F.lit(1))).alias("n_duplicates"),
                 F.count(F.when(F.col("c") > 1, 1)).alias("n_dup_groups"))
