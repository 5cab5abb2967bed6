"""Catalogue: joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from featmart.functions import nulls as N
from featmart.operators import agg as A
from featmart.operators import joins as J
from featmart.operators import quantile as Q
from featmart.plans.compare import rs
from featmart.plans.registry import query
from featmart.sources import load

REF_DATE = "2001-01-01"  # the "application date" that day offsets are measured from


# ------------------------------------------------------------------ J2 A14
@query("join_composite", f"""
WITH p AS (SELECT l_orderkey, l_partkey, max(l_extendedprice) AS pair_max, count(*) AS pair_n
           FROM lineitem GROUP BY 1, 2),
j AS (SELECT l.l_orderkey, l.l_extendedprice / nullif(p.pair_max, 0) AS r, p.pair_n
      FROM lineitem l LEFT JOIN p ON l.l_orderkey = p.l_orderkey AND l.l_partkey = p.l_partkey)
SELECT l_orderkey, {rs('max(r)')} AS max_pair_ratio, {rs('min(r)')} AS min_pair_ratio,
       CAST(sum(pair_n) AS BIGINT) AS fanout_rows
FROM j GROUP BY 1
""")
def q_join_composite(spark, sf):
    """Group max by a composite key joined back on both keys, ratio, then aggregated."""
    li = load(spark, sf, "lineitem", ["l_orderkey", "l_partkey", "l_extendedprice"])
    pair = li.groupBy("l_orderkey", "l_partkey").agg(F.max("l_extendedprice").alias("pair_max"),
                                                     F.count(F.lit(1)).alias("pair_n"))
    j = li.join(pair, ["l_orderkey", "l_partkey"], "left").withColumn(
        "r", N.safe_div("l_extendedprice", "pair_max"))
    return j.groupBy("l_orderkey").agg(F.max("r").alias("max_pair_ratio"), F.min("r").alias("min_pair_ratio"),
                                       F.sum("pair_n").alias("fanout_rows"))


# ------------------------------------------------------------------ J3
@query("join_outer_aggs", f"""
WITH a AS (SELECT o_custkey AS id, count(*) AS n_orders, {rs('sum(o_totalprice)')} AS order_sum FROM orders GROUP BY 1),
b AS (SELECT user_id AS id, count(*) AS n_events, {rs('avg(value)')} AS event_mean FROM events GROUP BY 1)
SELECT coalesce(a.id, b.id) AS id, a.n_orders, a.order_sum, b.n_events, b.event_mean
FROM a FULL OUTER JOIN b ON a.id = b.id
""")
def q_join_outer_aggs(spark, sf):
    """Per-id aggregates of two sources, full outer join with the key coalesced."""
    a = load(spark, sf, "orders", ["o_custkey", "o_totalprice"]).groupBy(F.col("o_custkey").alias("id")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("order_sum"))
    b = load(spark, sf, "events", ["user_id", "value"]).groupBy(F.col("user_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_events"), F.avg("value").alias("event_mean"))
    return a.join(b, "id", "full")


# ------------------------------------------------------------------ J4
@query("join_fanout", f"""
WITH f AS (SELECT o.o_custkey, o.o_totalprice FROM orders o FULL OUTER JOIN lineitem l ON o.o_orderkey = l.l_orderkey),
fan AS (SELECT o_custkey, {rs('sum(o_totalprice)')} AS price_sum_fanout, count(*) AS n_rows_fanout FROM f
        WHERE o_custkey IS NOT NULL GROUP BY 1),
first AS (SELECT o_custkey, {rs('sum(o_totalprice)')} AS price_sum_aggfirst, count(*) AS n_orders FROM orders GROUP BY 1)
SELECT first.o_custkey, price_sum_fanout, n_rows_fanout, price_sum_aggfirst, n_orders
FROM first LEFT JOIN fan ON first.o_custkey = fan.o_custkey
""")
def q_join_fanout(spark, sf):
    """Full outer join with 1:N fan-out (sums multiplied by line count) next to the
    aggregate-first plan (J4): the documented multiplicity."""
    o = load(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])
    li = load(spark, sf, "lineitem", ["l_orderkey"])
    fan = (o.join(li, o.o_orderkey == li.l_orderkey, "full").filter(F.col("o_custkey").isNotNull())
           .groupBy("o_custkey").agg(F.sum("o_totalprice").alias("price_sum_fanout"),
                                     F.count(F.lit(1)).alias("n_rows_fanout")))
    first = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("price_sum_aggfirst"),
                                       F.count(F.lit(1)).alias("n_orders"))
    return first.join(fan, "o_custkey", "left")


# ------------------------------------------------------------------ J6
@query("join_back", f"""
WITH s AS (SELECT o_custkey, avg(o_totalprice) AS cust_mean, max(o_totalprice) AS cust_max, count(*) AS cust_n
           FROM orders GROUP BY 1)
SELECT o.o_orderkey, {rs('o.o_totalprice - s.cust_mean')} AS diff_to_mean,
       {rs('o.o_totalprice / nullif(s.cust_max, 0)')} AS share_of_max, s.cust_n
FROM orders o LEFT JOIN s ON o.o_custkey = s.o_custkey
""")
def q_join_back(spark, sf):
    """Group statistics on every detail row (J6), as aggregate + join on the group key."""
    o = load(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])
    j = J.group_stat_on_rows(o, ["o_custkey"], {"cust_mean": F.avg("o_totalprice"),
                                               "cust_max": F.max("o_totalprice"),
                                               "cust_n": F.count(F.lit(1))})
    return j.select("o_orderkey", (F.col("o_totalprice") - F.col("cust_mean")).alias("diff_to_mean"),
                    N.safe_div("o_totalprice", "cust_max").alias("share_of_max"), "cust_n")


# ------------------------------------------------------------------ J8 J9
@query("semi_anti", """
SELECT 'labelled' AS part, lang, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 2
UNION ALL
SELECT 'unlabelled' AS part, lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 2
""")
def q_semi_anti(spark, sf):
    """Rows whose key is / is not in an id set."""
    d = load(spark, sf, "documents", ["doc_id", "lang"])
    ids = load(spark, sf, "labels", ["doc_id"])
    a = J.semi(d, ids, "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("labelled"))
    b = J.anti(d, ids, "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("unlabelled"))
    return a.unionByName(b)


# ------------------------------------------------------------------ J7 J12
@query("star_join", f"""
WITH om AS (SELECT o_custkey AS c_custkey, count(*) AS ord_n, {rs('avg(o_totalprice)')} AS ord_price_mean
            FROM orders GROUP BY 1),
lm AS (SELECT o.o_custkey AS c_custkey, count(*) AS line_n, {rs('sum(l.l_quantity)')} AS line_qty_sum
       FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1),
em AS (SELECT user_id AS c_custkey, count(*) AS ev_n, {rs('max(value)')} AS ev_max FROM events GROUP BY 1)
SELECT c.c_custkey, c.c_mktsegment, om.ord_n, om.ord_price_mean, lm.line_n, lm.line_qty_sum, em.ev_n, em.ev_max
FROM customer c LEFT JOIN om USING (c_custkey) LEFT JOIN lm USING (c_custkey) LEFT JOIN em USING (c_custkey)
""")
def q_star_join(spark, sf):
    """Aggregate-then-attach for three child sources and a star join onto the base."""
    c = load(spark, sf, "customer", ["c_custkey", "c_mktsegment"])
    o = load(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_totalprice"]).withColumnRenamed("o_custkey", "c_custkey")
    li = load(spark, sf, "lineitem", ["l_orderkey", "l_quantity"])
    e = load(spark, sf, "events", ["user_id", "value"]).withColumnRenamed("user_id", "c_custkey")
    om = o.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("ord_n"), F.avg("o_totalprice").alias("ord_price_mean"))
    lm = (li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
          .join(o.select("o_orderkey", "c_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
          .groupBy("c_custkey").agg(F.sum("n").alias("line_n"), F.sum("q").alias("line_qty_sum")))
    base = J.aggregate_and_attach(c, e, "c_custkey", [F.count(F.lit(1)).alias("ev_n"), F.max("value").alias("ev_max")])
    return J.star_join(base, "c_custkey", [om, lm])


# ------------------------------------------------------------------ A2 A3 A5
def _ord_num_sql():
    return ("o_custkey, o_totalprice, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days, "
            "CAST(left(o_orderpriority, 1) AS INTEGER) AS prio, o_orderkey")


@query("agg_all_numeric", f"""
WITH o AS (SELECT {_ord_num_sql()} FROM orders)
SELECT o_custkey,
  {rs('min(o_totalprice)')} AS o_totalprice_min, {rs('max(o_totalprice)')} AS o_totalprice_max,
  {rs('avg(o_totalprice)')} AS o_totalprice_mean, {rs('var_samp(o_totalprice)')} AS o_totalprice_var,
  {rs('coalesce(sum(o_totalprice), 0)')} AS o_totalprice_sum,
  min(days) AS days_min, max(days) AS days_max, {rs('avg(days)')} AS days_mean, {rs('var_samp(days)')} AS days_var,
  CAST(coalesce(sum(days), 0) AS BIGINT) AS days_sum,
  min(prio) AS prio_min, max(prio) AS prio_max, {rs('avg(prio)')} AS prio_mean, {rs('var_samp(prio)')} AS prio_var,
  CAST(coalesce(sum(prio), 0) AS BIGINT) AS prio_sum,
  count(*) AS size, count(o_orderkey) AS n_keys
FROM o GROUP BY 1
""")
def q_agg_all_numeric(spark, sf):
    """min/max/mean/var/sum of every numeric column per key, row count and non-null key count
    (A2, A3, A5)."""
    o = load(spark, sf, "orders").select(
        "o_custkey", "o_totalprice",
        F.datediff(F.col("o_orderdate"), F.lit("1995-01-01").cast("date")).alias("days"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("prio"), "o_orderkey")
    return A.aggregate_all(o, "o_custkey", fns=("min", "max", "mean", "var", "sum"), with_size=True, exclude=["o_orderkey"],
                           extra=[F.count("o_orderkey").alias("n_keys")])


# ------------------------------------------------------------------ A4
def _mode_sql(table, key, col):
    return (f"(SELECT {key}, {col} AS v FROM (SELECT {key}, {col}, row_number() OVER "
            f"(PARTITION BY {key} ORDER BY count(*) DESC, {col}) AS rn FROM {table} WHERE {col} IS NOT NULL "
            f"GROUP BY {key}, {col}) WHERE rn = 1)")


@query("agg_mixed_profile", f"""
WITH base AS (SELECT o_custkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders),
g AS (SELECT o_custkey,
  {rs('min(o_totalprice)')} AS o_totalprice_min, {rs('max(o_totalprice)')} AS o_totalprice_max,
  {rs('avg(o_totalprice)')} AS o_totalprice_mean, {rs('coalesce(sum(o_totalprice), 0)')} AS o_totalprice_sum,
  count(DISTINCT o_orderstatus) AS o_orderstatus_nunique, count(o_orderstatus) AS o_orderstatus_count,
  count(DISTINCT o_orderpriority) AS o_orderpriority_nunique, count(o_orderpriority) AS o_orderpriority_count
  FROM base GROUP BY 1)
SELECT g.*, ms.v AS o_orderstatus_mode, mp.v AS o_orderpriority_mode
FROM g LEFT JOIN {_mode_sql('base', 'o_custkey', 'o_orderstatus')} ms ON g.o_custkey = ms.o_custkey
       LEFT JOIN {_mode_sql('base', 'o_custkey', 'o_orderpriority')} mp ON g.o_custkey = mp.o_custkey
""")
def q_agg_mixed_profile(spark, sf):
    """Numeric min/max/mean/sum and categorical mode/nunique/count per key (A4); mode ties go
    to the smallest value."""
    o = load(spark, sf, "orders", ["o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"])
    return A.mixed_profile(o, "o_custkey")


# ------------------------------------------------------------------ A7 A8
@query("two_step_agg", f"""
WITH m AS (SELECT l_orderkey, max(l_extendedprice) AS mx FROM lineitem GROUP BY 1),
o AS (SELECT o.o_custkey, m.mx FROM orders o JOIN m ON o.o_orderkey = m.l_orderkey),
s AS (SELECT o_custkey, {rs('sum(mx)')} AS max_line_sum, {rs('avg(mx)')} AS max_line_mean FROM o GROUP BY 1),
d AS (SELECT o.o_custkey, count(DISTINCT l.l_partkey) AS n_parts, count(DISTINCT l.l_returnflag) AS n_flags,
             count(DISTINCT o.o_orderkey) AS n_orders_with_lines
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1)
SELECT s.*, d.n_parts, d.n_flags, d.n_orders_with_lines FROM s JOIN d USING (o_custkey)
""")
def q_two_step_agg(spark, sf):
    """Max per (customer, order) then sum / mean per customer; distinct counts."""
    li = load(spark, sf, "lineitem", ["l_orderkey", "l_partkey", "l_returnflag", "l_extendedprice"])
    o = load(spark, sf, "orders", ["o_orderkey", "o_custkey"])
    # (order, part, flag) first, so lines are read and joined once; an order's parts stay as counted rows
    cells = li.groupBy("l_orderkey", "l_partkey", "l_returnflag").agg(F.max("l_extendedprice").alias("mx")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    u = cells.select("o_custkey", F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("l_orderkey").alias("k"), F.col("mx").alias("x")),
        F.struct(F.lit(1).alias("kind"), F.col("l_partkey").cast("bigint").alias("k"), F.lit(None).cast("double").alias("x")),
        F.struct(F.lit(2).alias("kind"), F.ascii("l_returnflag").cast("bigint").alias("k"), F.lit(None).cast("double").alias("x")))).alias("c"))
    per = u.groupBy("o_custkey", "c.kind", "c.k").agg(F.max("c.x").alias("mx"))
    order = F.col("kind") == 0
    return per.groupBy("o_custkey").agg(
        F.sum("mx").alias("max_line_sum"), F.avg("mx").alias("max_line_mean"), F.count(F.when(order, 1)).alias("n_orders_with_lines"),
        F.count(F.when(F.col("kind") == 1, 1)).alias("n_parts"), F.count(F.when(F.col("kind") == 2, 1)).alias("n_flags"))


# ------------------------------------------------------------------ A9 A11
def _cond_sql(val, tag):
    cond = f"o_orderstatus = '{val}'" if val else "o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O')"
    x = f"CASE WHEN {cond} THEN o_totalprice END"
    return (f"{rs(f'coalesce(sum({x}), 0)')} AS price_sum_{tag}, {rs(f'avg({x})')} AS price_mean_{tag}, "
            f"{rs(f'max({x})')} AS price_max_{tag}, count(CASE WHEN {cond} THEN 1 END) AS price_size_{tag}")


_PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _onehot_sql():
    out = []
    for p in _PRIOS:
        ind = f"coalesce(CAST(o_orderpriority = '{p}' AS INTEGER), 0)"
        out.append(f"CAST(sum({ind}) AS BIGINT) AS \"o_orderpriority_{p}_count\", "
                   f"{rs(f'avg({ind})')} AS \"o_orderpriority_{p}_share\"")
    return ", ".join(out)


@query("cond_agg_category", f"""
WITH a AS (SELECT o_custkey, {_cond_sql('F', 'f')}, {_cond_sql('O', 'o')}, {_cond_sql(None, 'rest')}
           FROM orders GROUP BY 1),
b AS (SELECT o_custkey, {_onehot_sql()} FROM orders GROUP BY 1)
SELECT * FROM a JOIN b USING (o_custkey)
""")
def q_cond_agg_category(spark, sf):
    """Conditional aggregates per category value with a null-safe remainder block, and one-hot
    counts / shares without materialised dummies (A9, A11), all in one group-by."""
    o = load(spark, sf, "orders", ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])
    spec = A.AggSpec([("price", ["sum", "mean", "max", "size"], "o_totalprice")])
    exprs = A.cond_agg_exprs("o_orderstatus", ["F", "O"], spec) + A.category_count_exprs("o_orderpriority", _PRIOS)
    return o.filter(F.col("o_custkey").isNotNull()).groupBy("o_custkey").agg(*exprs)


# ------------------------------------------------------------------ A10
_DAYS = f"date_diff('day', DATE '{REF_DATE}', CAST(l_shipdate AS DATE))"


@query("cond_agg_time", f"""
SELECT l_orderkey,
  {rs('coalesce(sum(l_extendedprice), 0)')} AS price_sum_all, {rs('avg(l_extendedprice)')} AS price_mean_all,
  {rs(f'coalesce(sum(CASE WHEN {_DAYS} > -365 THEN l_extendedprice END), 0)')} AS price_sum_last_year,
  {rs(f'avg(CASE WHEN {_DAYS} > -365 THEN l_extendedprice END)')} AS price_mean_last_year,
  {rs(f'max(CASE WHEN {_DAYS} > -365 THEN l_extendedprice END)')} AS price_max_last_year,
  count(CASE WHEN {_DAYS} > -365 THEN 1 END) AS n_last_year
FROM lineitem GROUP BY 1
""")
def q_cond_agg_time(spark, sf):
    """Time-sliced aggregates: rows of the last 365 days vs all, in one pass (A10)."""
    li = load(spark, sf, "lineitem", ["l_orderkey", "l_extendedprice", "l_shipdate"]).withColumn(
        "days", F.datediff(F.col("l_shipdate"), F.lit(REF_DATE).cast("date")))
    recent = F.col("days") > -365
    x = F.when(recent, F.col("l_extendedprice"))
    return li.groupBy("l_orderkey").agg(
        A.agg_fn("sum", F.col("l_extendedprice")).alias("price_sum_all"),
        F.avg("l_extendedprice").alias("price_mean_all"),
        A.agg_fn("sum", x).alias("price_sum_last_year"), F.avg(x).alias("price_mean_last_year"),
        F.max(x).alias("price_max_last_year"), F.count(F.when(recent, 1)).alias("n_last_year"))


# ------------------------------------------------------------------ A12 A13 A24
@query("pct_condition", f"""
SELECT l_orderkey,
  {rs('100.0 * count(CASE WHEN l_linenumber % 3 > 0 AND l_discount < 0.02 THEN 1 END) / count(*)')} AS pct_low_discount,
  {rs('100.0 * sum(l_extendedprice * l_discount) / nullif(sum(l_extendedprice), 0)')} AS discount_share_pct,
  count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS n_returned,
  {rs("sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) / nullif(count(CASE WHEN l_returnflag = 'R' THEN 1 END), 0)")} AS avg_returned_price
FROM lineitem GROUP BY 1
""")
def q_pct_condition(spark, sf):
    """Percent of all rows meeting a condition (a NULL does not meet it; every third line's discount
    is made NULL), ratio of group sums x100, conditional count (A12, A13, A24)."""
    li = load(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_discount", "l_extendedprice", "l_returnflag"])
    low = F.when(F.col("l_linenumber") % 3 > 0, F.col("l_discount")) < 0.02
    ret = F.col("l_returnflag") == "R"
    return li.groupBy("l_orderkey").agg(
        (F.lit(100.0) * F.avg(N.flag(low))).alias("pct_low_discount"),
        (F.lit(100.0) * N.safe_div(F.sum(F.col("l_extendedprice") * F.col("l_discount")), F.sum("l_extendedprice")))
        .alias("discount_share_pct"),
        F.count_if(ret).alias("n_returned"),
        N.safe_div(F.sum(F.when(ret, F.col("l_extendedprice"))), F.count_if(ret)).alias("avg_returned_price"))


# ------------------------------------------------------------------ A15 A18
_LORD = "l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query("agg_derived", f"""
WITH r AS (SELECT l_orderkey, l_extendedprice AS due, l_extendedprice * (1 - l_discount) AS paid,
                  l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem),
g AS (SELECT l_orderkey,
  CAST(date_diff('day', CAST(min(l_shipdate) AS DATE), CAST(max(l_shipdate) AS DATE)) AS INTEGER) AS ship_span_days,
  max(due) - min(due) AS due_range, avg(due) - avg(paid) AS mean_gap, max(due) - max(paid) AS max_gap,
  min(due) - min(paid) AS min_gap, var_samp(due) - var_samp(paid) AS var_gap,
  arg_max(due, ({_LORD.replace('l_', 'r.l_')})) - arg_max(paid, ({_LORD.replace('l_', 'r.l_')})) AS last_gap,
  arg_min(due, ({_LORD.replace('l_', 'r.l_')})) - arg_min(paid, ({_LORD.replace('l_', 'r.l_')})) AS first_gap,
  count(*) AS n_lines
  FROM r GROUP BY 1)
SELECT l_orderkey, ship_span_days, {rs('due_range')} AS due_range, {rs('mean_gap')} AS mean_gap,
  {rs('max_gap')} AS max_gap, {rs('min_gap')} AS min_gap, {rs('var_gap')} AS var_gap,
  {rs('last_gap')} AS last_gap, {rs('first_gap')} AS first_gap,
  {rs('due_range / n_lines')} AS range_per_line
FROM g
""")
def q_agg_derived(spark, sf):
    """Features derived after aggregation (ranges, per-row rates) and differences of per-key
    aggregates of two columns incl. first / last in order (A15, A18)."""
    li = load(spark, sf, "lineitem", ["l_orderkey", "l_extendedprice", "l_discount", "l_shipdate",
                                      "l_linenumber", "l_partkey", "l_suppkey"]).withColumn(
        "due", F.col("l_extendedprice")).withColumn("paid", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    spec = A.AggSpec([("due", ["min", "max", "mean", "var", "first", "last"], "due"),
                      ("paid", ["min", "max", "mean", "var", "first", "last"], "paid"),
                      ("ship", ["min", "max"], "l_shipdate"), ("n", ["size"], "1")], order=order)
    g = A.aggregate(li, "l_orderkey", spec)
    return g.select(
        "l_orderkey",
        F.datediff("ship_max", "ship_min").alias("ship_span_days"),
        (F.col("due_max") - F.col("due_min")).alias("due_range"),
        (F.col("due_mean") - F.col("paid_mean")).alias("mean_gap"),
        (F.col("due_max") - F.col("paid_max")).alias("max_gap"),
        (F.col("due_min") - F.col("paid_min")).alias("min_gap"),
        (F.col("due_var") - F.col("paid_var")).alias("var_gap"),
        (F.col("due_last") - F.col("paid_last")).alias("last_gap"),
        (F.col("due_first") - F.col("paid_first")).alias("first_gap"),
        N.safe_div(F.col("due_max") - F.col("due_min"), "n_size").alias("range_per_line"))


# ------------------------------------------------------------------ A16 A17
@query("latest_row", f"""
WITH e AS (SELECT user_id, CASE WHEN event_id % 4 <> 1 THEN ts END AS ts, event_id, event_type, value,
                  CASE WHEN event_type <> 'error' THEN value END AS ok_value FROM events),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS FIRST, event_id DESC) AS r FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS LAST, event_id) AS f,
             row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS FIRST, event_id DESC) AS l FROM e WHERE ok_value IS NOT NULL)
SELECT a.user_id, {rs('l.ok_value')} AS last_ok_value, {rs('f.ok_value')} AS first_ok_value, a.event_type AS last_type,
  {rs('a.value')} AS last_value, a.ts AS last_ts
FROM a LEFT JOIN o f ON f.user_id = a.user_id AND f.f = 1 LEFT JOIN o l ON l.user_id = a.user_id AND l.l = 1 WHERE a.r = 1
""")
def q_latest_row(spark, sf):
    """Last / first non-NULL value per key in time order and the latest whole row per key
    (A16, A17) - fixed-size max_by buffers, no window over the group. A quarter of the times are NULL
    and sort last."""
    e = load(spark, sf, "events", ["user_id", "ts", "event_id", "event_type", "value"]).withColumns(
        {"ts": F.when(F.col("event_id") % 4 != 1, F.col("ts")), "ok_value": F.when(F.col("event_type") != "error", F.col("value"))})
    order = ["ts", "event_id"]
    latest = F.max_by(F.struct("event_type", "value", "ts"), A.order_key(order))
    return e.groupBy("user_id").agg(
        A.last_nonnull("ok_value", order).alias("last_ok_value"),
        A.first_nonnull("ok_value", order).alias("first_ok_value"),
        latest.alias("r")).select("user_id", "last_ok_value", "first_ok_value",
                                  F.col("r.event_type").alias("last_type"), F.col("r.value").alias("last_value"),
                                  F.col("r.ts").alias("last_ts"))


# ------------------------------------------------------------------ A19
@query("global_scalar", f"""
WITH t AS (SELECT sum(l_extendedprice) AS total FROM lineitem)
SELECT l_returnflag, {rs('sum(l_extendedprice / total)')} AS price_share, count(*) AS n
FROM lineitem, t GROUP BY 1
""")
def q_global_scalar(spark, sf):
    """Whole-table aggregate attached to every row as a constant, then grouped."""
    li = load(spark, sf, "lineitem", ["l_returnflag", "l_extendedprice"])
    li = A.global_scalar(li, F.sum("l_extendedprice"), "total")
    return li.groupBy("l_returnflag").agg(F.sum(F.col("l_extendedprice") / F.col("total")).alias("price_share"),
                                          F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ A20 W1
@query("median_ratio", f"""
WITH m1 AS (SELECT o_orderpriority, median(o_totalprice) AS med_prio FROM orders GROUP BY 1),
m2 AS (SELECT o_orderpriority, o_orderstatus, median(o_totalprice) AS med_prio_status FROM orders GROUP BY 1, 2)
SELECT o.o_orderkey, {rs('m1.med_prio')} AS med_prio, {rs('m2.med_prio_status')} AS med_prio_status,
       {rs('o.o_totalprice / nullif(m1.med_prio, 0)')} AS price_to_median
FROM orders o JOIN m1 USING (o_orderpriority) JOIN m2 USING (o_orderpriority, o_orderstatus)
""")
def q_median_ratio(spark, sf):
    """Median per one and two keys attached to rows, ratio to it (A20, W1).  Medians are the
    skew-safe ranked medians joined back on the group key."""
    o = load(spark, sf, "orders", ["o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"])
    o = o.join(Q.median_by(o, ["o_orderpriority"], "o_totalprice", "med_prio", few=True), ["o_orderpriority"], "left")
    o = o.join(Q.median_by(o, ["o_orderpriority", "o_orderstatus"], "o_totalprice", "med_prio_status", few=True),
               ["o_orderpriority", "o_orderstatus"], "left")
    return o.select("o_orderkey", "med_prio", "med_prio_status",
                    N.safe_div("o_totalprice", "med_prio").alias("price_to_median"))


# ------------------------------------------------------------------ A21
@query("dist_pack", f"""
WITH e AS (SELECT user_id % 50 AS user_id, CASE WHEN user_id % 50 = 7 THEN 3.3 WHEN user_id % 50 = 8 THEN value * 1e-9 ELSE value END AS value FROM events)
SELECT user_id, count(*) AS size, {rs('coalesce(sum(value), 0)')} AS sum, {rs('min(value)')} AS min,
  {rs('median(value)')} AS median, {rs('max(value)')} AS max, {rs('avg(value)')} AS mean,
  {rs('stddev_pop(value)')} AS std,
  {rs('CASE WHEN count(value) < 3 THEN NULL WHEN min(value) = max(value) THEN 0.0 ELSE skewness(value) END')} AS skew,
  {rs('CASE WHEN count(value) < 4 THEN NULL WHEN min(value) = max(value) THEN 0.0 ELSE kurtosis(value) END')} AS kurt
FROM e GROUP BY 1
""")
def q_dist_pack(spark, sf):
    """Nine statistics per key with bias-corrected skew / kurtosis; one key is constant and one has
    values of the order of 1e-7 (A21)."""
    k = F.col("user_id") % 50
    e = load(spark, sf, "events", ["user_id", "value"]).select(
        k.alias("user_id"), F.when(k == 7, F.lit(3.3)).when(k == 8, F.col("value") * 1e-9).otherwise(F.col("value")).alias("value"))
    return A.dist_pack(e, "user_id", "value")


# ------------------------------------------------------------------ A23 W10 X5
@query("freq_share", f"""
WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_orderstatus, o_orderpriority, n,
  {rs('n / sum(n) OVER (PARTITION BY o_orderstatus)')} AS share_in_status,
  {rs('n / sum(n) OVER ()')} AS share_all
FROM c
""")
def q_freq_share(spark, sf):
    """Frequency and relative frequency of a category overall and within a group.
    The window runs over the small (status x priority) count table, not over detail rows."""
    o = load(spark, sf, "orders", ["o_orderstatus", "o_orderpriority"])
    c = o.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n")).first()[0]
    return c.select("o_orderstatus", "o_orderpriority", "n",
                    (F.col("n") / F.sum("n").over(Window.partitionBy("o_orderstatus"))).alias("share_in_status"),
                    (F.col("n") / F.lit(float(total))).alias("share_all"))
